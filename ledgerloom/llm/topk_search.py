"""Operator 3, exact top-k search by block-at-a-time pruning.

Vectors become integers; dimensions are the terms, and a dimension's weights may have either sign. The
documents are put in ranges (blocks) of similar vectors; a block keeps the greatest and least weight of
each term, and its vectors as a small matrix, the block's forward index. A query's bound for a block is
the sum over its terms of the largest product that the block allows. A query visits blocks in the
descending order of their bounds, scores all of the block at once, and stops when the bound of the next
block is below its k-th score.

On Spark the documents are dealt into groups by their leading term, of a bounded number of vectors, and so are the queries. Bounds
for whole groups come from a table of their greatest and least weights. A query first visits the group of its highest bound, whose k-th score
prunes all groups of lower bounds; the rest of its groups is visited in a second round. A cell, some queries of one group and one group of documents, is a
task of bounded size, which goes through its blocks as above; cells that no query has to visit are never made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 5
BLOCK = 128


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null if the vector or a component is null or not finite, or it is empty."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(as_double, lambda x: F.floor(x * scale).cast("long")))


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows, shorter ones filled with 0."""
    width = max(map(len, rows))
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _numbers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every inner product is exact in them, else as integers of any size; of one width."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2**53:
        return a.astype(np.float64), b.astype(np.float64)
    return a.astype(object), b.astype(object)


def search_cell(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores), each queries x k, the best first; -1 and the least score where there are fewer. Rows of the query's own id take no part."""
    q, x = _numbers(q, x)
    order = np.lexsort((ids, x.argmax(axis=1), np.abs(x).argmax(axis=1) * 2 + (x.max(axis=1) > -x.min(axis=1))))
    ids, x = ids[order], x[order]
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    visit = np.argsort(-bounds, axis=1, kind="stable")
    # Below every score; numbers of any size have no infinity.
    worst = -np.inf if q.dtype == np.float64 else -(1 << 200)
    top_id = np.full((len(q), k), -1, dtype=np.int64)
    top = np.full((len(q), k), worst, dtype=q.dtype)
    running = np.arange(len(q))
    for turn in range(len(starts)):
        # A block whose bound equals the k-th score may hold a smaller id of that score.
        running = running[bounds[running, visit[running, turn]] >= top[running, k - 1]]
        if not len(running):
            break
        here = visit[running, turn]
        for b in np.unique(here).tolist():
            who = running[here == b]
            part = slice(starts[b], starts[b] + block)
            score = q[who] @ x[part].T
            score[q_ids[who][:, None] == ids[part][None, :]] = worst
            all_scores = np.concatenate([top[who], score], axis=1)
            all_ids = np.concatenate([top_id[who], np.broadcast_to(ids[part], score.shape)], axis=1)
            best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            top[who] = np.take_along_axis(all_scores, best, axis=1)
            top_id[who] = np.take_along_axis(all_ids, best, axis=1)
    top_id[top == worst] = -1
    return top_id, top


def _packed(pdf: pd.DataFrame, key: str) -> dict:
    """A group's ids and vectors in one row."""
    x = _matrix(list(pdf["v"]))
    x = x.astype("<i4") if max(int(x.max(initial=0)), -int(x.min(initial=0))) < 1 << 31 else x.astype("<i8")
    return {key: pdf[key].iloc[0], "ids": pdf["id"].to_numpy(dtype="<i8").tobytes(), "x": x.tobytes(), "width": x.shape[1], "high": x.max(axis=0).tolist(), "low": x.min(axis=0).tolist()}


def _unpacked(ids: bytes, x: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, dtype="<i8")
    return names, np.frombuffer(x, dtype="<i8" if len(x) == 8 * len(names) * width else "<i4").reshape(len(names), width).astype(np.int64)


def group_bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and group the highest score that the group's greatest and least weights allow."""
    q, both = _numbers(q, np.concatenate([high, low]))
    return np.maximum(q, 0) @ both[: len(high)].T + np.minimum(q, 0) @ both[len(high) :].T


class Search:
    """The packed groups of a search, and its two rounds of cells."""

    def __init__(self, rows: DataFrame, k: int, candidates_each: int, queries_each: int, bounds_each: int):
        """rows: id, v, query; written."""
        self.k, self.spark = k, rows.sparkSession
        size = F.transform("v", lambda x: F.abs(x.cast("decimal(20,0)")))
        place = F.array_position(size, F.array_max(size)).cast("int")
        led = rows.withColumn("lead", place * 2 + (F.element_at("v", place) > 0).cast("int"))
        # Two rows for each component at most. Leading terms of few vectors share a group, in their order.
        before = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
        few = lambda n, each: F.coalesce(F.sum(F.when(F.col(n) < each, F.col(n)).otherwise(0)).over(before), F.lit(0))
        counts = led.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("asked"))
        counts = counts.withColumns({"n_before": few("n", candidates_each), "asked_before": few("asked", queries_each)})
        part = lambda n, each: F.when(F.col(n) < each, -1 - F.floor(F.col(f"{n}_before") / each)).otherwise(F.col("lead") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / F.lit(each))))
        led = led.join(F.broadcast(counts), "lead")
        grouped = led.withColumn("g", part("n", candidates_each))
        packs = "ids binary, x binary, width int, high array<long>, low array<long>"
        self.groups = cut(grouped.select("g", "id", "v").groupBy("g").applyInPandas(lambda pdf: pd.DataFrame([_packed(pdf, "g")]), f"g long, {packs}"))
        asked = led.filter("query").groupBy("id").agg(F.min(F.struct("v", "lead", "asked", "asked_before")).alias("q")).select("id", "q.*")
        asked = asked.withColumn("qg", part("asked", queries_each))
        self.queries = cut(asked.select("qg", "id", "v").groupBy("qg").applyInPandas(lambda pdf: pd.DataFrame([_packed(pdf, "qg")]), f"qg long, {packs}")).select("qg", "ids", "x", "width")
        self.chunks = max(1, -(-self.groups.count() // bounds_each))
        self.bounds = self.groups.select("g", "high", "low").withColumn("mc", F.pmod(F.xxhash64("g"), F.lit(self.chunks)))

    def _bounded(self, queries: DataFrame, choose, schema: str) -> DataFrame:
        """choose(key, queries' matrix, groups, bounds, the queries' row) over each group of queries and chunk of the table of bounds."""
        dealt = queries.withColumn("mc", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1)))).withColumn("mc", F.col("mc").cast("long"))

        def run(key: tuple, qs: pd.DataFrame, gs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(gs):
                return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in schema.split(", ")})
            row = qs.iloc[0]
            _, q = _unpacked(row["ids"], row["x"], row["width"])
            return choose(row, gs["g"].to_numpy(), group_bounds(q, _matrix(list(gs["high"])), _matrix(list(gs["low"]))))

        table = self.bounds.join(dealt.select(F.col("qg").alias("h"), F.col("mc").alias("c")), F.col("mc") == F.col("c")).select("h", "c", "g", "high", "low")
        return dealt.groupBy("qg", "mc").cogroup(table.groupBy("h", "c")).applyInPandas(run, schema)

    def first_cells(self) -> DataFrame:
        """qg, g, at: each query (by its place in its group) with the group of its highest bound."""

        def choose(row: pd.Series, g: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
            best = bounds.argmax(axis=1)
            at = np.arange(len(bounds))
            return pd.DataFrame({"qg": row["qg"], "at": at, "g": g[best], "bound": bounds[at, best].astype(np.float64)})

        every = self._bounded(self.queries, choose, "qg long, at int, g long, bound double")
        return cut(every.groupBy("qg", "at").agg(F.max(F.struct("bound", "g")).alias("b")).select("qg", "at", "b.g").groupBy("qg", "g").agg(F.sort_array(F.collect_list("at")).alias("at")))

    def second_cells(self, first: DataFrame, found: DataFrame) -> DataFrame:
        """qg, g, at: each query with the other groups whose bound its k-th score so far does not beat."""
        best = Window.partitionBy("qg", "at").orderBy(F.desc("score"), "vec_id")
        kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == self.k).select("qg", "at", "score")
        told = kth.groupBy("qg").agg(F.collect_list("at").alias("known"), F.collect_list("score").alias("kth"))
        # A list for each group of queries, of an entry for each of its queries at most.
        seen = first.select("qg", "g", F.explode("at").alias("a")).groupBy("qg").agg(F.collect_list(F.struct("a", "g")).alias("seen"))
        queries = self.queries.join(told, "qg", "left").join(seen, "qg", "left").select("*", F.transform("seen", lambda x: x["a"]).alias("seen_at"), F.transform("seen", lambda x: x["g"]).alias("seen_g")).drop("seen")

        def choose(row: pd.Series, g: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
            least = np.full(len(bounds), -(1 << 200), dtype=object)
            if row["known"] is not None:
                least[np.asarray(row["known"])] = [int(s) for s in row["kth"]]
            # A group whose bound equals the k-th score may hold a smaller id of that score.
            visit = (bounds >= least[:, None]).astype(bool)
            held = dict(zip(g.tolist(), range(len(g)), strict=True))
            for a, s in zip(row["seen_at"], row["seen_g"], strict=True):
                if s in held:
                    visit[a, held[s]] = False
            some = np.flatnonzero(visit.any(axis=0))
            at = np.array([" ".join(map(str, np.flatnonzero(visit[:, j]).tolist())) for j in some.tolist()], dtype=object)
            return pd.DataFrame({"qg": np.full(len(some), row["qg"], dtype=np.int64), "g": g[some], "at": pd.Series(at, dtype=object)})

        cells = self._bounded(queries, choose, "qg long, g long, at string")
        return cut(cells.withColumn("at", F.split("at", " ").cast("array<int>")))

    def scored(self, cells: DataFrame) -> DataFrame:
        """qg, at, query_id, vec_id, score: the k best of each query in each of its cells."""
        k = self.k
        left = cells.join(self.queries, "qg").select("qg", "g", "at", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("width").alias("q_width"))
        both = left.join(self.groups.drop("high", "low"), "g")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            row = pdf.iloc[0]
            at = np.asarray(row["at"])
            q_ids, q = _unpacked(row["q_ids"], row["q_x"], row["q_width"])
            ids, scores = search_cell(q_ids[at], q[at], *_unpacked(row["ids"], row["x"], row["width"]), k)
            got = ids >= 0
            best = scores[got]
            if best.dtype == object and any(not -(1 << 63) <= s < 1 << 63 for s in best.tolist()):
                raise OverflowError("a score does not fit a long")
            each = np.repeat(np.arange(len(at)), k)[got.ravel()]
            return pd.DataFrame({"qg": row["qg"], "at": at[each], "query_id": q_ids[at][each], "vec_id": ids[got], "score": best.astype(np.int64)})

        return cut(both.groupBy("qg", "g").applyInPandas(run, "qg long, at int, query_id long, vec_id long, score long"))


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    candidates_each: int = 8192,
    queries_each: int = 2048,
    bounds_each: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest inner product for every query row, ties to the smaller id.

    Fewer rows if there are fewer candidates. Vectors that are null, empty or hold a null or a number
    that is not finite take no part, nor do rows without an id. Rows of the query's own id are no
    candidates of it; an id that repeats among queries is one query (its least vector). Vectors of different lengths are
    compared over the components that both have. An empty table gives no rows; other columns are not read. Scores are exact whatever the
    components are; one that does not fit a long raises an error if it is among a query's k highest.
    """
    rows = cut(
        vectors.select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query")).filter(
            "id is not null and v is not null"
        )
    )
    if rows.filter("query").isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    search = Search(rows, k, candidates_each, queries_each, bounds_each)
    first = search.first_cells()
    found = search.scored(first)
    found = found.unionByName(search.scored(search.second_cells(first, found)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


__all__ = ["Search", "exact_top_k", "integer_vector", "search_cell"]

"""Operator 5, language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers how far the longest match goes. A text's
letters, in lower case, with one space for whatever stands between words, are parsed greedily in one run
into phrases: each the longest stretch that the language's sample holds, over word borders too, or a single
character that it does not hold. A phrase costs the bits that point into the sample; a character that the
sample lacks costs those of the largest sample, so that no sample wins by being small. The language of the
fewest bits wins.

The automata are tables (state x character), through which many texts advance together: dense for a language's most frequent
characters, sorted moves for its others, so that scripts of thousands of characters are known in full.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, give_back, held, seeded_key
from .word_tables import slices

#: The bound of the training sample: so many characters and documents of each language.
SAMPLE_CHARS = 50_000
SAMPLE_DOCS = 400
#: Labels that a training sample may have: each sends its sample to the driver.
LABELS = 2_000
#: A language's most frequent characters, which have a column of their own in its table; moves on other characters are searched for.
COLUMNS = 254
#: Characters of texts that are parsed together in a task.
TOGETHER = 3_000_000
#: Texts that are worth a step together; the last and longest ones go on one by one.
FEW = 48
#: A prediction must save this share of the second-best parse's bits for a document to be in a known language.
LEAST_SCORE = 0.02
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def normalised(text: str | None) -> np.ndarray:
    """The code points of the text's words in lower case between single spaces; nothing if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _letters()[codes]
    if not inside.any():
        return codes[:0]
    codes = np.concatenate([[32], np.where(inside, codes, 32), [32]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


class SuffixAutomaton:
    """All stretches of one text: moves[state] has the state after each character."""

    def __init__(self, text: str):
        moves: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and c not in moves[at]:
                moves[at][c] = new
                at = link[at]
            if at >= 0:
                to = moves[at][c]
                if length[at] + 1 == length[to]:
                    link[new] = to
                else:
                    twin = len(moves)
                    moves.append(dict(moves[to]))
                    link.append(link[to])
                    length.append(length[at] + 1)
                    link[to] = link[new] = twin
                    while at >= 0 and moves[at].get(c) == to:
                        moves[at][c] = twin
                        at = link[at]
            last = new
        self.moves, self.size = moves, len(text)


class ParseTable:
    """A language's automaton as a table. An entry is twice the place of the next state's row, plus one where a phrase starts: at the
    root, where no longer match goes on, and at a character that the sample lacks, which leads to the root. Symbols are the columns, then
    the one of what the sample lacks, then the rarer characters, whose moves are sorted by (state, character)."""

    def __init__(self, text: str, columns: int = COLUMNS):
        automaton = SuffixAutomaton(text)
        every = [c for c, _ in sorted(Counter(text).items(), key=lambda x: (-x[1], x[0]))]
        known, rare = sorted(every[:columns]), sorted(every[columns:])
        self.size, self.width, self.rare = automaton.size, len(known) + 1, len(rare)
        number = {c: i for i, c in enumerate(known)} | {c: self.width + i for i, c in enumerate(rare)}
        #: The number of each code point; that after the columns for those that the sample lacks.
        self.numbers = np.full(sys.maxunicode + 1, len(known), dtype=np.min_scalar_type(self.width + len(rare)))
        self.numbers[[ord(c) for c in number]] = list(number.values())
        start = np.ones(self.width + len(rare), dtype=np.int64)
        for c, to in automaton.moves[0].items():
            start[number[c]] = to * self.width * 2 + 1
        table = np.tile(start[: self.width], (len(automaton.moves), 1))
        edges = np.array([(s, number[c], to) for s, m in enumerate(automaton.moves) if s for c, to in m.items()], dtype=np.int64).reshape(-1, 3)
        dense = edges[:, 1] < self.width
        table[edges[dense, 0], edges[dense, 1]] = edges[dense, 2] * self.width * 2
        self.table = table.reshape(-1).astype(np.int32 if table.size < 1 << 30 else np.int64)
        # Rarer characters: a phrase starts where no move is found.
        self.start = start[self.width :]
        keys = edges[~dense, 0] * max(1, len(rare)) + edges[~dense, 1] - self.width
        order = np.argsort(keys)
        self.keys, self.moves = keys[order], edges[~dense, 2][order] * self.width * 2

    def _searched(self, entries: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The entries after rarer characters."""
        which = symbols.astype(np.int64) - self.width
        key = (entries.astype(np.int64) >> 1) // self.width * self.rare + which
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        found = self.keys[at] == key if len(self.keys) else np.zeros(len(key), dtype=bool)
        return np.where(found, self.moves[at] if len(self.keys) else 0, self.start[which])

    def phrases(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases, of which characters that are not known) of the texts codes[starts[i] : starts[i] + lengths[i]], longest first."""
        symbols, table, n, width = self.numbers[codes], self.table, len(starts), self.width
        unknown = np.concatenate([[0], np.cumsum(symbols == width - 1, dtype=np.int32 if len(symbols) < 1 << 31 else np.int64)])
        literals = unknown[starts + lengths] - unknown[starts]
        entry, count, at, one = np.zeros(n, dtype=table.dtype), np.zeros(n, dtype=np.int64), starts.copy(), np.empty(n, dtype=table.dtype)
        active = n - np.searchsorted(lengths[::-1], np.arange(int(lengths.max(initial=0))), side="right")
        step, searching = 0, bool(self.rare) and bool((symbols >= width).any())
        for m in active.tolist():
            if m < FEW:
                break
            e, p = entry[:m], at[:m]
            s = symbols.take(p)
            if searching and len(far := np.flatnonzero(s >= width)):
                after = self._searched(e[far], s[far])
                s[far] = 0
                table.take((e >> 1) + s, out=e, mode="clip")
                e[far] = after
            else:
                table.take((e >> 1) + s, out=e, mode="clip")
            np.bitwise_and(e, 1, out=one[:m])
            count[:m] += one[:m]
            p += 1
            step += 1
        flat = memoryview(table)
        rare = dict(zip(self.keys.tolist(), self.moves.tolist(), strict=True)) if searching else {}
        for i in range(int(np.count_nonzero(lengths > step))):
            e, more, rest = int(entry[i]), 0, symbols[starts[i] + step : starts[i] + lengths[i]]
            if not searching:
                for s in rest.tobytes() if rest.itemsize == 1 else rest.tolist():
                    e = flat[(e >> 1) + s]
                    more += e & 1
            else:
                for s in rest.tolist():
                    e = flat[(e >> 1) + s] if s < width else rare.get((e >> 1) // width * self.rare + s - width, int(self.start[s - width]))
                    more += e & 1
            count[i] += more
        return count, literals


class CrossParser:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.tables = [ParseTable(samples[k]) for k in self.langs]
        #: Bits of a phrase, by language; of a character that a sample lacks.
        self.bits = np.array([math.log2(max(2, t.size)) for t in self.tables])
        self.literal = float(self.bits.max(initial=1.0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, scores): the score is the share of the second-best parse's bits that the best one saves."""
        codes = [normalised(t) for t in texts]
        lengths = np.array([len(c) for c in codes], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        every = np.concatenate([*codes, np.empty(0, dtype=np.uint32)])
        del codes
        cost = np.zeros((len(texts), len(self.tables)))
        for k, table in enumerate(self.tables):
            count, literals = table.phrases(every, starts[order], lengths[order])
            cost[order, k] = (count - literals) * self.bits[k] + literals * self.literal
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = cost.argmin(axis=1)
        if len(self.langs) == 1:
            score = np.ones(len(texts))
        else:
            two = np.partition(cost, 1, axis=1)[:, :2]
            score = 1.0 - two[:, 0] / np.where(two[:, 1] > 0, two[:, 1], 1.0)
        none = lengths == 0
        score[none] = 0.0
        return [UNKNOWN if x else self.langs[b] for b, x in zip(best.tolist(), none.tolist(), strict=True)], score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_samples(docs: DataFrame, *, chars: int = SAMPLE_CHARS, docs_each: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Language -> sample text, from labelled documents that are not held out.

    The sample holds up to docs_each documents of a language, in the order of a seeded hash, up to chars
    characters of words; that bound, times LABELS, is what reaches the driver: more labels raise an error. Rare languages
    give all they have. Repeated rows count as often as they are there; null texts, those without letters and null labels take no
    part; an empty table, or one without labels, gives no samples.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))
    )
    sizes = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if sizes.count() > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    place = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(16**12)
    # A fixed share of the hash values: about twice docs_each documents, of which the first are taken.
    few = (
        rows.withColumn("key", seeded_key("lang-1", "doc_id"))
        .join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang")
        .filter(place * F.col("n") < 2.0 * docs_each)
    )
    order = Window.partitionBy("lang").orderBy("key", "doc_id", "text")
    letters = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "))
    taken = (
        few.select("lang", "key", "doc_id", F.substring(letters, 1, chars).alias("text"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= docs_each)
        .withColumn("before", F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .filter(F.col("before") < chars)
        .groupBy("lang")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("text"))
    )
    return {r["lang"]: f" {r['text'][:chars]} " for r in taken.collect()}


def predicted(text: Column, samples: dict[str, str], spark) -> Column:
    """A struct of lang and score for each whole text."""
    shipped = spark.sparkContext.broadcast(samples)
    key = hash(tuple(sorted(samples.items())))

    @F.pandas_udf("lang string, score double")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = held(("cross-parser", key), lambda: CrossParser(shipped.value))
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            found = [parser.predict(texts[part]) for part in slices([t or "" for t in texts], TOGETHER)]
            yield pd.DataFrame({"lang": [x for langs, _ in found for x in langs], "score": np.concatenate([*(scores for _, scores in found), np.empty(0)])})
            give_back()

    # Not to be computed again for a filter on it: Spark repeats deterministic functions.
    return parse.asNondeterministic()(text)


def identify_languages(docs: DataFrame, samples: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Whole texts are parsed. lang_pred is `und`, score 0, for a null text, one without letters, and if
    there are no samples. With one language its score is 1. Of equal costs the language first by name
    wins, score 0. Equal rows stay rows of their own; an empty table gives no rows; other columns are
    not read. The samples (bounded by training_samples) are broadcast.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), predicted(F.col(text_col), samples, docs.sparkSession).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def in_known_language(
    docs: DataFrame,
    samples: dict[str, str],
    *,
    languages: Collection[str] | None = None,
    least_score: float = LEAST_SCORE,
    text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """The documents whose predicted language is one of `languages` (of the samples', if None) with at least that score.

    All columns stay as they are, whatever their names, but a null lang_col (if one is named) takes the prediction.
    `und` goes: null texts, texts without letters, and all documents if there are no samples. Every
    row is judged by its own text, so repeated rows stay or go together; an empty table gives no rows.
    """
    name = fresh("found", docs)
    found = docs.withColumn(name, predicted(F.col(text_col), samples, docs.sparkSession))
    wanted = F.col(f"{name}.lang") != UNKNOWN if languages is None else F.col(f"{name}.lang").isin(*languages)
    kept = found.filter(wanted & (F.col(f"{name}.score") >= least_score))
    return kept.select(*[F.coalesce(F.col(f"`{c}`"), F.col(f"{name}.lang")).alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])

"""Operator 2, token counts by a compiled finite-state tokenizer.

The BPE of a model file is compiled into a deterministic transducer over characters. A state says, for
every place in the text from which some piece may still run on, which piece ended there and how many
tokens there were up to it; a transition carries the net number of tokens emitted: how many more the
encoding of the longer prefix has. Summed along a path, the annotations are the token count. States
are made when first reached, so only what the texts hold is compiled.

A text is cut into chunks. A chunk that starts where no piece can reach across has one start state, so
its state map is a constant and the composition of such maps is a plain sum. Chunks inside a very long
word have a map of the states that can precede them; the maps are composed by a prefix scan.

A huge text is cut into chunks that are dealt over tasks. Each task maps the state that should precede its chunk, told from the text just before, to
the state at its end. Where a chunk starts with the state that the one before it ends with, the maps compose and tokens add up; chunks that started
with another one are mapped again from the right one, all at once, until every chunk fits the one before it.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, cut, held
from .pieces import EDGE, WORD_MARK, PieceModel, load, shipped

#: Longer words are cut into chunks of so many characters.
CHUNK = 4096
#: What a Python process keeps: distinct words with their counts, and states.
KEPT_WORDS = 400_000
KEPT_STATES = 400_000

#: Characters of a text that is cut over tasks, and of its chunks.
HUGE = 4_000_000
HUGE_CHUNK = 1_000_000

#: start state -> (end state, tokens)
StateMap = dict[int, tuple[int, int]]


class Transducer:
    def __init__(self, model: PieceModel):
        if not model.is_bpe or not model.byte_fallback:
            raise ValueError("token counts are compiled from BPE models with byte fallback")
        self.model = model
        # The tree of pieces: node -> {character: node}, node -> piece id or None.
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[int | None] = [None]
        for p, i in model.spelled.items():
            at = 0
            for c in p:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.piece.append(None)
                at = self.children[at][c]
            self.piece[at] = i
        self._follow: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, EDGE, 0),)
        self.number: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _can_follow(self, left: int, right: int) -> bool:
        if (ok := self._follow.get((left, right))) is None:
            if len(self._follow) > 2_000_000:
                self._follow.clear()
            ok = self._follow[left, right] = self.model.can_follow(left, right)
        return ok

    def step(self, state: int, char: str) -> tuple[int, int]:
        """(next state, net tokens), added to the transitions."""
        here = None
        going = []
        for node, last, count in self.states[state]:
            if (to := self.children[node].get(char)) is None:
                continue
            piece = self.piece[to]
            if piece is not None and here is None and self._can_follow(last, piece):
                here = piece, count + 1
            if self.children[to]:
                going.append((to, last, count))
        if here is None:  # no piece spells it: its bytes, and nothing reaches across
            return 0, len(self.model.fallback(char))
        piece, net = here
        key = (*((node, last, count - net) for node, last, count in going), (0, piece, 0))
        if (n := self.number.get(key)) is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][char] = n, net
        return n, net

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        moves, step, tokens = self.moves, self.step, 0
        for c in text:
            state, net = moves[state].get(c) or step(state, c)
            tokens += net
        return state, tokens

    def name(self, state: int) -> str:
        """A state in words that every process understands."""
        return json.dumps(self.states[state])

    def state(self, name: str) -> int:
        key = tuple(map(tuple, json.loads(name)))
        if (n := self.number.get(key)) is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return n

    def state_map(self, chunk: str, starts: set[int]) -> StateMap:
        return {s: self.run(chunk, s) for s in starts}

    def scan(self, chunks: list[str]) -> StateMap:
        """The map of all chunks together, from the start state, as a prefix scan over the chunks' maps.

        The states that can precede a chunk are guessed from the text before it: after as many
        characters as the longest piece has, the path from the start state has nearly always met the
        true one. Where the maps do not meet, the chunk's map gets the missing state.
        """
        back = 4 * self.model.longest
        maps = [self.state_map(c, {0} if i == 0 else {self.run(chunks[i - 1][-back:])[0]}) for i, c in enumerate(chunks)]
        spans = [(m, i, i + 1) for i, m in enumerate(maps)]
        while len(spans) > 1:
            merged = []
            for k in range(0, len(spans) - 1, 2):
                (left, a, b), (right, _, d) = spans[k], spans[k + 1]
                both: StateMap = {}
                for s, (mid, n) in left.items():
                    if mid not in right:  # a wrong guess
                        state, extra = mid, 0
                        for c in chunks[b:d]:
                            state, more = self.run(c, state)
                            extra += more
                        right[mid] = state, extra
                    end, more = right[mid]
                    both[s] = end, n + more
                merged.append((both, a, d))
            spans = [*merged, *([spans[-1]] if len(spans) % 2 else [])]
        return spans[0][0]

    def count(self, word: str) -> int:
        if len(word) <= CHUNK:
            return self.run(word)[1]
        return self.scan([word[i : i + CHUNK] for i in range(0, len(word), CHUNK)])[0][1]


class SegmentCounts(Recent):
    def __init__(self, transducer: Transducer):
        super().__init__(KEPT_WORDS)
        self.make = transducer.count


class Counts(Recent):
    """word -> tokens; a new word is counted by the segments between which no piece reaches across."""

    def __init__(self, transducer: Transducer):
        super().__init__(KEPT_WORDS)
        self.transducer = transducer
        self.segments = SegmentCounts(transducer)

    def make(self, word: str) -> int:
        return sum(map(self.segments.__getitem__, self.transducer.model.segments(word)))

    def text(self, text: str | None) -> int:
        model = self.transducer.model
        n = sum(map(self.__getitem__, model.words(model.normalised(text))))
        self.trim()
        self.segments.trim()
        if len(self.transducer.states) > KEPT_STATES:
            self.transducer.reset()
        return n


def counts(data: bytes) -> Counts:
    return held(("counts", hashlib.sha256(data).digest()), lambda: Counts(Transducer(load(data))))


def _mapped(chunks: DataFrame, data) -> DataFrame:
    """row, no, start, end, tokens of chunks (row, no, before, chunk, start): from the state `start`, or if it is null from the one that the
    text before the chunk leads to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transducer = counts(data.value).transducer
        model = transducer.model
        for batch in batches:
            out = []
            for row, no, before, chunk, start in batch.itertuples(index=False, name=None):
                before, chunk = (x.replace(WORD_MARK, " ") for x in (before, chunk))
                if no == 0 and model.dummy_prefix:
                    chunk = " " + chunk
                state = transducer.run(before)[0] if start is None else transducer.state(start)
                name = transducer.name(state)
                end, tokens = transducer.run(chunk, state)
                out.append((row, no, name, transducer.name(end), tokens))
                if len(transducer.states) > KEPT_STATES:
                    transducer.reset()
            yield pd.DataFrame(out, columns=["row", "no", "start", "end", "tokens"])

    return chunks.select("row", "no", "before", "chunk", "start").mapInPandas(run, "row long, no int, start string, end string, tokens long")


def huge_counts(texts: DataFrame, data, chunk: int = HUGE_CHUNK, back: int = 256) -> DataFrame:
    """row, n_tokens of texts (row, text) by chunks over tasks."""
    size = F.length("text")
    cuts = texts.select("row", "text", F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(chunk))).alias("at"))
    chunks = cuts.select(
        "row",
        (F.col("at") / chunk).cast("int").alias("no"),
        F.substring("text", F.greatest(F.col("at") - back, F.lit(0)) + 1, F.least(F.col("at"), F.lit(back))).alias("before"),
        F.substring("text", F.col("at") + 1, F.lit(chunk)).alias("chunk"),
        F.lit(None).cast("string").alias("start"),
    )
    chunks = cut(chunks.repartition(F.col("row"), F.col("no")))
    done = cut(_mapped(chunks, data))
    in_order = Window.partitionBy("row").orderBy("no")
    while True:
        joined = done.withColumn("was", F.lag("end").over(in_order))
        wrong = cut(joined.filter(F.col("was").isNotNull() & (F.col("was") != F.col("start"))).select("row", "no", F.col("was").alias("start")))
        if wrong.isEmpty():
            return done.groupBy("row").agg(F.sum("tokens").alias("n_tokens"))
        again = _mapped(chunks.drop("start").join(wrong, ["row", "no"]), data)
        done = cut(done.join(wrong.select("row", "no"), ["row", "no"], "left_anti").unionByName(again))


def token_counts(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, huge_chunk: int = HUGE_CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    The counts are the library's, without begin or end token, over whole texts. A null text counts as
    empty: 0 bytes, 0 tokens. over_limit is n_tokens > limit. Equal rows stay rows of their own; an
    empty table gives no rows; other columns are not read. Words may be of any length. Texts of `huge` characters or more
    are counted by chunks over tasks, unless the model squeezes white space, which does not go by chunks.
    """
    data = shipped(docs.sparkSession, model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counts(data.value)
        gc.disable()  # the tables hold millions of small objects and no cycles
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            n = [table.text(t) for t in texts]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].to_numpy(),
                    "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                    "n_tokens": n,
                    "over_limit": [x > limit for x in n],
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    if load(data.value).squeeze:
        return named.mapInPandas(run, schema)
    long = named.filter(F.length("text") >= huge)
    found = named.filter(F.coalesce(F.length("text") < huge, F.lit(True))).mapInPandas(run, schema)
    if long.isEmpty():
        return found
    rows = cut(long.withColumn("row", F.monotonically_increasing_id()))
    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "row").join(huge_counts(rows.select("row", "text"), data, huge_chunk), "row")
    return found.unionByName(counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))

"""Operator 13, alignment of two tokenizers, with pair counts over the corpus by external spill counting.

Tokens of A (byte-level) and B (pieces) are laid over the bytes of space + text. Texts are cut into stretches at places
that no token of either reaches across; a distinct stretch is tokenized and aligned once. The (B id, A id, document) records of a slice
of texts are radix-partitioned by B id, sorted with B first, and spilled as zstd runs, a table in the shared folder. The runs of a partition (in
lanes, if they are many, so that a frequent B id is no hot key) go through a k-way heap merge that counts each pair. A partition's
pairs in the order of B then yield each B id's maximum, and while the runs are streamed once more, each gives its documents what their
links count. Slices of documents add up what the partitions gave back.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .common import Recent, cut, give_back, held
from .pieces import WORD_MARK, load, shipped
from .token_files import _RARE, CUT, LibraryIds
from .word_tables import slices, split_at

#: Characters of texts whose records are sorted together, and stretches laid out at once.
TEXTS = 3_000_000
WINDOW = 1_000_000
#: Parts that B ids are dealt to. Each gives every slice of documents one row back, so they do not grow with the corpus; lanes do.
PARTS = 32
#: Records of a lane, at about two bytes each.
LANE = 20_000_000
#: Distinct stretches that a Python process keeps.
KEPT = 120_000
#: Stretches that a tokenizer gets in one text, a line each.
LINES = 256
LEVEL = 3


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: a byte that prints is its own letter, the others are numbered from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in prints)
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class Stretch(NamedTuple):
    """What a stretch of text adds to a document: counts, its groups as text, its links as B id << 32 | A id. sound: both spell it."""

    n_a: int
    n_b: int
    n_groups: int
    sound: bool
    groups: bytes
    links: bytes


UNSOUND = Stretch(0, 0, 0, False, b"", b"")


class Aligner:
    """Both tokenizers over stretches of space + text; keeps those that it has met (a bounded number)."""

    def __init__(self, a: bytes, b: bytes):
        spec = json.loads(a)
        self.library = LibraryIds(a, "<u4")
        self.library.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.library.special = []
        letters = byte_letters()
        added = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = self.library.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        self.model = load(b)
        self.b_bytes = self.model.surface
        self.pieces = SentencePieceProcessor(model_proto=b)
        self.a_length, self.b_length = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (list(map(str, range(len(x)))) for x in (self.a_bytes, self.b_bytes))
        self.known = Recent(KEPT)
        inner = self.model._inner
        # Where B's pieces allow it, a line break is a stretch of its own, and a closing mark starts one behind a letter; a space does in any case.
        line = self.pieces.encode("\n")
        self.line = line[-1] if len(line) == 2 and self.model.dummy_prefix and not any("\n" in pair for pair in inner) else None
        self.cuts = [(rf"([^\s])({' ' if self.line is None else r'[ \n]'})", rf"\1{CUT}\2")]
        if self.line is not None:
            self.cuts.append((f"{CUT}\n([^\\s{CUT}])", f"{CUT}\n{CUT}\\1"))
            marks = "".join(c for c in ".,;:!?" if not any(x.isalpha() and y == c for x, y in inner))
            if marks:
                self.cuts.append((rf"(\pL)([{marks}])", rf"\1{CUT}\2"))

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(where each text's stretches start and the last one's end, the number of each stretch, the distinct stretches) of space + text."""
        found = pa.array([" " + t for t in texts], pa.string())
        if self.library.cuts and self.model.by_word:
            odd = pc.match_substring_regex(found, f"[{CUT}{_RARE}]")
            marked = found
            for pattern, into in self.cuts:
                marked = pc.replace_substring_regex(marked, pattern, into)
            if not pc.any(odd).as_py():
                return split_at(marked, CUT)
            found, odd = pc.if_else(odd, found, marked), odd.to_pylist()
        else:
            odd = [True] * len(texts)
        place: dict[str, int] = {}
        parts = [[t] if o else t.split(CUT) for t, o in zip(found.to_pylist(), odd, strict=True)]
        numbers = np.array([place.setdefault(w, len(place)) for p in parts for w in p], dtype=np.int64)
        return np.cumsum([0, *map(len, parts)]), numbers, list(place)

    def _b_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(B's ids of these stretches, where each one's start and the last one's end). B puts a space in front of the first character of what it is
        asked for. Stretches without line breaks are asked for in lines, whose breaks' own id tells them apart."""
        if self.line is None:  # then all stretches start with a space
            every = [np.array(x, dtype=np.int64) for x in self.pieces.encode([w[1:] for w in words], num_threads=1)]
        elif any("\n" in w for w in words):
            every = [np.array(x[2:], dtype=np.int64) for x in self.pieces.encode(["\n" + w for w in words], num_threads=1)]
        else:
            groups = [words[i : i + LINES] for i in range(0, len(words), LINES)]
            ids = np.concatenate([np.array(x, dtype=np.int64)[1:] for x in self.pieces.encode(["\n" + "\n".join(g) for g in groups], num_threads=1)])
            breaks = ids == self.line
            return ids[~breaks], np.append(np.cumsum(~breaks)[breaks], int((~breaks).sum()))
        return np.concatenate(every), np.cumsum([0, *map(len, every)])

    def _a_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.library._values(words)
        return np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64), np.cumsum([0, *(len(x) // 4 for x in ids)])

    def _align(self, words: list[str]) -> list[Stretch]:
        """Both tokenizations of these distinct stretches side by side."""
        raw = [w.encode() for w in words]
        sizes, whole = list(map(len, raw)), b"".join(raw)
        every, sound = [], np.ones(len(words), dtype=bool)
        for (flat, border), spelled, length in ((self._a_ids(words), self.a_bytes, self.a_length), (self._b_ids(words), self.b_bytes, self.b_length)):
            ends = np.cumsum(length[flat])
            if b"".join(map(spelled.__getitem__, flat.tolist())) != whole or np.diff(np.concatenate([[0], ends])[border]).tolist() != sizes:
                pieces = list(map(spelled.__getitem__, flat.tolist()))
                sound &= [b"".join(pieces[x:y]) == r for x, y, r in zip(border[:-1].tolist(), border[1:].tolist(), raw, strict=True)]
            every.append((flat, ends, border))
        if not sound.all():
            rest = [w for w, ok in zip(words, sound.tolist(), strict=True) if ok]
            good = iter(self._align(rest) if rest else ())
            return [next(good) if ok else UNSOUND for ok in sound.tolist()]
        (a, a_end, a_border), (b, b_end, b_border) = every
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        first = np.searchsorted(b_end, np.concatenate([[0], a_end[:-1]]), side="right")
        last = np.searchsorted(b_end, a_end, side="left")  # the one that holds A's last byte
        times = last - first + 1
        at = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        links = (b[at] << 32 | np.repeat(a, times)).astype("<i8").tobytes()
        link_border = np.concatenate([[0], np.cumsum(times)])[a_border].tolist()
        # A comma between ids, a bar or semicolon where a group of A or B ends.
        groups_a, groups_b = (_joined(list(map(names.__getitem__, ids.tolist())), np.searchsorted(end, both)) for names, ids, end in ((self.a_names, a, a_end), (self.b_names, b, b_end)))
        group = np.searchsorted(both, np.concatenate([[0], a_end])[a_border], side="right").tolist()
        texts = [f"{x}|{y}" for x, y in zip(groups_a, groups_b, strict=True)]
        ab, bb = a_border.tolist(), b_border.tolist()
        return [
            Stretch(ab[i + 1] - ab[i], bb[i + 1] - bb[i], group[i + 1] - group[i], True, ";".join(texts[group[i] : group[i + 1]]).encode(), links[8 * link_border[i] : 8 * link_border[i + 1]])
            for i in range(len(words))
        ]

    def look_up(self, words: list[str]) -> list[Stretch]:
        values, gaps = self.known.with_gaps(words)
        new = [words[k] for k in gaps if words[k] not in self.known.old]
        for part in ([w for w in new if "\n" not in w], [w for w in new if "\n" in w]):
            if part:
                self.known.update(zip(part, self._align(part), strict=True))
        for k in gaps:
            values[k] = self.known[words[k]]
        self.known.trim()
        return values

    def readable(self, text: str | None) -> bool:
        return bool(text) and WORD_MARK not in text and self.model.normalised(text) == " " + text


def _joined(text: list[str], last: np.ndarray) -> list[str]:
    """The ids of each group, whose last token's place is given, with commas between them."""
    return [text[i] if i == j else ",".join(text[i : j + 1]) for i, j in zip([0, *(last[:-1] + 1).tolist()], last.tolist(), strict=True)]


def _aligner(a: bytes, b: bytes) -> Aligner:
    return held(("aligner", hash(a), hash(b)), lambda: Aligner(a, b))


# -- runs --------------------------------------------------------------------------------------


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8")


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, each as narrow as it can be, in one zstd frame."""
    narrow = [_small(c) for c in columns]
    head = np.array([len(narrow), *chain.from_iterable((len(c), c.itemsize) for c in narrow)], dtype="<i8").tobytes()
    raw = head + b"".join(c.tobytes() for c in narrow)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    shape, at, out = np.frombuffer(raw, dtype="<i8", count=2 * n, offset=8).reshape(n, 2).tolist(), 8 + 16 * n, []
    for count, size in shape:
        out.append(np.frombuffer(raw, dtype={1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[size], count=count, offset=at).astype(np.int64))
        at += count * size
    return out


def _pairs_packed(codes: np.ndarray, *more: np.ndarray) -> bytes:
    return _packed(codes >> 32, codes & 0xFFFFFFFF, *more)


def _pairs_unpacked(blob: bytes) -> list[np.ndarray]:
    b, a, *more = _unpacked(blob)
    return [b << 32 | a, *more]


def runs(words: list[Stretch], numbers: np.ndarray, doc: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(part, records, pairs with their counts here, documents of each pair) of the links of a window of stretches, dealt by B id and
    sorted with B first. numbers: which stretch; doc: whose."""
    sizes = np.fromiter((len(w.links) // 8 for w in words), dtype=np.int64, count=len(words))
    codes, which = np.unique(np.frombuffer(b"".join(w.links for w in words), dtype="<i8"), return_inverse=True)
    if not len(codes):
        return
    starts, length = np.cumsum(sizes) - sizes, sizes[numbers]
    at = np.repeat(starts[numbers] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    width = int(doc.max(initial=0)) + 1
    keys, times = np.unique(which[at] * width + np.repeat(doc, length), return_counts=True)
    pair, owner = keys // width, keys % width
    part = (codes >> 32) % parts
    for p in range(parts):
        mine = part[pair] == p
        if mine.any():
            here, back, n = np.unique(pair[mine], return_inverse=True, return_counts=True)
            o, t = owner[mine], times[mine]
            step = np.diff(o, prepend=0)
            first = np.cumsum(n) - n
            step[first] = o[first]
            yield p, len(o), _pairs_packed(codes[here], np.add.reduceat(t, first), n), _packed(step, t)


def counted(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs in the order of B, count of each) by a heap merge of sorted runs."""
    codes: list[int] = []
    counts: list[int] = []
    last = -1
    for code, n in heapq.merge(*(_entries(b) for b in blobs)):
        if code == last:
            counts[-1] += n
        else:
            codes.append(code)
            counts.append(n)
            last = code
    return np.array(codes, dtype=np.int64), np.array(counts, dtype=np.int64)


def _entries(blob: bytes) -> Iterator[tuple[int, int]]:
    code, n, _ = _pairs_unpacked(blob)
    for i in range(0, len(code), 4096):
        yield from zip(code[i : i + 4096].tolist(), n[i : i + 4096].tolist(), strict=True)


def contributions(pairs: bytes, documents: bytes, codes: np.ndarray, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents of a run, their links whose count is the B id's highest, the sum of their links' counts)."""
    code, _, n = _pairs_unpacked(pairs)
    step, times = _unpacked(documents)
    first = np.cumsum(n) - n
    upto = np.cumsum(step)
    owner = upto - np.repeat(upto[first] - step[first], n)
    at = np.repeat(np.searchsorted(codes, code), n)
    size = int(owner.max(initial=0)) + 1
    n_best, count_sum = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    np.add.at(n_best, owner, times * best[at])
    np.add.at(count_sum, owner, times * counts[at])
    return np.flatnonzero(count_sum), n_best[count_sum > 0], count_sum[count_sum > 0]


# -- Spark -------------------------------------------------------------------------------------


def _spilled(named: DataFrame, a_data, b_data, parts: int, texts_each: int, window: int) -> DataFrame:
    """part, slice, records, pairs, documents: runs; under part -1 the documents of a slice, as an Arrow stream."""

    def spill(aligner: Aligner, ids: pa.Array, texts: list[str | None], name: int) -> Iterator[tuple]:
        full = [i for i, t in enumerate(texts) if aligner.readable(t)]
        offsets, numbers, words = aligner.stretches([texts[i] for i in full])
        found = aligner.look_up(words)
        sound = np.fromiter((w.sound for w in found), dtype=bool, count=len(found))
        if not sound.all():  # a text that a tokenizer does not spell has no tokens
            good = np.logical_and.reduceat(sound[numbers], offsets[:-1]).tolist()
            full = [i for i, g in zip(full, good, strict=True) if g]
            offsets, numbers, words = aligner.stretches([texts[i] for i in full])
            found = aligner.look_up(words)
        counts, digests = np.zeros((4, len(texts)), dtype=np.int64), [""] * len(texts)
        if full:
            for k, each in enumerate(zip(*((w.n_a, w.n_b, w.n_groups, len(w.links) // 8) for w in found), strict=True)):
                counts[k, full] = np.add.reduceat(np.array(each, dtype=np.int64)[numbers], offsets[:-1])
            groups = [w.groups for w in found]
            for i, x, y in zip(full, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                digest = hashlib.sha256()
                for z in range(x, y, window):
                    digest.update((b";" if z > x else b"") + b";".join(map(groups.__getitem__, numbers[z : min(y, z + window)].tolist())))
                digests[i] = digest.hexdigest()
            doc = np.repeat(np.array(full, dtype=np.int64), np.diff(offsets))
            for z in range(0, len(numbers), window):
                for p, n, pairs, documents in runs(found, numbers[z : z + window], doc[z : z + window], parts):
                    yield p, name, n, pairs, documents
        table = pa.table([ids, *map(pa.array, counts), pa.array(digests, pa.string())], names=["doc_id", *COUNTS, "groups_sha256"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        yield -1, name, len(texts), b"", sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_data.value, b_data.value)
        task, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            every = batch.column("text").to_pylist()
            for part_of in slices([t or "" for t in every], texts_each):
                rows = list(spill(aligner, batch.column("doc_id")[part_of.start : part_of.stop], every[part_of], task | number))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "slice", "records", "pairs", "documents"])
                number += 1
            give_back()

    return cut(named.mapInArrow(run, "part int, slice long, records long, pairs binary, documents binary"))


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    codes, counts = counted(rows["pairs"].tolist())
    give_back()
    return pd.DataFrame({"part": rows["part"].iloc[0], "code": codes, "n": counts})


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """A part's pairs in the order of B: their counts, and whether a count is its B id's highest."""
    rows = rows.sort_values("code")
    code, n = rows["code"].to_numpy(), rows["n"].to_numpy()
    first = np.flatnonzero(np.diff(code >> 32, prepend=-1))
    top = np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(n)))
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "table": [_pairs_packed(code, n, (n == top).astype(np.int64))]})


def _give(key: tuple, rows: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
    codes, counts, best = _pairs_unpacked(tables["table"].iloc[0])
    given = [_packed(*contributions(p, d, codes, counts, best)) for p, d in zip(rows["pairs"], rows["documents"], strict=True)]
    give_back()
    return pd.DataFrame({"slice": rows["slice"].to_numpy(), "given": given})


def _told(documents: pa.Table, given: pa.Table) -> pa.Table:
    """The documents of a slice with what the parts gave back."""
    out = pa.ipc.open_stream(documents.column("documents")[0].as_py()).read_all()
    n_best, count_sum = np.zeros(len(out), dtype=np.int64), np.zeros(len(out), dtype=np.int64)
    for blob in given.column("given"):
        owner, best, total = _unpacked(blob.as_py())
        n_best[owner] += best
        count_sum[owner] += total
    place = out.column_names.index("groups_sha256")
    return out.add_column(place, "n_best", pa.array(n_best)).add_column(place + 1, "count_sum", pa.array(count_sum))


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, lane: int = LANE, texts_each: int = TEXTS, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A's tokens are those of space + text, B's those of the text, to which B puts a space in front; without special tokens, whose strings in a text are plain
    text. Offsets at which tokens of both end cut them into groups. A link is a pair of tokens whose byte ranges overlap; the count of a pair of ids is
    how many links of all documents hold it; n_best are a document's links whose count is the highest of their B id,
    ties included; count_sum is the sum over its links. groups_sha256 is of `a,a|b;a|b,b` in decimal ids. Texts that are null or empty, or
    that one of the two does not spell byte for byte (one with U+2581, for B), have no tokens: zeros, and '' for the digest. Rows of one id or
    of none stay rows of their own and all count. An empty table gives no rows; other columns are not read. A text of any length is aligned
    whole.
    """
    a_data, b_data = (shipped(docs.sparkSession, p) for p in (a_path, b_path))
    kind = docs.schema[id_col].dataType.simpleString()
    spilled = _spilled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), a_data, b_data, parts, texts_each, window)
    # A row per part: how many lanes its records ask for.
    records = dict(spilled.filter("part >= 0").groupBy("part").agg(F.sum("records")).collect())
    lanes = F.get(F.array(*[F.lit(-(-records.get(p, 1) // lane)) for p in range(parts)]), F.col("part"))
    dealt = spilled.filter("part >= 0").withColumn("lane", F.pmod(F.xxhash64("slice"), lanes))
    pairs = dealt.select("part", "lane", "pairs").groupBy("part", "lane").applyInPandas(_count, "part int, code long, n long").groupBy("part", "code").agg(F.sum("n").alias("n"))
    tables = cut(pairs.groupBy("part").applyInPandas(_pack, "part int, table binary")).withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1))).withColumn("lane", F.col("lane").cast("long"))
    given = dealt.select("part", "lane", "slice", "pairs", "documents").groupBy("part", "lane").cogroup(tables.groupBy("part", "lane")).applyInPandas(_give, "slice long, given binary")
    told = ", ".join(f"{c} long" for c in [*COUNTS, "n_best", "count_sum"])
    return spilled.filter("part = -1").select("slice", "documents").groupBy("slice").cogroup(given.groupBy("slice")).applyInArrow(_told, f"doc_id {kind}, {told}, groups_sha256 string")

"""Operator 8, token ids in flat binary files.

A data set is a folder of pairs of files and a manifest table. `part-XXXXX.bin` holds the ids of a run
of documents as little-endian unsigned integers, nothing else; `part-XXXXX.idx` holds, as 64-bit
integers, the document count n, n + 1 offsets into the .bin (in ids, the first 0) and n document ids.
The manifest (Parquet) has a row per pair: part, name, dtype, n_docs, n_ids and `base`, the number of
ids in all parts before it, from a prefix sum over the parts. Documents are in ascending order of id
over all parts. Readers map the files into memory.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Recent, give_back, held
from .pieces import shipped
from .word_tables import TEXTS, laid_out, slices, split_at

KEPT_WORDS = 300_000
CUT = "\x00"
#: White space by the Unicode property, as the tokenizer's pattern has it, without what regular expressions of Arrow call so.
_RARE = "\x0b\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where texts are cut, as patterns and what is put in their place.
_CUTS = [(r"([^\s])(\s)", rf"\1{CUT}\2"), (r"(\pL)([.,;:!?])", rf"\1{CUT}\2"), (rf"{CUT}\n([^\s{CUT}])", rf"{CUT}\n{CUT}\1".replace(r"\n", "\n"))]


class LibraryIds:
    """The tokenizers library, asked once for each distinct stretch of text.

    Where the file's pre-tokenizer is the byte-level one with its own pattern and nothing is put in
    front, no token reaches from a character that is not white space over one that is, from a letter
    over a closing mark, or from a lone line break over what follows: texts are encoded in stretches
    between such places. Texts with rarer white space, and other files' texts, are encoded whole.
    """

    def __init__(self, data: bytes, dtype: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_buffer(data), dtype
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(data)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.known = Recent(KEPT_WORDS)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 and self.cuts else None

    def _ask(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype == "<u2" else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], each: int = 256) -> None:
        """Words without line breaks are asked for in lines: one text is faster than many, and the line break's own id tells them apart."""
        known = self.known
        in_lines = [] if self.line is None else [w for w in words if "\n" not in w]
        if in_lines:
            groups = [in_lines[i : i + each] for i in range(0, len(in_lines), each)]
            width = np.dtype(self.dtype).itemsize
            for group, e in zip(groups, self.tokenizer.encode_batch(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=self.dtype)
                ends = (np.flatnonzero(ids == self.line) * width).tolist()
                if len(ends) == len(group) - 1:
                    raw = ids.tobytes()
                    known.update({w: raw[a:b] for w, a, b in zip(group, [0, *(x + width for x in ends)], [*ends, len(raw)], strict=True)})
                else:
                    known.update(zip(group, self._ask(group), strict=True))
        rest = words if self.line is None else [w for w in words if "\n" in w]
        known.update(zip(rest, self._ask(rest), strict=True))

    def _values(self, words: list[str]) -> list[bytes]:
        """The ids of these distinct stretches; the library is asked for those that are not known."""
        known = self.known
        values, gaps = known.with_gaps(words)
        self._learn([words[k] for k in gaps if words[k] not in known.old])
        for k in gaps:
            values[k] = known[words[k]]
        known.trim()
        return values

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Its stretches are numbered, and each distinct one of these texts is looked up once."""
        found = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(found, f"[{CUT}{_RARE}]").to_pylist()
        whole = [i for i, t in enumerate(texts) if not self.cuts or odd[i] or any(s in t for s in self.special)]
        out: list[np.ndarray] = [np.empty(0, dtype=self.dtype)] * len(texts)
        for i, x in zip(whole, self._ask([texts[i] for i in whole]), strict=True):
            out[i] = np.frombuffer(x, dtype=self.dtype)
        rest = np.delete(np.arange(len(texts)), whole).tolist()
        if rest:
            found = found.take(rest)
            for pattern, into in _CUTS:
                found = pc.replace_substring_regex(found, pattern, into)
            offsets, numbers, words = split_at(found, CUT)
            for i, ids in zip(rest, laid_out(self._values(words), self.dtype, numbers, offsets), strict=True):
                out[i] = ids
        return out


def _library(data: bytes, dtype: str) -> LibraryIds:
    return held(("library", hash(data), dtype), lambda: LibraryIds(data, dtype))


def _put(folder: str, name: str, chunks: list[bytes]) -> None:
    """Written under another name first, so that a file is whole or not there; a task that runs again writes the same bytes."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    context = TaskContext.get()
    half = f"{path}/.{name}.{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(half) as out:
        for c in chunks:
            out.write(c)
    fs.move(half, f"{path}/{name}")


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    *,
    end_id: int | None = 0,
    dtype: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids_each: int = 64_000_000,
    texts_each: int = TEXTS,
) -> DataFrame:
    """Encode every whole text, append end_id, write the files below folder, and return the manifest.

    dtype is `<u2` where the vocabulary fits, else `<u4`. A null text counts as empty and gives end_id
    alone. Documents with one id keep rows of their own, in no set order among themselves; those
    without an id come first and are written as -1. An empty table gives a manifest without rows.
    Columns but the two named ones are not read. A part's ids are held in memory up to ids_each; a
    task goes on in a further part after that.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    data = shipped(spark, tokenizer_path)
    dtype = dtype or ("<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4")
    end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library, part, number = _library(data.value, dtype), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        found: list[bytes] = []
        held_ids = 0

        def flush() -> pd.DataFrame:
            nonlocal ids, found, held_ids, number
            name = f"part-{part:06d}-{number:04d}"
            doc_ids = np.concatenate(ids)
            offsets = np.concatenate([[0], np.cumsum([len(x) // width for x in found])]).astype("<i8")
            _put(folder, f"{name}.bin", found)
            _put(folder, f"{name}.idx", [np.array([len(doc_ids)], dtype="<i8").tobytes(), offsets.tobytes(), doc_ids.astype("<i8").tobytes()])
            row = pd.DataFrame({"part": [part * 10_000 + number], "name": [name], "dtype": [dtype], "n_docs": [len(doc_ids)], "n_ids": [int(offsets[-1])]})
            ids, found, held_ids, number = [], [], 0, number + 1
            return row

        for batch in batches:
            every = [t if isinstance(t, str) else "" for t in batch["text"]]
            for part_of in slices(every, texts_each):
                ids.append(batch["doc_id"].to_numpy(dtype=np.int64)[part_of])
                new = [x.tobytes() + end for x in library.encode(every[part_of])]
                found.extend(new)
                held_ids += sum(map(len, new)) // width
                if held_ids >= ids_each:
                    yield flush()
            give_back()
        if ids:
            yield flush()

    ordered = (
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    written = f"{folder.rstrip('/')}/parts"
    ordered.mapInPandas(run, "part long, name string, dtype string, n_docs long, n_ids long").write.parquet(written)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = f"{folder.rstrip('/')}/manifest"
    spark.read.parquet(written).withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(manifest)
    return spark.read.parquet(manifest)


def _mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """The file's integers: mapped into memory on a local path, else read from the store."""
    fs, path = pafs.FileSystem.from_uri(f"{folder.rstrip('/')}/{name}")
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def read_token_files(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (over the ids as
    32-bit integers), and token_ids if asked for. Each part is read by a task of its own."""
    manifest = spark.read.parquet(f"{folder.rstrip('/')}/manifest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m in batch.itertuples():
                index = _mapped(folder, f"{m.name}.idx", "<i8")
                n = int(index[0])
                offsets, doc_ids = np.asarray(index[1 : n + 2]), np.asarray(index[n + 2 :])
                ids = _mapped(folder, f"{m.name}.bin", m.dtype) if m.n_ids else np.empty(0, dtype=m.dtype)
                for i in range(0, n, 2000):
                    spans = list(zip(offsets[i : min(n, i + 2000)].tolist(), offsets[i + 1 : min(n, i + 2000) + 1].tolist(), strict=True))
                    out = {
                        "doc_id": doc_ids[i : i + 2000],
                        "start": m.base + offsets[i : min(n, i + 2000)],
                        "n_tokens": [b - a for a, b in spans],
                        "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in spans],
                    }
                    if with_ids:
                        out["token_ids"] = [ids[a:b].astype(np.int64) for a, b in spans]
                    yield pd.DataFrame(out)

    more = ", token_ids array<long>" if with_ids else ""
    parts = manifest.count()
    return manifest.repartition(max(1, parts), "part").mapInPandas(run, f"doc_id long, start long, n_tokens long, ids_crc32 long{more}")

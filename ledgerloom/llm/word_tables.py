"""Texts as numbers of distinct words, and the way back from distinct words' ids to the ids of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of texts whose words are looked up together in a task.
TEXTS = 2_000_000


def slices(texts: list[str], most: int = TEXTS) -> Iterator[slice]:
    """Runs of texts of no more than so many characters, or of one text."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if len(texts) > start:
        yield slice(start, len(texts))


def split_at(texts: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(where each text's words start and the last one's end, the number of each word, the distinct words) of texts cut at a mark."""
    words = pc.split_pattern(texts, mark)
    coded = words.flatten().dictionary_encode()
    return words.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def laid_out(values: list[bytes], dtype: str, numbers: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ids of each text: values[k], the ids of distinct word k, for each of its words."""
    pool = np.frombuffer(b"".join(values), dtype=dtype)
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // pool.itemsize
    starts = np.cumsum(sizes) - sizes
    length = sizes[numbers]
    ends = np.cumsum(length)
    at = np.repeat(starts[numbers] - (ends - length), length)
    at += np.arange(len(at))
    border = np.concatenate([[0], ends])[offsets].tolist()
    ids = pool[at]
    return [ids[a:b] for a, b in zip(border, border[1:], strict=False)]

"""Operator 1, SentencePiece encoding and decoding by batched numpy Viterbi.

Words of equal length advance together through one lattice. At each position the hashes of the
substrings that end there are looked up among the sorted hashes of the pieces, and hits compared character
by character; the best admissible piece's length is stored as the back pointer. For a unigram model the
best piece has the highest sum of scores. For a BPE model the sum of scores does not give the library's
ids; there a piece is admissible only where `PieceModel.can_follow` allows it beside the piece before, and
exactly one is. Lengths that few words have, very long words above all, take the same steps word by word:
there is nothing to advance together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, give_back, held
from .pieces import EDGE, PieceModel, load, shipped
from .word_tables import TEXTS, laid_out, slices, split_at

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of one length that are worth a batch.
FEW = 24
#: Pairs of pieces whose answer a Python process keeps (a power of two).
KEPT_PAIRS = 1 << 21
#: Distinct words whose ids a Python process keeps.
KEPT_WORDS = 100_000


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row: one column more than codes has."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
    return out


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), length)


class Lattice:
    """Encodes lists of words; keeps the ids of words that it has met (a bounded number)."""

    def __init__(self, model: PieceModel):
        self.model = model
        #: By length, the longest first: sorted hashes, ids and characters of the pieces.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        spelled: dict[int, list[str]] = {}
        for p in model.spelled:
            spelled.setdefault(len(p), []).append(p)
        for n, pieces in sorted(spelled.items(), reverse=True):
            codes = _codes(pieces, n)
            keys = _hash(codes)[:, -1]
            order = np.argsort(keys)
            self.by_length[n] = keys[order], np.array([model.ids[p] for p in pieces], dtype=np.int64)[order], codes[order]
        self.powers = np.ones(model.longest + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(model.longest):
                self.powers[i + 1] = self.powers[i] * _BASE
        self.scores = np.array(model.scores, dtype=np.float64)
        # Below any piece, as the library scores a character that no piece spells.
        self.unknown = min((model.scores[i] for i in model.ids.values()), default=0.0) - 10.0
        self.pairs = np.full(KEPT_PAIRS, -1, dtype=np.int64), np.zeros(KEPT_PAIRS, dtype=bool)
        self.known = Recent(KEPT_WORDS)
        self.segments = Recent(KEPT_WORDS)

    def _admissible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each piece can follow the other; the table holds the latest pair of each slot."""
        codes, n = (left + 1) * len(self.scores) + right, len(self.scores)
        held, answer = self.pairs
        with np.errstate(over="ignore"):
            slot = (codes.astype(np.uint64) * _BASE >> np.uint64(64 - KEPT_PAIRS.bit_length() + 1)).astype(np.int64)
        out = answer[slot]
        new = np.flatnonzero(held[slot] != codes)
        if len(new):
            asked, back = np.unique(codes[new], return_inverse=True)
            out[new] = np.array([self.model.can_follow(c // n - 1, c % n) for c in asked.tolist()], dtype=bool)[back]
            last = dict(zip(slot[new].tolist(), new.tolist(), strict=True))  # one pair for each slot
            held[list(last)], answer[list(last)] = codes[list(last.values())], out[list(last.values())]
        return out

    def _one(self, word: str) -> bytes:
        """The same lattice for one word."""
        model, ids, longest, scores = self.model, self.model.spelled, self.model.longest, self.model.scores
        n = len(scores)
        pairs: dict[int, bool] = {}
        best, last, step = [0.0], [EDGE], [0]
        for end in range(1, len(word) + 1):
            value, piece, back = -np.inf, EDGE, 0
            for start in range(max(0, end - longest), end):
                found = ids.get(word[start:end])
                if found is None:
                    continue
                if model.is_bpe:
                    code = (last[start] + 1) * n + found
                    ok = pairs.get(code)
                    if ok is None:
                        ok = pairs[code] = model.can_follow(last[start], found)
                    if ok:
                        value, piece, back = 0.0, found, end - start
                        break
                elif best[start] + scores[found] > value:
                    value, piece, back = best[start] + scores[found], found, end - start
            unknown = 0.0 if model.is_bpe else best[end - 1] + self.unknown
            if back == 0 or (not model.is_bpe and unknown > value):
                value, piece, back = unknown, EDGE, 1
            best.append(value)
            last.append(piece)
            step.append(back)
        return self._read_back(word, step, last)

    def _read_back(self, word: str, steps: list[int], pieces: list[int]) -> bytes:
        model, found, end = self.model, [], len(word)
        while end:
            if pieces[end] == EDGE:
                # Without byte fallback, neighbouring unknown characters are one token.
                if model.byte_fallback or not (found and found[-1] == model.unk_id):
                    found.extend(reversed(model.fallback(word[end - 1])))
            else:
                found.append(pieces[end])
            end -= steps[end]
        found.reverse()
        return np.array(found, dtype="<i4").tobytes()

    def _equal_length(self, words: list[str], length: int) -> list[bytes]:
        n, model = len(words), self.model
        codes = _codes(words, length)
        prefix = _hash(codes)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0.0
        step = np.zeros((n, length + 1), dtype=np.int32)
        last = np.full((n, length + 1), EDGE, dtype=np.int64)
        for end in range(1, length + 1):
            open_ = np.arange(n)  # of a BPE model's pieces that end here, one fits: then the word is done
            for size, (keys, ids, spelling) in self.by_length.items():
                if size > end or not len(open_):
                    continue
                start = end - size
                with np.errstate(over="ignore"):
                    probe = prefix[open_, end] - prefix[open_, start] * self.powers[size]
                at = np.searchsorted(keys, probe)
                at[at == len(keys)] = 0
                hit = np.flatnonzero(keys[at] == probe)
                if not len(hit):
                    continue
                rows, at = open_[hit], at[hit]
                same = (codes[rows, start:end] == spelling[at]).all(axis=1)
                rows, piece = rows[same], ids[at[same]]
                if model.is_bpe:
                    ok = self._admissible(last[rows, start], piece)
                    rows, piece = rows[ok], piece[ok]
                    best[rows, end], step[rows, end], last[rows, end] = 0.0, size, piece
                    if len(rows):
                        open_ = open_[step[open_, end] == 0]
                    continue
                value = best[rows, start] + self.scores[piece]
                better = value > best[rows, end]
                rows, piece = rows[better], piece[better]
                best[rows, end], step[rows, end], last[rows, end] = value[better], size, piece
            rows = np.flatnonzero(step[:, end] == 0) if model.is_bpe else np.flatnonzero(best[:, end - 1] + self.unknown > best[:, end])
            if len(rows):  # no piece spells this character
                best[rows, end] = 0.0 if model.is_bpe else best[rows, end - 1] + self.unknown
                step[rows, end], last[rows, end] = 1, EDGE
        # All words are read back together, but those with characters that no piece spells.
        found = np.empty((n, length), dtype="<i4")
        place, end, row, odd = np.full(n, length), np.full(n, length), np.arange(n), np.zeros(n, dtype=bool)
        while len(row):
            piece = last[row, end[row]]
            odd[row] |= piece == EDGE
            place[row] -= 1
            found[row, place[row]] = piece
            end[row] -= step[row, end[row]]
            row = row[end[row] > 0]
        raw, width = found.tobytes(), found.itemsize
        out = [raw[a:b] for a, b in zip(((np.arange(n) * length + place) * width).tolist(), ((np.arange(n) + 1) * length * width).tolist(), strict=True)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._read_back(words[i], step[i].tolist(), last[i].tolist())
        return out

    def learn(self, words: list[str]) -> None:
        """Encode these words: their segments, those of one length together, then put in a row."""
        split = {w: self.model.segments(w) for w in words}
        new = self.segments.missing(split.values())
        groups: dict[int, list[str]] = {}
        for w in new:
            groups.setdefault(len(w), []).append(w)
        for length, group in groups.items():
            if len(group) < FEW:
                self.segments.update((w, self._one(w)) for w in group)
                continue
            # A long word's lattice is wide: fewer of them at a time.
            each = max(1, min(20_000, 2_000_000 // (length + 1)))
            for i in range(0, len(group), each):
                part = group[i : i + each]
                self.segments.update(zip(part, self._equal_length(part, length), strict=True))
        find = self.segments.__getitem__
        for w, segments in split.items():
            self.known[w] = find(w) if len(segments) == 1 else b"".join(map(find, segments))

    def _values(self, words: list[str]) -> list[bytes]:
        """The ids of these distinct words."""
        values, gaps = self.known.with_gaps(words)
        self.learn([words[i] for i in gaps if words[i] not in self.known.old])
        for i in gaps:
            values[i] = self.known[words[i]]
        self.known.trim()
        self.segments.trim()
        return values

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Its words are numbered, and each distinct one of these texts is looked up once."""
        model = self.model
        every = [model.normalised(t) for t in texts]
        out = [np.empty(0, dtype="<i4")] * len(texts)
        # Texts of single spaces are cut at each of them; the first stands in front of the first word.
        plain = [i for i, t in enumerate(every) if model.by_word and t[:1] == " " and t[-1] != " " and "  " not in t]
        other = sorted(set(range(len(texts))).difference(plain))
        if plain:
            offsets, numbers, words = split_at(pa.array([every[i][1:] for i in plain], pa.string()), " ")
            for i, ids in zip(plain, laid_out(self._values([" " + w for w in words]), "<i4", numbers, offsets), strict=True):
                out[i] = ids
        if other:
            split = [model.words(every[i]) for i in other]
            place: dict[str, int] = {}
            numbers = np.array([place.setdefault(w, len(place)) for words in split for w in words], dtype=np.int64)
            for i, ids in zip(other, laid_out(self._values(list(place)), "<i4", numbers, np.cumsum([0, *map(len, split)])), strict=True):
                out[i] = ids
        if not model.byte_fallback:  # neighbouring unknown characters are one token, also across words
            unknown = [x == model.unk_id for x in out]
            out = [x[~np.concatenate([[False], u[1:] & u[:-1]])] if len(x) else x for x, u in zip(out, unknown, strict=True)]
        return out


def lattice(data: bytes) -> Lattice:
    return held(("lattice", hashlib.sha256(data).digest()), lambda: Lattice(load(data)))


def encode_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", texts_each: int = TEXTS) -> DataFrame:
    """One row per document: doc_id, token_ids, n_tokens, decoded, round_trip.

    The ids are those of the library, without begin or end token. A null text counts as empty and has
    no ids. Characters that no piece spells become byte pieces. `decoded` is the text of the ids;
    `round_trip` says whether it is the text again (not so for U+2581, which is a space to the model).
    Equal rows stay rows of their own; an empty table gives no rows; other columns are not read. A
    word of any length is encoded whole.
    """
    data = shipped(docs.sparkSession, model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattice(data.value)
        for batch in batches:
            every = [t if isinstance(t, str) else None for t in batch["text"]]
            for part in slices([t or "" for t in every], texts_each):
                texts = every[part]
                ids = lat.encode(texts)
                decoded = [lat.model.decode(x.tolist()) for x in ids]
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].to_numpy()[part],
                        "token_ids": ids,
                        "n_tokens": [len(x) for x in ids],
                        "decoded": decoded,
                        "round_trip": [d == (t or "") for d, t in zip(decoded, texts, strict=True)],
                    }
                )
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"doc_id {kind}, token_ids array<int>, n_tokens long, decoded string, round_trip boolean"
    )

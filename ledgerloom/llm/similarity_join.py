"""Operator 4, n-gram Jaccard join by universe partition and the pigeonhole principle.

Shingles are hashed into the segments of a layout; a layout belongs to a band of set sizes. Two sets
of Jaccard similarity t or more differ in at most k = (|x| + |y|)(1 - t)/(1 + t) elements. Give every
segment i a tolerance e_i of -1 (not used), 0 (must be equal) or 1 (one element more or less): if the
sum of all e_i + 1 exceeds k, some segment of the two differs by no more than its e_i. So it suffices
to look up, for the smaller sets of the same band and the band below, the chosen segments as they are,
and for e_i = 1 also their one-deletion neighbourhoods. The set that looks up chooses by cost: segments
of many elements first, as they are the rarest; the few segments whose deletions are indexed get
tolerance 1 where others would be empty or hold a single element.

Texts of the same words in the same order are made one class first. Signatures under which the same sets meet are one meeting. What meets
is compared by counts, then word for word: first with the most connected set of each crowded meeting, and
when those links have made components, whatever meets across components. Links inside a component are not
enumerated, so large groups of copies cost a star each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, give_back, let_go, pieces_for

WORDS = 5
PERCENT = 75
#: Bytes of text hashed at once in a task.
SLICE = 1 << 20
#: A set's sketch has a bit for each of 2**level parts of the universe, two parts or more for an element, within these levels.
LEVELS = 9, 24
#: Sets of a meeting that are compared in one piece; larger meetings are compared block by block.
BLOCK = 1024

_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
PROBE, DELETED, INDEXED, WITNESS, DOUBLED = 1, 2, 4, 8, 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Places of a word up to which the values of its bytes are kept in a table.
PLACES = 64


def _placed(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A scrambled number for a byte at a place: words are sums of these, so no pattern of bytes makes two of them equal."""
    with np.errstate(over="ignore"):
        return _mix((place.astype(np.uint64) * _U(256) + byte.astype(np.uint64) + _U(1)) * _U(_ODD[0]))


_BYTES = _placed(np.arange(PLACES * 256) >> 8, np.arange(PLACES * 256) & 255)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each word starts, its hash) of UTF-8 bytes."""
    inside = ~_SPACES[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    at, lengths = np.flatnonzero(inside), ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place, byte = np.arange(len(at)) - np.repeat(first, lengths), data[at]
    values = _BYTES[np.minimum(place, PLACES - 1) * 256 + byte]
    far = np.flatnonzero(place >= PLACES)
    values[far] = _placed(place[far], byte[far])
    with np.errstate(over="ignore"):
        return starts, _mix(np.add.reduceat(values, first))


def _blobs(texts: list[str | None]) -> list[bytes]:
    """UTF-8 with A-Z in lower case; a null text is empty."""
    return [t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"" for t in texts]


def word_digests(texts: list[str | None]) -> list[bytes]:
    """A digest of each text's words in their order, whatever white space stands between them: equal only for equal words."""
    return [hashlib.blake2b(b" ".join(b.split()), digest_size=16).digest() for b in _blobs(texts)]


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text: A-Z in lower case, words between ASCII white space, every run of
    `width` words; all words as one run if there are fewer; nothing without words. In sets of n shingles two of them share a
    hash with a chance of about n * n / 2 ** 65, whatever the words are."""
    blobs = _blobs(texts)
    ends = np.cumsum([len(b) + 1 for b in blobs])
    starts, words = _word_hashes(np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8))
    border = np.searchsorted(starts, np.concatenate([[0], ends]))
    n = len(words)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, n - width + 1), dtype=np.uint64)
        weight = _U(1)
        for j in range(width):
            weight = weight * _U(_ODD[2])
            runs += words[j : n - width + 1 + j] * weight
    runs = _mix(runs)
    out = []
    for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            whole = hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


# -- layouts -----------------------------------------------------------------------------------


def difference(sizes: int, percent: int) -> int:
    """How many elements two sets of these sizes together may differ in."""
    return sizes * (100 - percent) // (100 + percent)


@lru_cache(maxsize=8)
def bands(percent: int) -> np.ndarray:
    """The least size of each band; sets of one band link only within it and with the bands beside it."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, -(-low[-1] * 100 // percent)))
    return np.array(low, dtype=np.int64)


def spare(most: int) -> int:
    """How many segments a set looks up beyond what the pigeonhole needs, so that it can leave out as many of its most crowded ones."""
    return 2 + most // 8


@lru_cache(maxsize=1024)
def layout(band: int, percent: int) -> tuple[int, int, int]:
    """(segments, of which the last so many have their one-deletion neighbourhoods indexed, spare ones among those looked up).

    There are more segments than the tolerances ask for, so that hardly a set has to look up an empty one, where very many would meet.
    """
    low = bands(percent)
    top = int(low[band + 1]) - 1
    most = difference(top + min(int(low[band + 2]) - 1, top * 100 // percent), percent)
    deletable = 1 + most // 16
    return most + 3 + spare(most) + most // 12 + deletable, deletable, spare(most)


def _signatures(sets: list[np.ndarray], band: np.ndarray, own: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, place of the set in the list, flags) of the sets under the layouts of the given bands; own: those are their own."""
    with np.errstate(over="ignore"):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        low = bands(percent)
        shape = {b: layout(b, percent) for b in set(band.tolist())}
        segments = np.array([shape[b][0] for b in band.tolist()], dtype=np.int64)
        deletable = np.array([shape[b][1] for b in band.tolist()], dtype=np.int64)
        extra = np.array([1 + shape[b][2] for b in band.tolist()], dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(segments)])
        owner = np.repeat(np.arange(len(sets)), sizes)
        h = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
        salt = _mix((band.astype(np.uint64) + _U(1)) * _U(_ODD[3]))
        inner = (_mix(h + salt[owner]) % segments[owner].astype(np.uint64)).astype(np.int64)
        slot = base[owner] + inner
        element = _mix(h ^ _U(_ODD[4]))
        total = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(total, slot, element)
        count = np.bincount(slot, minlength=base[-1])
        slot_owner = np.repeat(np.arange(len(sets)), segments)
        number = np.arange(base[-1]) - base[slot_owner]
        slot_salt = _mix(salt[slot_owner] + number.astype(np.uint64))
        can_delete = number >= (segments - deletable)[slot_owner]

        # Tolerances: how much each set needs, and the segments in the order of their cost.
        partner = sizes if own else np.minimum(sizes, low[band + 1] - 1)
        need = ((sizes + partner) * (100 - percent) // (100 + percent)) + extra
        order = np.lexsort((-count, slot_owner))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - base[slot_owner[order]]
        rich = np.bincount(slot_owner, weights=count >= 2, minlength=len(sets)).astype(np.int64)
        short = np.maximum(0, need - rich)  # beyond the segments of two elements or more
        double = can_delete & (count >= 2)
        nth = np.cumsum(double) - 1
        nth -= np.concatenate([[0], np.cumsum(np.bincount(slot_owner, weights=double, minlength=len(sets)).astype(np.int64))])[slot_owner]
        double &= nth < short[slot_owner]
        doubled = np.bincount(slot_owner, weights=double, minlength=len(sets)).astype(np.int64)
        chosen = rank < (need - doubled)[slot_owner]
        double &= chosen

    with np.errstate(over="ignore"):
        keep = np.ones(len(total), dtype=bool) if own else chosen
        sig = [_mix(total[keep] + slot_salt[keep])]
        who = [slot_owner[keep]]
        flag = [(chosen[keep] * PROBE + double[keep] * DOUBLED + (INDEXED if own else 0)).astype(np.uint8)]
        deleted = can_delete[slot] if own else double[slot]
        sig.append(_mix(total[slot[deleted]] - element[deleted] + slot_salt[slot[deleted]]))
        who.append(owner[deleted])
        flag.append((double[slot[deleted]] * (PROBE + DOUBLED) + DELETED + (INDEXED if own else 0)).astype(np.uint8))
    return np.concatenate(sig), np.concatenate(who), np.concatenate(flag)


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of these non-empty sets: under their own band's layout, and for looking up in the band below."""
    band = np.searchsorted(bands(percent), [len(s) for s in sets], side="right") - 1
    parts = [_signatures(sets, band, True, percent)]
    lower = np.flatnonzero((band > 0) & ([100 * (int(bands(percent)[b]) - 1) >= percent * len(s) for b, s in zip(band.tolist(), sets, strict=True)]))
    if len(lower):
        sig, who, flag = _signatures([sets[i] for i in lower.tolist()], band[lower] - 1, False, percent)
        parts.append((sig, lower[who], flag))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# -- Spark -------------------------------------------------------------------------------------


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of up to SLICE bytes and 8,000 rows."""
    let_go()
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t) if isinstance(t, str) else 0
            if held >= SLICE or len(ids) == 8000:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts
        give_back()


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def shingle_classes(docs: DataFrame, width: int, more: Callable[[list[np.ndarray]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_shingles, digest of the words, the set's sketch, and `more`: what that function makes of the sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _slices(batches):
            sets = shingle_sets(texts, width)
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(ids, dtype="Int64"),
                    "n_shingles": [len(s) for s in sets],
                    "digest": word_digests(texts),
                    "sketch": [sketch(s) for s in sets],
                    "more": more(sets) if more else b"",
                }
            )

    return docs.mapInPandas(run, "doc_id long, n_shingles long, digest binary, sketch binary, more binary")


def sketch(elements: np.ndarray) -> bytes:
    """The set's size, and for each part of the universe whether an odd number of elements falls into it.

    Two sets differ in at least as many elements as their sketches in bits. A sketch of half as many
    parts is one half of the bits over the other.
    """
    n = len(elements)
    parts = 1 << min(max((2 * n - 1).bit_length(), LEVELS[0]), LEVELS[1])
    odd = np.bincount((elements >> _U(32)).astype(np.int64) & parts - 1, minlength=parts) & 1
    return np.array([n], dtype="<i8").tobytes() + np.packbits(odd.astype(bool)).tobytes()


class Sketches:
    """Sketches side by side, each also folded to the lengths of the shorter ones."""

    def __init__(self, blobs: list[bytes]):
        self.sizes = np.array([np.frombuffer(b, dtype="<i8", count=1)[0] for b in blobs], dtype=np.int64)
        self.width = np.array([len(b) - 8 for b in blobs], dtype=np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        who, bits = np.empty(0, dtype=np.int64), np.empty((0, 0), dtype=np.uint64)
        width = int(self.width.max(initial=0))
        while width >= int(self.width.min(initial=1 << 62)):
            mine = np.flatnonzero(self.width == width)
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:] if half else np.empty((0, width // 8), dtype=np.uint64)
            own = np.frombuffer(b"".join(blobs[i][8:] for i in mine.tolist()), dtype=np.uint64).reshape(len(mine), width // 8)
            who, bits = np.concatenate([who, mine]), np.concatenate([bits, own])
            place = np.full(len(blobs), -1, dtype=np.int64)
            place[who] = np.arange(len(who))
            self.tables[width] = place, bits
            width //= 2

    def may_link(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sets x[i] and y[i] can be similar enough."""
        most = (self.sizes[x] + self.sizes[y]) * (100 - percent) // (100 + percent)
        fits = np.abs(self.sizes[x] - self.sizes[y]) <= most
        width = np.minimum(self.width[x], self.width[y])
        for w in np.unique(width[fits]).tolist():
            place, bits = self.tables[w]
            rows = np.flatnonzero(fits & (width == w))
            each = max(1, (8 << 20) // w)
            for i in range(0, len(rows), each):
                r = rows[i : i + each]
                fits[r] = np.bitwise_count(bits[place[x[r]]] ^ bits[place[y[r]]]).sum(axis=1, dtype=np.int64) <= most[r]
        return fits


#: A set that meets others: its id, its size, and what its signature is there for.
_MEMBER = np.dtype([("doc", "<i8"), ("size", "<i4"), ("flag", "u1")])


def _pack(sig: np.ndarray, kind: type, who: np.ndarray, flag: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> bytes:
    """The signatures in the order of their sets and flags: sets and flags are told once for each run of them."""
    order = np.lexsort((flag, who))
    sig, who, flag = sig[order], who[order], flag[order]
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (flag[1:] != flag[:-1])]))
    run = np.empty(len(first), dtype=_MEMBER)
    run["doc"], run["size"], run["flag"] = names[who[first]], sizes[who[first]], flag[first]
    length = np.diff(np.append(first, len(sig))).astype("<u4")
    return np.array([len(run), len(sig)], dtype="<i8").tobytes() + run.tobytes() + length.tobytes() + sig.astype(kind).tobytes()


def _unpack(blob: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, a member for each)."""
    runs, n = np.frombuffer(blob, dtype="<i8", count=2).tolist()
    run = np.frombuffer(blob, dtype=_MEMBER, count=runs, offset=16)
    at = 16 + run.nbytes
    length = np.frombuffer(blob, dtype="<u4", count=runs, offset=at)
    return np.frombuffer(blob, dtype=kind, count=n, offset=at + length.nbytes), np.repeat(run, length)


def _first(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, dtype=np.int64)


def _lists(sig: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the members by signature and id, each once with all its flags; where each signature's start; two hashes of each list)."""
    order = np.lexsort((member["doc"], sig))
    sig, member = sig[order], member[order]
    each = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (member["doc"][1:] != member["doc"][:-1])]))
    # A chance match of two of a set's own signatures must not hide one that is whole.
    flags = np.bitwise_or.reduceat(member["flag"], each) & ~np.uint8(DELETED) | np.bitwise_and.reduceat(member["flag"], each) & DELETED
    sig, member = sig[each], member[each]
    member["flag"] = flags
    first = _first(sig)
    with np.errstate(over="ignore"):
        x = _mix(member["doc"].view(np.ndarray).astype(np.uint64) * _U(256) + member["flag"])
        return member, first, _mix(np.add.reduceat(x, first)), _mix(np.add.reduceat(_mix(x ^ _U(_ODD[0])), first) + _U(1))


def _few_members(batches: Iterator[pd.DataFrame], most: int = 500_000) -> Iterator[pd.DataFrame]:
    """The rows in batches of no more than so many members, or of one row."""
    for batch in batches:
        upto = np.cumsum(batch["members"].map(len).to_numpy() // _MEMBER.itemsize)
        while len(batch):
            k = max(1, int(np.searchsorted(upto, most, side="right")))
            yield batch.iloc[:k]
            batch, upto = batch.iloc[k:], upto[k:] - upto[k - 1]


def meetings(texts: DataFrame, buckets: int, width: int, percent: int) -> DataFrame:
    """list, doc_id, size, flags, spare, times, crowd: the lists of two sets or more that share a signature, one of which looks up,
    each list once with the number of its signatures. texts: a row per class.

    A task packs its signatures by ranges of their values: 32 bits of each, as the range tells more of it (a chance match is a
    meeting in vain). A signature that a task finds several times is known to meet, and goes past the buckets but for one
    witness, so a bucket holds at most one entry of it from each slice of the texts.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts_ in _slices(batches):
            keep = [(i, s) for i, s in zip(ids, shingle_sets(texts_, width), strict=True) if len(s)]
            if not keep:
                continue
            names, sets = np.array([i for i, _ in keep], dtype=np.int64), [s for _, s in keep]
            sizes = np.array([len(s) for s in sets], dtype=np.int32)
            sig, who, flag = signatures(sets, percent)
            bucket = ((sig >> _U(32)) * _U(buckets)) >> _U(32)
            sig = bucket << _U(32) | sig & _U(0xFFFFFFFF)
            order = np.argsort(sig)
            sig, who, flag = sig[order], who[order], flag[order]
            first = _first(sig)
            length = np.diff(np.append(first, len(sig)))
            union = np.bitwise_or.reduceat(flag, first)
            known = (length > 1) & (union & PROBE > 0)
            several = np.repeat(known, length)
            rows: list[tuple[int, int, bytes]] = []
            if several.any():
                rows.append((int(sig[0] % _U(buckets)), 1 + int(names[0] % 1_000_003), _pack(sig[several], np.uint64, who[several], flag[several], names, sizes)))
            # A witness carries all flags of its signature, and WITNESS so that the bucket does not report it again.
            alone = ~several
            alone[first[known]] = True
            flag[first[known]] = union[known] | WITNESS
            s, w, mark = sig[alone], who[alone], flag[alone]
            edges = np.searchsorted(s, np.arange(buckets + 1).astype(np.uint64) << _U(32))
            for b in range(buckets):
                x = slice(edges[b], edges[b + 1])
                if edges[b] < edges[b + 1]:
                    rows.append((b, 0, _pack(s[x], np.uint32, w[x], mark[x], names, sizes)))
            yield pd.DataFrame(rows, columns=["bucket", "lane", "blob"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Lists that are whole by two hashes; parts of a list (of a signature that some task finds several times) by signature."""
        lane = int(pdf["lane"].iloc[0])
        sig, member = (np.concatenate(x) for x in zip(*(_unpack(b, np.uint64 if lane else np.uint32) for b in pdf["blob"]), strict=True))
        partial = np.ones(len(sig), dtype=bool)
        if not lane:
            sig = sig.astype(np.uint64) | _U(int(pdf["bucket"].iloc[0])) << _U(32)
            order = np.argsort(sig)
            s, f, z = sig[order], member["flag"][order], member["size"][order].astype(np.int64)
            first = _first(s)
            length = np.diff(np.append(first, len(s)))
            union = np.bitwise_or.reduceat(f, first)
            # A set stays if one of those that look up here has a size that it can link with.
            seeks = f & PROBE > 0
            least = np.minimum.reduceat(np.where(seeks, z, 1 << 40), first)
            most = np.maximum.reduceat(np.where(seeks, z, 0), first)
            witness = union & WITNESS > 0  # of several sets, whose sizes are not told here
            least[witness], most[witness] = 0, 1 << 40
            fits = (100 * np.repeat(most, length) >= percent * z) & (100 * z >= percent * np.repeat(least, length))
            stays = np.repeat((length > 1) & (union & PROBE > 0), length) & fits & (f & WITNESS == 0)
            order, partial = order[stays], np.repeat(witness, length)[stays]
            sig, member = sig[order], member[order]
        found = []
        for part in (False, True):
            if not (mine := partial == part).any():
                continue
            s = sig[mine]
            members, first, one, two = _lists(s, member[mine])
            n = np.diff(np.append(first, len(members)))
            times = np.ones(len(n), dtype=np.int64)
            at = np.flatnonzero(n > 0)
            if part:
                # All parts of a list have its signature, and each a name of its own: that of the group it comes from.
                one, two = np.unique(s), np.full(len(n), lane << 32 | int(pdf["bucket"].iloc[0]) if lane else 0, dtype=np.uint64)
            else:
                _, at, times = np.unique(one, return_index=True, return_counts=True)
                at, times = at[n[at] > 1], times[n[at] > 1]
            raw, w = members.tobytes(), _MEMBER.itemsize
            blobs = [raw[a:b] for a, b in zip((first[at] * w).tolist(), ((first[at] + n[at]) * w).tolist(), strict=True)]
            found.append(pd.DataFrame({"part": part, "one": one[at].view(np.int64), "two": two[at].view(np.int64), "times": times, "members": blobs}))
        give_back()
        return pd.concat(found) if found else pd.DataFrame({"part": pd.array([], dtype=bool), "one": pd.array([], dtype="int64"), "two": pd.array([], dtype="int64"), "times": pd.array([], dtype="int64"), "members": []})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _few_members(batches):
            n = batch["members"].map(len).to_numpy() // _MEMBER.itemsize
            m = np.frombuffer(b"".join(batch["members"]), dtype=_MEMBER)
            band = np.searchsorted(bands(percent), m["size"], side="right") - 1 - (m["flag"] & INDEXED == 0)
            some, back = np.unique(band, return_inverse=True)
            yield pd.DataFrame(
                {
                    "part": np.repeat(batch["part"].to_numpy(), n),
                    "list": np.repeat(batch["one"].to_numpy(), n),
                    "doc_id": m["doc"],
                    "size": m["size"],
                    "flags": m["flag"].astype(np.int32),
                    "spare": np.array([layout(b, percent)[2] for b in some.tolist()], dtype=np.int32)[back],
                    "times": np.repeat(batch["times"].to_numpy(), n),
                    "crowd": np.repeat(n, n),
                }
            )

    rows = (
        texts.mapInPandas(emit, "bucket int, lane int, blob binary")
        .groupBy("bucket", "lane")
        .applyInPandas(meet, "part boolean, one long, two long, times long, members binary")
        .groupBy("part", "one", "two")
        .agg(F.sum("times").alias("times"), F.first("members").alias("members"))
        .mapInPandas(spread, "part boolean, list long, doc_id long, size int, flags int, spare int, times long, crowd long")
    )
    rows = cut(rows)
    # The parts of a list meet by their signature; of equal lists one stays, here too.
    parts = rows.filter("part").drop("times", "crowd")
    members = F.bit_xor(F.xxhash64("doc_id", "flags")).alias("x"), F.bit_xor(F.xxhash64("flags", "doc_id")).alias("y")
    whole = parts.groupBy("list").agg(*members, F.bit_or("flags").alias("any"), F.count(F.lit(1)).alias("crowd"))
    whole = whole.filter((F.col("crowd") > 1) & (F.col("any").bitwiseAND(PROBE) > 0)).groupBy("x", "y", "crowd").agg(F.min("list").alias("list"), F.count(F.lit(1)).alias("times"))
    return rows.filter("not part").drop("part").unionByName(parts.join(whole.select("list", "times", "crowd"), "list").drop("part"))


def allocated(met: DataFrame) -> DataFrame:
    """Tolerances by cost: each set gives up looking up its most crowded segments, as many as are spare in its layout (those of
    tolerance 1 stay). What nobody looks up any more is no meeting."""
    own, seeks = F.col("flags").bitwiseAND(INDEXED) > 0, F.col("flags").bitwiseAND(PROBE + DOUBLED) == PROBE
    order = Window.partitionBy("doc_id", own).orderBy(seeks.desc(), F.desc("crowd"), "list")  # a set's own signatures: no hot key
    left_out = seeks & (F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= F.col("spare"))
    left = met.withColumn("flags", F.when(left_out, F.col("flags") - PROBE).otherwise(F.col("flags"))).select("list", "doc_id", "size", "flags")
    sought = left.groupBy("list").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bit_or("flags").alias("any")).filter((F.col("lo") != F.col("hi")) & (F.col("any").bitwiseAND(PROBE) > 0))
    return left.join(sought.select("list"), "list", "left_semi")


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link: their sketches differ in no more bits than the sets may in elements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                few = batch.iloc[i : i + 1000]
                n = np.arange(len(few))
                yield few.loc[Sketches([*few["x"], *few["y"]]).may_link(n, n + len(few), percent), ["a", "b"]]

    left, right = (sketches.select(F.col("doc_id").alias(i), F.col("sketch").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def plausible_meetings(met: DataFrame, lists: DataFrame, sketches: DataFrame, percent: int, groups: int, within: bool) -> DataFrame:
    """The pairs (a, b), a < b, that meet and may link, as `plausible` has it; of different components, unless `within`.

    lists: list, crowd, least (id). The lists are dealt into groups, those of the same least id together, so that a set's sketch
    goes to few groups; a list of more than BLOCK sets is cut into blocks, and each pair of blocks is a group of its own.
    """
    known = met.join(lists, "list").withColumn("cuts", F.ceil(F.col("crowd") / F.lit(BLOCK)).cast("int"))
    few = known.filter("cuts = 1").select(
        F.pmod(F.xxhash64(F.when(F.col("crowd") < 64, F.col("least")).otherwise(F.col("list"))), F.lit(groups)).alias("g"), "list", "doc_id", "comp", "flags", F.lit(-1).alias("part")
    )
    many = known.filter("cuts > 1").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("cell", F.struct(F.least("part", "other"), F.greatest("part", "other")))
    cells = many.select((-1 - F.abs(F.xxhash64("list", "cell") % F.lit(1 << 60))).alias("g"), "list", "doc_id", "comp", "flags", F.when(F.col("part") == F.col("other"), F.lit(-1)).otherwise(F.col("part")).alias("part"))
    dealt = few.union(cells)
    needed = dealt.select("g", "doc_id").distinct().join(sketches, "doc_id").select(F.col("g").alias("h"), F.col("doc_id").alias("id"), "sketch")

    def compare(key: tuple, rows: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(sets["id"].to_numpy(), return_index=True)
        sketched = Sketches(sets["sketch"].iloc[at].tolist())
        rows = rows.sort_values("list")
        doc = np.searchsorted(ids, rows["doc_id"].to_numpy())
        comp, flag, part = rows["comp"].to_numpy(), rows["flags"].to_numpy(), rows["part"].to_numpy()
        first = _first(rows["list"].to_numpy())
        done, fresh, waiting, out, n = np.empty(0, dtype=np.int64), [], 0, [], len(ids)

        def test() -> None:
            nonlocal done, fresh, waiting
            codes = np.setdiff1d(np.concatenate([*fresh, np.empty(0, dtype=np.int64)]), done)
            out.append(codes[sketched.may_link(codes // max(n, 1), codes % max(n, 1), percent)])
            done = np.union1d(done, codes) if len(done) < 8_000_000 else codes  # what is forgotten is compared again
            fresh, waiting = [], 0

        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
            d, f, c, p = doc[a:b], flag[a:b], comp[a:b], part[a:b]
            i = np.flatnonzero(f & PROBE)
            j = np.flatnonzero(f & INDEXED)
            pair = d[i][:, None] != d[j] if within else c[i][:, None] != c[j]
            pair &= (f[i] & DELETED == 0)[:, None] | (f[j] & DELETED == 0)
            pair &= (p[i][:, None] != p[j]) | (p[i] < 0)[:, None]
            x, y = np.nonzero(pair)
            x, y = d[i[x]], d[j[y]]
            fresh.append(np.minimum(x, y) * n + np.maximum(x, y))
            waiting += len(x)
            if waiting > 2_000_000:
                test()
        test()
        codes = np.unique(np.concatenate(out)) if out else done[:0]
        del sketched, done, out, rows, sets
        give_back()
        return pd.DataFrame({"a": ids[codes // max(n, 1)], "b": ids[codes % max(n, 1)]})

    return dealt.groupBy("g").cogroup(needed.groupBy("h")).applyInPandas(compare, "a long, b long").distinct()


def exact_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """Each text's shingles as sorted numbers, equal for equal shingles of these texts and for no others: no hashes. Texts of fewer
    words than the width have a number of their own."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() if isinstance(t, str) else [] for t in texts]
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for s in split for w in s], dtype=np.int64)
    border = np.cumsum([0, *map(len, split)])
    runs = words
    for k in range(1, width):
        runs = np.unique(runs[: max(0, len(words) - k)] * max(1, len(numbers)) + words[k:], return_inverse=True)[1]
    return [np.unique(runs[a : b - width + 1]) if b - a >= width else np.array([-1 - i][: b - a], dtype=np.int64) for i, (a, b) in enumerate(zip(border[:-1].tolist(), border[1:].tolist(), strict=True))]


def verified(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int, broadcast_rows: int, words_each: int = 400_000, partners: int = 256) -> DataFrame:
    """The pairs (a, b) whose sets link, by comparing all shingles of both, words for words.

    Of a pair, the one of more partners is `hub`. Pairs are dealt by hub (by parts of its partners, if they are many), so that
    a hub's text goes to a group once. sizes: doc_id, n_shingles; texts: doc_id, text.
    """
    degree = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree")).join(sizes, "doc_id")
    left, right = (degree.select(F.col("doc_id").alias(i), F.struct("degree", (-F.col("doc_id")).alias("id"), "n_shingles").alias(f"{i}_")) for i in "ab")
    sided = pairs.join(left, "a").join(right, "b").select("a", "b", F.greatest("a_", "b_").alias("hub"), F.least("a_", "b_").alias("other"))
    weight = sided.agg(F.sum("other.n_shingles")).first()[0] or 0
    salt = F.pmod(F.xxhash64("other.id"), F.ceil(F.col("hub.degree") / F.lit(partners)))
    pieces = pieces_for(pairs.count())
    dealt = cut(sided.select(F.pmod(F.xxhash64("hub.id", salt), F.lit(max(4, weight // words_each + 1))).alias("g"), "a", "b").coalesce(pieces))
    needed = dealt.select("g", F.col("a").alias("doc_id")).union(dealt.select("g", "b")).distinct()
    needed = F.broadcast(needed) if needed.count() <= broadcast_rows else needed
    sets = texts.join(needed, "doc_id").select(F.col("g").alias("h"), F.col("doc_id").alias("id"), "text")

    def compare(key: tuple, rows: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.drop_duplicates("id")
        found = dict(zip(texts["id"].tolist(), exact_sets(texts["text"].tolist(), width), strict=True))
        keep = []
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
            x, y = found[a], found[b]
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        del found, texts
        give_back()
        return rows.loc[keep, ["a", "b"]]

    return dealt.groupBy("g").cogroup(sets.groupBy("h")).applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node of the edges (a, b) is connected with.

    Each round every node takes the least label around it, then the label of its label, until nothing
    changes; state is cut in the shared folder after every round, in as many pieces as its size asks for.
    """
    edges = cut(edges.select("a", "b"))
    pieces = pieces_for(2 * edges.count())
    both = cut(edges.union(edges.select("b", "a")).distinct().coalesce(pieces))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).coalesce(pieces))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        nearest = labels.join(around, labels["node"] == around["n"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        nearest = cut(nearest.coalesce(pieces))
        jump = nearest.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = cut(nearest.join(jump, F.col("label") == F.col("at"), "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was").coalesce(pieces))
        changed = new.filter("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def classes(named: DataFrame, width: int, more: Callable[[list[np.ndarray]], list[bytes]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class_id, first: whether the row stands for its class; doc_id, sketch, more). A class has the same words in
    the same order; texts that share their set only are linked by the join like others."""
    rows = cut(shingle_classes(named, width, more))
    narrow = rows.select("doc_id", "n_shingles", "digest")
    grouped = narrow.filter("n_shingles > 0").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    classed = narrow.join(grouped, ["digest", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(False)).alias("first"))
    return cut(classed), rows.select("doc_id", "sketch", "more")


def representatives(named: DataFrame, classed: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of the documents that stand for their class."""
    rest = classed.filter("not first").select("doc_id").distinct()
    return named.filter("doc_id is not null").join(F.broadcast(rest) if rest.count() <= broadcast_rows else rest, "doc_id", "left_anti")


def segment_meetings(texts: DataFrame, classed: DataFrame, *, width: int, percent: int, signatures_each: int) -> DataFrame:
    """list, doc_id, size, flags: who meets whom by the segments' signatures."""
    shingles = classed.filter("first").agg(F.sum("n_shingles")).first()[0]
    # A set has about as many signatures as two thirds of its elements.
    return allocated(meetings(texts, max(8, int(shingles * 0.75) // signatures_each + 1), width, percent))


def linked(met: DataFrame, texts: DataFrame, sketches: DataFrame, *, width: int, percent: int, within: bool, star_from: int, broadcast_rows: int, rows_each: int) -> DataFrame:
    """a, b, a < b: links between classes that meet (list, doc_id, size, flags); all of them if `within`, else so many that they make
    the same components."""
    met = cut(met.withColumn("comp", F.col("doc_id")))
    members = met.count()
    groups, pieces = max(4, members // rows_each), pieces_for(members)
    # A set's weight is the number of its meetings with others: it is highest in the middle of a group of copies.
    lists = cut(met.groupBy("list").agg(F.count(F.lit(1)).alias("crowd"), F.min("doc_id").alias("least")).coalesce(pieces))
    hot = cut(met.join(lists, "list").groupBy("doc_id").agg(F.sum(F.col("crowd") - 1).alias("weight")).coalesce(pieces))
    sketches = cut(sketches.select("doc_id", "sketch").join(hot.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).coalesce(pieces))
    sizes = met.select("doc_id", F.col("size").cast("long").alias("n_shingles")).distinct()

    def check(likely: DataFrame) -> DataFrame:
        return cut(verified(likely, sizes, texts, width, percent, broadcast_rows).coalesce(pieces))

    if within:
        return check(cut(plausible_meetings(met, lists, sketches, percent, groups, True).coalesce(pieces)))
    # Crowded meetings: first with the most connected set of each.
    crowded = met.join(lists.filter(F.col("crowd") >= star_from).select("list"), "list", "left_semi").join(hot, "doc_id")
    best = crowded.groupBy("list").agg(F.max(F.struct("weight", -F.col("doc_id"), "size")).alias("hub"))
    hubs = best.select("list", (-F.col("hub.col2")).alias("h"), F.col("hub.size").alias("h_size"))
    fits = (F.col("doc_id") != F.col("h")) & (F.least("size", "h_size") * 100 >= F.greatest("size", "h_size") * percent)
    stars = crowded.join(hubs, "list").filter(fits).select(F.least("doc_id", "h").alias("a"), F.greatest("doc_id", "h").alias("b")).distinct()
    stars = cut(plausible(stars, sketches, percent).coalesce(pieces))
    links = check(stars)
    labels = components(links)
    # Then whatever meets across the components.
    known = met.drop("comp").join(labels, F.col("doc_id") == F.col("node"), "left").select("list", "doc_id", "flags", F.coalesce("label", "doc_id").alias("comp"))
    several = lists.join(known.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("list"), "list", "left_semi")
    across = cut(plausible_meetings(known, several, sketches, percent, groups, False).join(stars, ["a", "b"], "left_anti").coalesce(pieces))
    return links.union(check(across))


def similar_documents(
    docs: DataFrame,
    *,
    percent: int = PERCENT,
    width: int = WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    star_from: int = 16,
    broadcast_rows: int = 1_000_000,
    signatures_each: int = 2_000_000,
    rows_each: int = 10_000,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (least id of the same words), component_id (least id reachable by links).

    Two documents link when their shingle sets have a Jaccard similarity of percent / 100 or more.
    Documents without words have the empty set, and are linked with nothing: both ids are their own. A
    null text counts as empty. A row without an id has those of its text's class, null if it is alone.
    Repeated rows are one class. An empty table gives no rows; other columns are not read. No pair
    within a component is enumerated without need, but no link between components is missed.
    """
    named = _named(docs, id_col, text_col)
    classed, sketches = classes(named, width)
    if classed.filter("first").isEmpty():
        return classed.select("doc_id", "n_shingles", "class_id", F.col("class_id").alias("component_id"))
    texts = representatives(named, classed, broadcast_rows)
    met = segment_meetings(texts, classed, width=width, percent=percent, signatures_each=signatures_each)
    links = linked(met, texts, sketches, width=width, percent=percent, within=False, star_from=star_from, broadcast_rows=broadcast_rows, rows_each=rows_each)
    return labelled(classed, components(links))


def labelled(classed: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id. Both sides are plain exchanges of written tables, so adaptive execution can split a
    class of very many rows; labels has one row for it."""
    return classed.join(labels, classed["class_id"] == labels["node"], "left").select("doc_id", "n_shingles", "class_id", F.coalesce("label", "class_id").alias("component_id"))


def similar_links(docs: DataFrame, *, percent: int = PERCENT, width: int = WORDS, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, signatures_each: int = 2_000_000, rows_each: int = 10_000) -> DataFrame:
    """a, b, a < b: every link between classes of documents (by the least id of each), as similar_documents has links and classes.

    Their number grows with the square of a group of near copies that all differ; copies of the same words are one class.
    """
    named = _named(docs, id_col, text_col)
    classed, sketches = classes(named, width)
    if classed.filter("first").isEmpty():
        return docs.sparkSession.createDataFrame([], "a long, b long")
    texts = representatives(named, classed, broadcast_rows)
    met = segment_meetings(texts, classed, width=width, percent=percent, signatures_each=signatures_each)
    return linked(met, texts, sketches, width=width, percent=percent, within=True, star_from=0, broadcast_rows=broadcast_rows, rows_each=rows_each)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each component kept, that of least id, with their columns, whatever those are called.

    Documents without words or id all stay. Repeated rows of the id that stays all stay. Nulls, ties and
    empty tables are as in similar_documents.
    """
    found = similar_documents(docs, id_col=id_col, text_col=text_col, **options)
    name = fresh("going", docs)
    going = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(going, F.col(id_col).cast("long") == F.col(name), "left_anti")


__all__ = ["components", "exact_sets", "one_of_each", "shingle_sets", "signatures", "similar_documents", "similar_links"]

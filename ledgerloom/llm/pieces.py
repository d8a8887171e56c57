"""A SentencePiece model file as tables: pieces, scores, byte fallback, and the seam test of its BPE.

Two facts about byte-pair encoding (published for the BPE family in general) carry operators 1 and 2:
a sequence of tokens is the encoding of its text if and only if each neighbouring pair is the encoding
of the pair's own text, and every prefix of a text has exactly one last token in its encoding. The
encoding can therefore be read off position by position, by asking of each piece that ends there
whether it can stand to the right of the last token of what is before it.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import SparkSession

#: Stands for the text's start and for characters that no piece spells: nothing merges with it.
EDGE = -1
WORD_MARK = "▁"


class PieceModel:
    """Pieces spell the word mark as a plain space here. Built from the bytes of a .model file."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        kind = proto.trainer_spec.model_type
        if kind not in (proto.trainer_spec.BPE, proto.trainer_spec.UNIGRAM):
            raise ValueError("only BPE and unigram models are read")
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with the word mark in front is read")
        types = pb.ModelProto.SentencePiece
        self.is_bpe = kind == proto.trainer_spec.BPE
        self.dummy_prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.ids: dict[str, int] = {}
        self.scores = [p.score for p in proto.pieces]
        self.byte_ids = [0] * 256
        self.byte_fallback = bool(proto.trainer_spec.byte_fallback)
        self.unk_id = 0
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == types.USER_DEFINED:
                raise ValueError("user-defined pieces are not read")
            text = p.piece.replace(WORD_MARK, " ")
            out = text.encode()
            if p.type == types.BYTE:
                out = bytes([int(p.piece[3:5], 16)])
                self.byte_ids[out[0]] = i
            elif p.type == types.UNKNOWN:
                self.unk_id, out = i, proto.trainer_spec.unk_surface.encode()
            elif p.type == types.CONTROL:
                out = b""
            elif p.type == types.NORMAL:
                self.ids[text] = i
            else:
                raise ValueError("unused pieces are not read")
            self.surface.append(out)
        self.longest = max(map(len, self.ids), default=1)
        #: No piece goes on past the end of a word, so that words are encoded one by one.
        self.by_word = not any(" " in p.lstrip(" ") for p in self.ids)
        if self.is_bpe and not all(c in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")

    # -- texts ---------------------------------------------------------------------------------

    def normalised(self, text: str | None) -> str:
        """Null counts as empty. A word mark in the text is a space, as it is for the library."""
        if not text:
            return ""
        text = text.replace(WORD_MARK, " ")
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return " " + text if self.dummy_prefix and text else text

    def words(self, text: str) -> list[str]:
        """A normalised text in pieces of its own: spaces with what follows up to the next space."""
        if not text:
            return []
        if not self.by_word:
            return [text]
        parts = text.split(" ")
        if parts[0] == "" and "" not in parts[1:]:
            return [" " + x for x in parts[1:]]
        out, spaces = [], 0
        for i, x in enumerate(parts):
            spaces += i > 0
            if x:
                out.append(" " * spaces + x)
                spaces = 0
        return [*out, " " * spaces] if spaces else out

    @cached_property
    def _inner(self) -> set[str]:
        """Neighbouring characters of all pieces: between any others no piece reaches across."""
        return {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    def segments(self, word: str) -> list[str]:
        """The word cut wherever no piece reaches across; each segment is encoded by itself."""
        if word.isalpha() or word[1:].isalpha():  # such words are hardly ever cut, and cutting is never needed
            return [word]
        inner = self._inner
        cuts = [i for i, pair in enumerate(map(str.__add__, word, word[1:]), 1) if pair not in inner]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_fallback else [self.unk_id]

    def decode(self, ids: list[int]) -> str:
        """The text of these ids; bytes that are no UTF-8 become U+FFFD. The space that encoding puts in front goes."""
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out

    # -- BPE -----------------------------------------------------------------------------------

    @cached_property
    def _rank(self) -> dict[str, int]:
        """Equal scores have equal ranks; of equal ranks, the leftmost pair merges first."""
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        return {p: order[self.scores[i]] for p, i in self.ids.items()}

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The plain encoding of a short text, merge by merge, and the last pair that was merged."""
        parts, rank, last = list(text), self._rank, None
        while len(parts) > 1:
            best = min(((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    @cached_property
    def _split(self) -> dict[str, tuple[str, str] | None]:
        """The two parts that each reachable piece is merged from; None for characters."""
        out = {}
        for p in self.ids:
            parts, last = self.merge(p)
            if len(parts) == 1:
                out[p] = last
        return out

    @cached_property
    def _uneven(self) -> set[str]:
        """Pieces with a part that merges no earlier than the piece itself: merges do not come in the order of ranks there."""
        rank, bad = self._rank, set()
        for p in sorted(self._split, key=len):
            if (s := self._split[p]) and (s[0] in bad or s[1] in bad or any(len(x) > 1 and rank[x] >= rank[p] for x in s)):
                bad.add(p)
        return bad

    @cached_property
    def spelled(self) -> dict[str, int]:
        """The pieces that an encoding can hold, with their ids."""
        return {p: self.ids[p] for p in self._split} if self.is_bpe else self.ids

    @cached_property
    def _names(self) -> dict[int, str]:
        return {i: p for p, i in self.ids.items()}

    @cached_property
    def _edges(self) -> dict[str, tuple[list, list]]:
        return {}

    def _edge(self, piece: str) -> tuple[list, list]:
        """What stands at the piece's right and left border as it is built, and the rank of the merge that replaces it."""
        if (got := self._edges.get(piece)) is None:
            sides = []
            for side in (1, 0):
                chain, x, until = [], piece, 1 << 60
                while True:
                    chain.append((x, until))
                    if (s := self._split[x]) is None:
                        break
                    until, x = self._rank[x], s[side]
                sides.append(chain[::-1])
            got = self._edges[piece] = (sides[0], sides[1])
        return got

    def can_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the two pieces' text is these two pieces."""
        if left == EDGE:
            return True
        a, b = self._names[left], self._names[right]
        if self.by_word and b[0] == " " and a[-1] != " ":
            return True
        if a in self._uneven or b in self._uneven:
            return self.merge(a + b)[0] == [a, b]
        ends, starts, i, j = self._edge(a)[0], self._edge(b)[1], 0, 0
        while True:
            (x, x_until), (y, y_until) = ends[i], starts[j]
            across = self._rank.get(x + y)
            if across is not None and (across < x_until and across <= y_until):
                return False
            if x_until == y_until == 1 << 60:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


_LOADED: dict[bytes, PieceModel] = {}


def load(data: bytes) -> PieceModel:
    """The model of these bytes, read once in a Python process."""
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED[key] = PieceModel(data)
    return _LOADED[key]


def shipped(spark: SparkSession, path: str):
    """The file's bytes as a broadcast (a vocabulary file: a few MB whatever the corpus), so executors need no copy of it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())

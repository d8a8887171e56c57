import hashlib
import json
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ledgerloom.llm import queries, token_alignment

from ..conftest import rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, slice int, part string"
DATA = "/root/testdata/sf0.001"


def table(spark, items):
    return spark.createDataFrame([(i, t, "x", 1, "p") for i, t in items], SCHEMA)


def both(text, a=Tokenizer.from_file(A), b=SentencePieceProcessor(model_file=B)):
    """(ids and byte ranges of A, of B) by the libraries; nothing where one does not spell the text."""
    if not text:
        return [], []
    a.encode_special_tokens = True
    letters = token_alignment.byte_letters()
    spelled_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    spelled_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        spelled_b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if not all(b"".join(x for _, x in s) == want for s in (spelled_a, spelled_b)):
        return [], []
    out = []
    for s in (spelled_a, spelled_b):
        at, ranges = 0, []
        for i, x in s:
            ranges.append((i, at, at + len(x)))
            at += len(x)
        out.append(ranges)
    return tuple(out)


def brute(items):
    every = [(i, *both(t)) for i, t in items]
    count, found = Counter(), []
    for _, a, b in every:
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        count.update(links)
        found.append(links)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (i, a, b), links in zip(every, found, strict=True):
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ["|".join(",".join(str(t) for t, s, e in side if lo <= s and e <= hi) for side in (a, b)) for lo, hi in zip([0, *ends], ends)]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=repr)


COLUMNS = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
ODD = [
    None, "", " ", "\n", "  two  spaces  ", "line\nline\n\nline \n x", "tab\tand\r\nreturn", "<|endoftext|> and <s> </s> <0x41> <unk>", "under▁score", "▁", "naïve über straße", "你好世界 \U0001f600\U0001f468‍\U0001f469",
    "nbsp x   y z\x0bq\x85w", "a" * 3000, "don't we'll it's I'M", "1234567 3.14159 -- !!! ...", "\x00 nul", "end ", "x", "word " * 50, "\u0001\u0002", "é combining", "'s 's",
]


def test_alignment_against_the_libraries(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = sorted(docs, key=lambda x: len(x[1] or ""))[:60] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_005, ODD[5]), (None, "line\nline"), (None, None)]
    want = brute(items)
    got = token_alignment.aligned(table(spark, items), A, B)
    assert rows(got, *COLUMNS) == want
    cramped = token_alignment.aligned(table(spark, items).repartition(3), A, B, parts=3, lane=50, texts_each=400, window=5)
    assert rows(cramped, *COLUMNS) == want


def test_empty_table(spark):
    assert token_alignment.aligned(table(spark, []), A, B).count() == 0
    assert rows(token_alignment.aligned(table(spark, [(1, None), (2, "")]), A, B), *COLUMNS) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_registered_query(spark):
    """Token counts of whole texts, and what the counts must add up to."""
    found = queries.QUERIES["op13_alignment"](spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    assert sorted(found["doc_id"]) == sorted(docs.index)
    for r in found.itertuples():
        a, b = both(docs[r.doc_id])
        assert (r.n_a, r.n_b) == (len(a), len(b)) and r.n_groups <= min(r.n_a, r.n_b) <= r.n_links and r.n_best <= r.n_links <= max(r.count_sum, 0)


def test_runs_count_and_give_back():
    words = [token_alignment.Stretch(1, 1, 1, True, b"", np.array([5 << 32 | 9, 6 << 32 | k], dtype="<i8").tobytes()) for k in range(3)]
    numbers, doc = np.array([0, 1, 2, 0, 1, 1]), np.array([0, 0, 3, 3, 3, 4])
    found = list(token_alignment.runs(words, numbers, doc, 2))
    codes, counts = token_alignment.counted([p for _, _, p, _ in found])
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {5 << 32 | 9: 6, 6 << 32: 2, 6 << 32 | 1: 3, 6 << 32 | 2: 1}
    best = np.array([1, 0, 1, 0])
    given = [tuple(x.tolist() for x in token_alignment.contributions(p, d, codes, counts, best)) for _, _, p, d in found]
    assert given == [([0, 3, 4], [1, 1, 1], [5, 6, 3]), ([0, 3, 4], [2, 3, 1], [12, 18, 6])]


def test_byte_letters_are_the_vocabularys():
    vocab = json.load(open(A))["model"]["vocab"]
    letters = token_alignment.byte_letters()
    assert len(letters) == 256 and sorted(letters.values()) == list(range(256)) and set("".join(vocab)) <= set(letters)
    assert pytest.approx(len(vocab), abs=2) == 50257

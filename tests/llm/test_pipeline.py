import hashlib
import re
from collections import Counter

import corpus_pipeline
from ledgerloom.llm import language_id, similarity_join
from ledgerloom.llm.queries import ORACLES, QUERIES

from .test_documents import classes, fill, language
from .test_tokenizers import plain

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns
        if name == "near_duplicates":
            left = similarity_join.similar_documents(after)
            assert left.filter("n_shingles > 0").groupBy("component_id").count().filter("count > 1").count() == 0
        docs = spark.createDataFrame(after.collect(), after.schema)
    want = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in got) == want and all(r["n_tokens"] == len(r["token_ids"]) for r in got)


def lines_cut(docs):
    """doc_id -> text without the lines on more than a tenth of the source's different documents."""
    lines = {r["doc_id"]: re.split(r"\r?\n", r["text"]) for r in docs}
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r")
    pages = {(r["source"], frozenset(map(bare, lines[r["doc_id"]])) - {""}) for r in docs}
    count, total, out = Counter((s, x) for s, page in pages for x in page), Counter(s for s, _ in pages), {}
    for r in docs:
        stay = [x for x in lines[r["doc_id"]] if not bare(x) or not count[r["source"], bare(x)] > 0.1 * total[r["source"]]]
        out[r["doc_id"]] = "\n".join(stay) if len(stay) < len(lines[r["doc_id"]]) and any(map(bare, stay)) else r["text"]
    return out


def epochs(rows):
    """doc_id -> how often the mix holds it; rows: (doc_id, source, words)."""
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, fill([size[s] for s in order], [1 + i % 3 for i in range(len(order))], 3), strict=True))
    upto, out = Counter(), {}
    for i, s, n in sorted(rows, key=lambda r: hashlib.md5(f"mix-1:{r[1] or ''}:{r[0]}".encode()).hexdigest()):
        upto[s] += n
        passes = int(target[s] // size[s]) if size[s] else 0
        out[i] = min(3, passes + (upto[s] - n / 2 <= target[s] - passes * size[s]))
    return out


def test_pipeline_against_brute_force(spark):
    """All stages again in plain Python, over the whole table."""
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    samples = language_id.training_samples(table)
    docs = [r for r in table.collect() if (found := language(samples, r["text"]))[0] != "und" and found[1] >= language_id.LEAST_SCORE]
    text = lines_cut(docs)
    text = {i: text[i] for i, _, least in classes(list(text.items())) if i == least}
    taken = epochs([(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]))) for r in docs if r["doc_id"] in text])
    want = Counter({(i, tuple(plain(text[i]))): n for i, n in taken.items() if n})
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, DATA).collect()) == want


def test_the_language_stage_keeps_clean_documents_and_rejects(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n, samples = docs.count(), language_id.training_samples(docs)
    kept = language_id.in_known_language(docs, samples)
    assert 0.99 * n <= kept.count() <= n and kept.filter("lang is null").count() == 0
    # Half of a text in each of two languages is in neither.
    half = [f"{samples['de'][i : i + 300]} {samples['en'][i : i + 300]}" for i in range(0, 9000, 300)]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*half, "12 34", None, samples["fr"][:400]])], "doc_id long, text string")
    left = {r["doc_id"] for r in language_id.in_known_language(odd, samples, lang_col=None, least_score=0.2).collect()}
    assert left == {32}


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, language_id, line_dedup, mixing, sharding, similarity_join, topk_search

from ..conftest import rows

SCHEMA = "doc_id long, text string, lang string, source string, _key string, size string"
DATA = "/root/testdata/sf0.001"


def table(spark, items):
    """(doc_id, text, lang, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*x, "k", "s") for x in items], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# -- similarity join ---------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(items):
    sets = {i: shingles(t) for i, t in items}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted(((i, len(sets[i]), root(i)) for i in ids), key=repr)


def links(items):
    least = {}
    for i, t in sorted(items):
        if s := frozenset(shingles(t)):
            least.setdefault(s, i)
    common = lambda a, b: len(a & b)
    return sorted(((i, j) for a, i in least.items() for b, j in least.items() if i < j and 100 * common(a, b) >= 75 * len(a | b)), key=repr)


def near_copies():
    rng, out = random.Random(11), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    for n in (6, 9, 20, 40, 90, 200):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for _ in range(rng.randint(1, 9)):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 25))):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.randint(0, 1)] = [word()] if rng.random() < 0.6 else []
                out.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    passage = " ".join(word() for _ in range(12))
    out += [f"{passage} {' '.join(word() for _ in range(rng.randint(3, 60)))}" for _ in range(60)]
    return out + [None, "", " \n ", "one", "ONE", "one two", "İ i", "one two three four five"] * 2


def test_similarity_join_against_all_pairs(spark, monkeypatch):
    items = list(enumerate(near_copies()))
    df = table(spark, [(i, t, None, None) for i, t in items])
    for star_from, block in ((2, 1024), (10**9, 7)):
        monkeypatch.setattr(similarity_join, "BLOCK", block)
        got = similarity_join.similar_documents(df, broadcast_rows=5, signatures_each=2000, star_from=star_from)
        assert rows(got, "doc_id", "n_shingles", "component_id") == classes(items)
    assert rows(similarity_join.similar_links(df, signatures_each=2000)) == links(items)
    stay = {c for _, _, c in classes(items)}
    assert {r["doc_id"] for r in similarity_join.one_of_each(df).collect()} == stay


def test_similarity_join_edges(spark):
    assert similarity_join.similar_documents(table(spark, [])).count() == 0
    blank = similarity_join.similar_documents(table(spark, [(1, None, None, None), (2, " ", None, None)]))
    assert rows(blank, "doc_id", "n_shingles", "component_id") == [(1, 0, 1), (2, 0, 2)]
    again = similarity_join.similar_documents(table(spark, [(7, "a b c d e f", None, None)] * 3 + [(None, "a b c d e f", None, None)]))
    assert rows(again, "component_id") == [(7,)] * 4


def test_signatures_lose_no_pair():
    rng, kept = np.random.default_rng(5), 0
    for _ in range(600):
        x = np.unique(rng.integers(0, 2**63, int(rng.choice([3, 5, 9, 20, 60, 200])) + int(rng.integers(0, 5))).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[int(rng.integers(0, len(x) // 6 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 3 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if len(y) and 100 * common >= 75 * (len(x) + len(y) - common):
            kept += 1
            found = defaultdict(list)
            for s, w, f in zip(*(a.tolist() for a in similarity_join.signatures([x, y])), strict=True):
                found[s].append((w, f))
            assert any(
                w != v and f & 1 and g & 4 and not f & g & 2 for hits in found.values() for w, f in hits for v, g in hits
            )
    assert kept > 200


# -- exact dedup -------------------------------------------------------------------------------


def test_fingerprints_combine():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    whole = exact_dedup.fingerprint(data)
    for size in (1, 7, 1000):
        assert exact_dedup.fingerprint_of(data[i : i + size] for i in range(0, len(data), size)) == whole
    assert exact_dedup.fingerprint(data[:-1] + b"x") != whole


def test_chunks_of_huge_texts_are_hashed_apart(spark):
    long = " ".join(f"w\u00f6rd{i}" for i in range(400))
    items = [(1, long), (2, long.replace(" ", "\n")), (2, long), (2, long), (3, long + "x"), (4, " " * 3000), (5, None), (6, "\U0001f600 " * 900), (None, long), (7, "short")]
    df = table(spark, [(*x, None, None) for x in items])
    apart = exact_dedup.fingerprints(df, huge=1000, chunk=64)
    whole = exact_dedup.fingerprints(df, chunk=64)
    assert sorted(map(str, apart.collect())) == sorted(map(str, whole.collect()))
    assert sorted(map(str, exact_dedup.exact_duplicates(df, huge=1000).collect())) == sorted(map(str, exact_dedup.exact_duplicates(df).collect()))


def test_exact_dedup_against_dictionary(spark, docs):
    items = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "ab"), (1005, "a b"), (1006, "a  b"), (1007, "x" * 300_000), (1008, "x" * 299_999 + " x"), (1009, "x" * 299_999 + "y")]
    groups = defaultdict(list)
    for i, t in items:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = sorted(((i, min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g), key=repr)
    for limit in (0, 10**6):
        got = exact_dedup.exact_duplicates(table(spark, [(i, t, None, None) for i, t in items]), broadcast_rows=limit, chunk=1000)
        assert rows(got) == want
    assert exact_dedup.deduplicated(table(spark, [(i, t, None, None) for i, t in items])).count() == len(groups)
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    rows_ = [(1, "abc", None, None), (2, "abd", None, None), (3, "a b c", None, None)]
    real = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda *a, **k: real(*a, **k).withColumn("fp", F.lit("0")))
    assert rows(exact_dedup.exact_duplicates(table(spark, rows_)), "doc_id", "keep_id") == [(1, 3), (2, 2), (3, 3)]


# -- language ID -------------------------------------------------------------------------------


def parsed(sample, text):
    """(phrases, of which characters that the sample lacks) of the greedy parse, by searching the sample."""
    n = unknown = i = 0
    while i < len(text):
        k = 1
        unknown += text[i] not in sample
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n, unknown


def letters(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return f" {' '.join(words)} " if words else ""


def language(samples, text):
    """(language, score) by brute force."""
    t = letters(text)
    if not t:
        return "und", 0.0
    bits = {k: math.log2(max(2, len(x))) for k, x in samples.items()}
    costs = sorted(((n - u) * bits[k] + u * max(bits.values()), k) for k, x in samples.items() for n, u in [parsed(x, t)])
    return costs[0][1], (1.0 - costs[0][0] / costs[1][0] if len(costs) > 1 else 1.0)


def test_parse_against_search(monkeypatch):
    rng = random.Random(3)
    for few in (1, 1000):
        monkeypatch.setattr(language_id, "FEW", few)
        for _ in range(40):
            samples = {k: "".join(rng.choice(a) for _ in range(rng.randint(1, 60))) for k, a in (("x", "ab "), ("y", "abc "), ("z", "éb "))}
            texts = ["".join(rng.choice("abcdé. 1") for _ in range(rng.randint(0, 25))) for _ in range(20)] + [None]
            langs, scores = language_id.CrossParser(samples).predict(texts)
            for t, lang, score in zip(texts, langs, scores.tolist(), strict=True):
                want = language(samples, t)
                assert lang == want[0] and math.isclose(score, want[1], abs_tol=1e-12)
    # A phrase runs over the borders of words.
    sample = letters("der kleine hund geht in das haus")
    codes = language_id.normalised("Der kleine -- Hund geht")
    count, literals = language_id.ParseTable(sample).phrases(codes, np.array([0]), np.array([len(codes)]))
    assert (count[0], literals[0]) == (1, 0)


def test_scripts_of_many_characters_are_known_in_full(monkeypatch):
    """More characters than a table has columns: stretches of the sample are one phrase, and all counts are those of a search."""
    rng = random.Random(12)
    some = [chr(0x4E00 + 7 * k) for k in range(1500)]
    sample = letters("".join(rng.choice(some) if rng.random() < 0.9 else " " for _ in range(4000)))
    copied = sample.strip()[1000:1400]
    other = "".join(rng.choice(some) for _ in range(60)) + chr(0x4E01) + sample[50:90] + "abc"
    texts = [letters(t) for t in (copied, other, sample[7:300] * 2, "abc", copied[:5])]
    for few in (1, 1000):
        monkeypatch.setattr(language_id, "FEW", few)
        for columns in (254, 3, 5000):
            table_ = language_id.ParseTable(sample, columns)
            codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in sorted(texts, key=len, reverse=True)]
            sizes = np.array([len(c) for c in codes])
            count, literals = table_.phrases(np.concatenate(codes), np.cumsum(sizes) - sizes, sizes)
            assert list(zip(count.tolist(), literals.tolist(), strict=True)) == [parsed(sample, t) for t in sorted(texts, key=len, reverse=True)]
    codes = np.frombuffer(copied.encode("utf-32-le"), dtype=np.uint32)
    count, literals = language_id.ParseTable(sample).phrases(codes, np.array([0]), np.array([len(codes)]))
    assert (count[0], literals[0]) == (1, 0)
    parser = language_id.CrossParser({"zh": sample, "en": letters("the cat sat on the mat and looked at the dog")})
    assert parser.predict([copied, "the dog sat on the cat"])[0] == ["zh", "en"]


def test_a_small_sample_wins_nothing_by_being_small(spark, docs):
    samples = language_id.training_samples(docs) | {"tiny": " ok ", "few": " guten tag "}
    assert language_id.identify_languages(docs, samples).filter("lang_pred in ('tiny', 'few')").count() == 0


def test_predictions_against_brute_force(spark, docs):
    samples = {k: x[:3000] for k, x in language_id.training_samples(docs).items()}
    short = docs.filter("length(text) < 3000")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(short, samples).collect()}
    for r in short.collect():
        want = language(samples, r["text"])
        assert got[r["doc_id"]][0] == want[0] and math.isclose(got[r["doc_id"]][1], want[1], abs_tol=1e-9)


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = language_id.training_samples(docs)
    assert set(samples) == {"de", "en", "es", "fr"} and all(len(s) <= language_id.SAMPLE_CHARS + 2 for s in samples.values())
    got = language_id.identify_languages(docs, samples).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == r["lang"] for r in got if r["held_out"] and r["lang"]]
    assert len(held) > 150 and sum(held) / len(held) > 0.95
    odd = table(spark, [(1, None, None, None), (2, "", None, None), (3, "12 _ 3.5 !", None, None), (4, "the and of " * 5000, None, None), (None, "der die und", None, None)])
    assert rows(language_id.identify_languages(odd, samples), "doc_id", "lang_pred") == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de")], key=repr)
    known = language_id.in_known_language(odd, samples)
    assert known.columns == odd.columns and rows(known, "doc_id", "lang") == [(4, "en"), (None, "de")]
    # The prediction decides, and a score that is too low rejects.
    mixed = table(spark, [(1, "the and of " * 20, "xx", None), (2, "der die und " * 20, None, None)])
    assert rows(language_id.in_known_language(mixed, samples, languages=["de"]), "doc_id", "lang") == [(2, "de")]
    assert language_id.in_known_language(mixed, samples, least_score=1.1).count() == 0
    assert rows(language_id.in_known_language(mixed.union(mixed), samples), "doc_id", "lang") == [(1, "xx")] * 2 + [(2, "de")] * 2
    assert language_id.in_known_language(table(spark, []), samples).count() == 0
    assert rows(language_id.identify_languages(odd, {}), "lang_pred") == [("und",)] * 5
    assert language_id.training_samples(table(spark, [])) == {}


# -- sharding and mixing -----------------------------------------------------------------------


def sources(n=400):
    rng = random.Random(8)
    return [(i, " ".join("w" for _ in range(rng.randint(0, 40))) or None, None, rng.choice(["a"] * 6 + ["b", "c", "é", None])) for i in range(n)]


def test_shards_are_even_and_mixed(spark):
    items = sources()
    got = sharding.interleaved_shards(table(spark, items), 8, rows_each=20).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
        text = items[r["doc_id"]][1] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text.encode()), "rows", None)
    assert sorted(by_shard) == list(range(8)) and all(len(x) == 50 for x in by_shard.values())
    assert all(sorted(r["slot"] for r in x) == list(range(50)) for x in by_shard.values())
    total = Counter(x[3] for x in items)
    for x in by_shard.values():
        assert all(abs(Counter(r["source"] for r in x)[s] - n / 8) < 2 for s, n in total.items())
    again = sharding.interleaved_shards(table(spark, items).repartition(7), 8, rows_each=20)
    assert rows(again, "doc_id", "shard", "slot") == sorted(((r["doc_id"], r["shard"], r["slot"]) for r in got), key=repr)


def test_shards_of_small_and_repeated_tables(spark):
    assert sharding.interleaved_shards(table(spark, [])).count() == 0
    three = sharding.interleaved_shards(table(spark, [(1, "a", None, None)] * 2 + [(None, None, None, "s")]), 8).collect()
    assert len({(r["shard"], r["slot"]) for r in three}) == 3 and all(r["slot"] == 0 for r in three)


def fill(sizes, weights, cap):
    """Targets by sharing the excess again and again."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > cap * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        free -= over
    return target


def test_targets_and_taken_words(spark):
    items = sources()
    got = mixing.mix_plan(table(spark, items), rows_each=20).collect()
    sizes = Counter()
    for _, t, _, s in items:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, fill([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))], 3), strict=True))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]])
        assert r["taken"] == r["size"] * r["epochs"] and 0 <= r["epochs"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 20 for s in order)
    assert rows(mixing.mix_plan(table(spark, items).repartition(5), rows_each=20)) == sorted((tuple(r) for r in got), key=repr)
    mixed = mixing.mixed_documents(table(spark, items), rows_each=20)
    assert mixed.columns == table(spark, items).columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["epochs"] for r in got if r["epochs"]})


def test_clashing_names_and_repeated_rows(spark):
    """Columns of the names that the operators use inside, and rows that share an id."""
    odd = ["_going", "_dropped", "_epochs", "_epoch", "_row", "_found", "_host", "_kept", "comp", "list", "epochs", "_bucket"]
    df = table(spark, [(1, "a b c d e f", None, "s")] * 3 + [(2, "a b c d e f", None, "s"), (3, None, None, None)])
    df = df.select("*", *[F.lit("x").alias(c) for c in odd])
    kept = similarity_join.one_of_each(df)
    assert kept.columns == df.columns and rows(kept, "doc_id") == [(1,)] * 3 + [(3,)]
    kept = exact_dedup.deduplicated(df)
    assert kept.columns == df.columns and rows(kept, "doc_id") == [(1,)] * 3 + [(3,)]
    assert language_id.in_known_language(df, {"en": " a b c d e f "}).columns == df.columns
    assert line_dedup.clean_documents(df).columns == df.columns
    mixed, plan = mixing.mixed_documents(df), Counter()
    for r in mixing.mix_plan(df).collect():
        plan[r["doc_id"]] += r["epochs"]
    assert mixed.columns == df.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: n for k, n in plan.items() if n})


def test_mixing_edges(spark):
    assert mixing.mix_plan(table(spark, [])).count() == 0
    blank = mixing.mix_plan(table(spark, [(1, None, None, None), (1, None, None, None), (None, " ", None, "s")])).collect()
    assert [r["taken"] for r in blank] == [0, 0, 0]


# -- line dedup --------------------------------------------------------------------------------


def test_site_lines(spark):
    items = [(i, f"menu\nown {i}\n\n menu \nfooter {i % 2}", None, "a") for i in range(10)] + [(20 + i, "menu\nx", None, None) for i in range(2)] + [(30, None, None, "a")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.clean_documents(table(spark, items), ratio=0.6).collect()}
    # menu is on 10 of 11 pages of a, each footer on 5; all lines of the null host's two pages repeat, so they stay as they are.
    assert got[3] == "own 3\n\nfooter 1" and got[20] == "menu\nx" and got[30] is None and len(got) == 13
    narrow = line_dedup.clean_documents(table(spark, items), ratio=0.4, broadcast_keys=0)
    assert {r["text"] for r in narrow.filter("doc_id < 2").collect()} == {"own 0\n", "own 1\n"}
    assert narrow.columns == table(spark, items).columns and line_dedup.clean_documents(table(spark, [])).count() == 0


def test_a_large_group_of_copies_keeps_its_text(spark):
    copy = "\n".join(f"the copied line {w} of a text that came often" for w in ("one", "two", "three"))
    items = [(i, f"menu\n{copy}", None, "a") for i in range(10)] + [(10 + i, f"menu\nown {i}", None, "a") for i in range(20)]
    items += [(40, "menu", None, "a"), (41, " menu \n\nmenu", None, "a")]
    cleaned = line_dedup.clean_documents(table(spark, items))
    got = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    # A third of the source are copies: their own lines stay, the menu goes; a text of nothing but frequent lines stays.
    assert {got[i] for i in range(10)} == {copy} and got[10] == "own 0" and (got[40], got[41]) == ("menu", " menu \n\nmenu")
    left = [r["doc_id"] for r in similarity_join.one_of_each(cleaned).collect() if r["text"] == copy]
    assert left == [0]
    # Copies with a line missing or in another place are not the same text, and all of their lines are frequent.
    parts = [f"line {w} of many near copies" for w in "abcdef"]
    near = [(i, "\n".join(parts[i % 6 :] + parts[: i % 6 - 1]), None, "a") for i in range(12)] + [(20 + i, f"own text {i}", None, "a") for i in range(24)]
    assert rows(line_dedup.clean_documents(table(spark, near)), "doc_id", "text") == rows(table(spark, near), "doc_id", "text")


def test_pages(spark):
    html = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><li><a href='/x'>menu</a></li></nav><!-- ad --><p>Own <b>{}</b> text</p></body></html>"
    pages = spark.createDataFrame([(i, f"https://u@Site.example:80/{i}", html.replace("{}", str(i))) for i in range(4)] + [(9, None, None), (10, "nonsense", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in line_dedup.clean_pages(pages, ratio=0.5).collect()}
    assert (got[2]["host"], got[2]["n_lines"], got[2]["n_dropped"], got[2]["text"]) == ("site.example", 3, 2, "Own 2 text")
    assert (got[9]["n_lines"], got[9]["text"], got[10]["host"]) == (0, "", None)


def test_pages_of_small_hosts_keep_their_own_lines(spark):
    """On a host of fewer than ten pages every line is over a tenth; what only one page has stays there, what two have goes."""
    items = [(i, f"http://three/{i}", f"<p>menu</p><p>own {i}</p><p>own {i}</p><p>{'pair' if i else 'alone'}</p>") for i in range(3)]
    items += [(9, "http://one/", "<p>all</p><p>of it</p>"), (10, None, "<p>of no host</p>")]
    items += [(20 + i, f"http://large/{i}", f"<p>{'two' if i < 2 else 'x'}</p><p>line {i}</p>") for i in range(25)]
    got = {r["page_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.clean_pages(spark.createDataFrame(items, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == [(4, 1, "own 0\nown 0\nalone"), (4, 2, "own 1\nown 1"), (4, 2, "own 2\nown 2")]
    assert got[9] == (2, 0, "all\nof it") and got[10] == (1, 0, "of no host")
    assert got[20] == (2, 0, "two\nline 0") and got[44] == (2, 1, "line 24") and len(got) == len(items)


# -- top-k -------------------------------------------------------------------------------------


def test_top_k_against_all_scores(spark):
    rng = random.Random(6)
    vectors = {i: [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, rng.uniform(-1, 1)]) for _ in range(6)] for i in range(300)}
    odd = [(1000, None), (1050, [None] * 6), (1100, [math.nan] * 6), (1150, [math.inf] * 6), (1200, [])]
    df = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = topk_search.exact_top_k(df, F.col("vec_id") % 50 == 0, k=5, candidates_each=20, queries_each=1, bounds_each=3)
    ints = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    want = []
    for q in range(0, 300, 50):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert rows(got) == sorted(want, key=repr)


def test_top_k_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert rows(topk_search.exact_top_k(df, F.col("vec_id") == 0)) == [(0, 1, 1, 131072), (0, 2, 2, -65536)]
    assert topk_search.exact_top_k(df.filter("vec_id < 0"), F.col("vec_id") == 0).count() == 0
    big = spark.createDataFrame([(0, [1e6, 1e6]), (1, [1e6, 1e6])], "vec_id long, embedding array<double>")
    assert rows(topk_search.exact_top_k(big, F.col("vec_id") == 0), "score") == [(2 * 256_000_000**2,)]
    low = spark.createDataFrame([(0, [2.0**24]), (1, [-1.5 * 2.0**22]), (2, [0.0]), (2, [0.0])], "vec_id long, embedding array<double>")
    assert rows(topk_search.exact_top_k(low, F.col("vec_id") == 0, k=4), "vec_id", "score") == [(1, -6917529027641081856), (2, 0), (2, 0)]
    with pytest.raises(Exception, match="does not fit a long"):
        topk_search.exact_top_k(spark.createDataFrame([(0, [1e9, 0.0]), (1, [1e9, 1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_top_k_visits_few_cells_of_vectors_that_point_apart(spark):
    """Twelve directions: a query's k-th score in its own group beats the bounds of all others. Without direction nothing is pruned, nor lost."""
    rng = np.random.default_rng(2)
    apart = np.eye(12)[np.arange(600) % 12] * rng.uniform(2, 3, (600, 1)) + rng.normal(size=(600, 12)) * 0.02
    flat = rng.normal(size=(600, 12))
    for vectors, most in ((apart, 0), (flat, 10**9)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        rows_ = df.select(F.col("vec_id").alias("id"), topk_search.integer_vector(F.col("embedding")).alias("v"), (F.col("vec_id") % 50 == 0).alias("query"))
        search = topk_search.Search(rows_, 5, 100, 10, 4096)
        first = search.first_cells()
        second = search.second_cells(first, search.scored(first))
        assert first.agg(F.sum(F.size("at"))).first()[0] == 12 and (second.agg(F.sum(F.size("at"))).first()[0] or 0) <= most
        ints = np.floor(256 * vectors).astype(np.int64)
        scores = ints @ ints.T
        want = []
        for q in range(0, 600, 50):
            order = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[q, i], i))[:5]
            want += [(q, r + 1, i, int(scores[q, i])) for r, i in enumerate(order)]
        assert rows(topk_search.exact_top_k(df, F.col("vec_id") % 50 == 0)) == sorted(want, key=repr)

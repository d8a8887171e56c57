import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from ledgerloom.llm import pieces, sentencepiece_codec, token_counts, token_files

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
SCHEMA = "doc_id long, text string, _key string, n_tokens string"
ODD = [
    None,
    "",
    " ",
    "a  b   c    d",
    "\n\n x\t\t y ",
    " " * 40 + "x",
    "▁▁a▁b",
    "naïve 日本語 テスト 한국어 😀😀 x",
    "<s> </s> <0x0A> <|endoftext|> a<|endoftext|>",
    "\x00\x01 a",
    "0123456789" * 20,
    "ab" * 6000,
    "the quick brown fox " * 300,
    "it's.\nThe 'end'. (a) b!? c.,;",
    "foo \nbar\n baz\n\n qux\n",
]


def random_texts(n):
    rng = random.Random(7)
    parts = ["the", "ing", "a", "é", " ", "  ", "\n", ".", "1", "日", "▁", "'s", "\t", " ", "<|endoftext|>", "tion", "X"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + random_texts(200)
    return spark.createDataFrame([(i, t, "k", "n") for i, t in enumerate(texts)] + [(3, ODD[3], "k", "n")], SCHEMA)


def plain(t):
    return LIBRARY.encode(t or "")


def test_counts_are_the_librarys(docs):
    got = token_counts.token_counts(docs, MODEL, limit=30).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        n = len(plain(r["text"]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 30)


def test_scan_over_chunks_equals_one_run():
    t = token_counts.Transducer(pieces.load(open(MODEL, "rb").read()))
    rng = random.Random(1)
    for _ in range(20):
        word = "".join(rng.choice("theinaorst") for _ in range(rng.randint(50, 400)))
        for size in (1, 3, 17, 64):
            assert t.scan([word[i : i + size] for i in range(0, len(word), size)])[0] == t.run(word)


def test_huge_texts_are_counted_by_chunks_over_tasks(spark):
    rng = random.Random(7)
    items = [(1, "short"), (900, "".join(rng.choice("theinaorst") for _ in range(3000))), (901, "a" * 2000), (902, " " * 999), (903, "\U0001f600\u2581 x" * 300), (904, None), (904, "word " * 400), (None, "word " * 400)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    got = token_counts.token_counts(df, MODEL, huge=200, huge_chunk=300)
    want = [(i, len((t or "").encode()), len(plain(t)), len(plain(t)) > 4096) for i, t in items]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_chunks_that_start_from_a_wrong_state_are_mapped_again(spark):
    """Without any text before a chunk to tell its state from, it starts wrong."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("theinaorst") for _ in range(200)) for _ in range(5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = dict(token_counts.huge_counts(rows, pieces.shipped(spark, MODEL), chunk=100, back=0).collect())
    assert got == {i: len(plain(t)) for i, t in enumerate(texts)}


def test_encoding_is_the_librarys_and_decodes(docs):
    got = sentencepiece_codec.encode_pieces(docs, MODEL).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        ids = plain(r["text"])
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == LIBRARY.decode(ids)
        assert r["round_trip"] == ("▁" not in (r["text"] or ""))


def test_unigram_viterbi_is_the_librarys(spark, tmp_path):
    """A unigram model written by hand: no training."""
    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.trainer_spec.unk_surface = " ?? "
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    rng = random.Random(2)
    words = ["▁", "▁a", "▁b", "a", "b", "c", "ab", "bc", "abc", "ca", "▁ab", "bca", "cab", "aa"]
    for p, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)]:
        model.pieces.add(piece=p, score=0, type=kind)
    for w in words:
        model.pieces.add(piece=w, score=-rng.uniform(1, 9), type=1)
    path = tmp_path / "u.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["".join(rng.choice("abc  z") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    lattice = sentencepiece_codec.Lattice(pieces.PieceModel(path.read_bytes()))
    assert [x.tolist() for x in lattice.encode(texts)] == [library.encode(t) for t in texts]


def test_token_files_round_trip(spark, docs, tmp_path):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/files"
    library = Tokenizer.from_file(path)
    texts = docs.filter("doc_id <> 3").repartition(5)
    token_files.write_token_files(texts, path, folder, end_id=0, ids_each=500, texts_each=500)
    got = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, want in zip(got, sorted(texts.collect(), key=lambda r: r["doc_id"]), strict=True):
        ids = [*library.encode(want["text"] or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["token_ids"]) == (want["doc_id"], start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert spark.read.parquet(f"{folder}/manifest").count() > 1


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert token_counts.token_counts(none, MODEL).count() == 0
    assert sentencepiece_codec.encode_pieces(none, MODEL).count() == 0
    folder = f"file://{tmp_path}/none"
    token_files.write_token_files(none, public_tokenizers.path("byte_bpe_50k.json"), folder)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert token_counts.token_counts(df, MODEL).filter(F.col("doc_id").isNull()).collect()[0]["n_tokens"] == 2

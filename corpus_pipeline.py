"""A training-corpus pipeline over the documents table: language ID, line dedup, near-duplicate removal, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared
folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language_id, line_dedup, mixing, sentencepiece_codec, similarity_join
from ledgerloom.llm.common import documents, scratch


#: Rows of text that go to a Python worker at once. Spark's 10,000 would be some 35 MB, held in the JVM's buffers and in the worker.
ROWS = 1_000


def _short_batches(spark: SparkSession) -> None:
    """For stages with Python workers, from here on in this session; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ROWS:
        spark.conf.set(name, str(ROWS))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is doubtful, or that have no letter or no text, go; a null lang takes the prediction.

    Repeated rows are judged one by one; extra columns stay; an empty table stays empty.
    """
    _short_batches(spark)
    return language_id.in_known_language(docs, language_id.training_samples(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go from the texts; null texts stay null, and no document goes.

    Copies count once, repeated rows among them; a null source is one of its own; extra columns stay.
    """
    return line_dedup.clean_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of least id.

    Documents without words, text or id all stay, and so do all rows of an id that stays; extra columns stay.
    """
    _short_batches(spark)
    return similarity_join.one_of_each(docs, signatures_each=700_000)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportion 1 : 2 : 3, repeating; a document is in as many rows as epochs take it.

    Each row of a repeated id has its own epochs; null texts count no words; null is a source of its own; extra columns stay.
    """
    return mixing.mixed_documents(docs, weights=(1, 2, 3))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip for every row; a null or empty text has no tokens. Repeated rows stay."""
    _short_batches(spark)
    found = sentencepiece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), texts_each=1_000_000)
    return found.select("doc_id", "n_tokens", "token_ids", "round_trip")


STAGES = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: The tokenizer and the parses of the language stage are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

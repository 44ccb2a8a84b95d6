"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes each stage's result as Parquet
in the shared folder and reads it again as the next one's docs; a stage's result must be written before the next stage of the thread begins.

All stages take nulls in any column, empty and very long texts, rows that repeat, empty tables and extra columns of any names, which they keep
(but for the last, whose rows are pieces): a null or empty text has no line, no shingle and no repeat, so it stays as it is, and is one token when packed; rows
without an id stay, lose no line and are near-duplicates of nothing; rows that share an id are judged by their own text, but lose lines and go as duplicates together.
"""

from __future__ import annotations

import contextvars
import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curricle import storage
from curricle.llm import line_dedup, minhash, packing, site_quality, suffixes
from curricle.llm.common import fresh, stored, table, without


#: A passage of fifty words takes about 320 bytes in the languages of the corpus, and hardly ever fewer than these.
PASSAGE = 240

#: What the stage before wrote for itself, of the run in this thread.
_left: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("left", default=())


def _stage(f):
    """A stage that first deletes what the stage before it in this thread wrote for itself: its result has been written, so nothing reads that any more.
    No stage follows the last one, so what it wrote stays for its result until the driver exits."""
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.release(spark, _left.get())
        with storage.scope() as paths:
            out = f(spark, docs, sf_dir)
            _left.set(() if f.__name__ == "pack" else tuple(paths))
        return out
    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier rejects go."""
    return site_quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that are like an earlier line go, and documents that have no line left."""
    return _counted(line_dedup.without_lines(docs, least_words=1))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near-duplicates over 5-word shingles, the document with the least id stays."""
    groups = stored(minhash.near_duplicates(docs, shingle=5, percent=80), "groups")
    return without(docs, "doc_id", groups.where("id != component_id").select("id"), "id")


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: bytes in strings of PASSAGE bytes that also start elsewhere go, whole characters at a time. Null texts stay null."""
    none, = fresh(docs, "null")
    out = suffixes.without_repeats(docs.withColumn(none, F.col("text").isNull()), length=PASSAGE, characters=True)
    text = F.when(~F.col(none), F.make_valid_utf8(F.col("text").cast("string")))
    return _counted(out.withColumn("text", text)).select(*(F.col(f"`{c}`") for c in docs.columns))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the texts' tokens in sequences of at most 2048."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=50_000)  # workers also hold what earlier stages loaded
    return out.select(F.col("doc").alias("doc_id"), "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text is now; that of a null text stays."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", pack)]

#: SQL can't express the classifier, the tokenizer and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

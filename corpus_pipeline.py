"""From raw documents to token ids: the stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialedger.llm import langid, mixing, pieces, simhash, suffix_dedup
from medialedger.llm.common import packed, removed, shared_dir, unpacked

#: SQL can't express the trained field, the suffix arrays or the tokeniser; the tests hold stages against plain versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language: null texts and texts without a letter go. Other columns may have any name."""
    own = packed(docs.withColumn("text", F.col("text").cast("string")), "doc_id", "text")
    out = langid.identify(own, langid.train(docs))
    return unpacked(out.where("lang_pred <> 'und'"), docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays (shingles of five words, similarity 0.8): the one with the smallest id,
    ids that are null last, then the one with the smallest hash. Rows are judged by their text, so rows that share an id, or
    have none, are told apart; of rows that are equal throughout one stays.
    """
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; n_chars follows. Null texts stay null."""
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one of which it takes a part comes with that many of its words, n_chars
    follows. Documents without a word are never taken. Of rows that share id, source and size each comes as often as the
    one that the mix takes most of.
    """
    own = packed(docs, "doc_id", "source", "text")
    taken = mixing.mix(docs).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.max("taken").alias("taken"))
    sized = own.withColumn("size", mixing.size_of(F.col("text").cast("string")))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "size")]
    out = sized.alias("o").join(taken.alias("t"), same).select("o.*", "t.taken")
    copies = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    out = out.withColumn("copy", F.explode(copies)).withColumn("words", F.least("size", F.col("taken") - F.col("copy") * F.col("size")))
    # cut before words, white space kept; a text that begins with white space has that as its first part
    parts = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    start = F.array_join(F.slice(parts, F.lit(1), (F.col("words") + lead).cast("int")), "")
    out = out.withColumn("text", F.when(F.col("words") < F.col("size"), start).otherwise(F.col("text")))
    out = unpacked(out, docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text. A null text has no ids."""
    return pieces.encoded(docs, pieces.load()).select("doc_id", "n_ids", "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs

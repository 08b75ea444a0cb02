"""Training-corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

1. quality: documents that the compression classifier scores under 0.5 go;
2. lines: lines on MIN_SITES or more sites go from the texts;
3. near duplicates: of each component (five-word shingles, Jaccard 0.8 or
   more) the document with the least id stays;
4. benchmark: documents with a window of a benchmark item go;
5. mixing: documents are sampled by calibrated probabilities; the result adds
   topic, tokens and probability.

Each stage works on all that the one before kept.  Extra columns pass through,
whatever their names: stages work under names of their own, and where an extra
column is already called topic, tokens or probability the result's own column
gets an underscore in front.  Each stage's folder goes once the next one has
read it; the last one's stays with the result that reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm import _spark, decontamination, jaccard_join, line_dedup, mixing, quality_classifier


def _named(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs under names that clash with nothing, and the new names of `names`."""
    return _spark.masked(docs, *names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, (text,) = _named(docs, "text")
    return quality_classifier.score(plain, model, text_col=text, out="good").where("good >= 0.5").select(*plain.columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, (doc_id, site, text, size) = _named(docs, "doc_id", "source", "text", "n_chars")
    clean = line_dedup.remove(plain, doc_id, site, text)
    chars = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(size)).cast(plain.schema[size].dataType)
    return clean.withColumn(size, chars).select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, (doc_id, text, source, lang) = _named(docs, "doc_id", "text", "source", "lang")
    out = mixing.weigh(plain, doc_id, text, source, lang).where("_sampled").select(*plain.columns, "_topic", "_tokens", F.round("_probability", 6))
    taken, own = {c.lower() for c in docs.columns}, []
    for name in ("topic", "tokens", "probability"):
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        own.append(name)
    return out.toDF(*docs.columns, *own)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix)]

#: the quality stage (trained zstandard dictionaries) has no SQL form; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{_spark.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if before:
                _spark.delete(spark, before)
            before = f"{folder}/{k}-{name}"
    return docs

"""From raw documents to a training mix, in five stages over the whole corpus.

Each stage takes (spark, docs, folder of tables), works on all rows the stage before kept
and returns the columns of `documents`, but for the last, which returns the mix. A stage's
result is written as Parquet and read again, so that a lost executor never reruns it.

Nulls and odd rows: a document without a letter goes in the first stage, one whose every
line stands elsewhere too in the second. A null doc_id or source goes through as a value.
Of repeated rows one stays. An empty table goes through all stages. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, linespread, mixing, oddsketch
from tidemark.llm.common import read, small, table

#: A text is rejected if no language holds this share of its words, by mean probability.
LEAST_SCORE = 0.4
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts in no language that was learned."""
    out = langid.predict(docs, langid.train(docs), "_crf_")
    known = (F.col("_crf_lang_pred") != langid.UNKNOWN) & (F.col("_crf_score") >= LEAST_SCORE)
    return out.filter(known).select(*[f"`{c}`" for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut boilerplate lines, and drop documents of which no line is left."""
    out = linespread.drop_boilerplate(docs, counts=False).filter(F.trim("text") != "")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates, by shingles of five words."""
    found = table(oddsketch.near_duplicates(docs, SHINGLE).select(F.col("doc_id").alias("_id"), "kept"), "groups")
    kept = small(table(found.filter("kept").select("_id").distinct(), "kept"))
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    repeated = not found.groupBy("_id").count().filter("count > 1").isEmpty()
    if not repeated:
        return out
    # Rows with one id are told apart by their text.
    mark = "_text" + "_" * max(map(len, docs.columns))
    return out.withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontam.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: Stages 1, 3 and 4 can't be put in SQL; tests/llm holds brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs

"""A training corpus from the documents table: filter, deduplicate, decontaminate, redact, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's docs. The last stage adds what the mix takes to the columns of documents.

Rows are told apart by id and text, never by id alone: rows that share an id are judged each by its text, rows without id too, and
rows that are equal in every column are copies, of which the join keeps one. Null and empty texts go with the first stage; null sources
are a source of their own; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import jaccard
from hearthline.llm.common import ensure_checkpoint_dir, table, word_count
from hearthline.llm.decontamination import without_leaks
from hearthline.llm.mixing import BUDGET, REPEATS, SEED, WEIGHTS, mix_sources
from hearthline.llm.quality import quality_filter
from hearthline.llm.secrets import redact, scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule of the cascade rejects."""
    return quality_filter(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least id (rows without id last), whatever its other columns; texts in no class stay."""
    return jaccard.one_of_each_class(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found; each row is judged by its own text."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced and n_chars counted anew where there were any."""
    found = scan_secrets(docs)
    text = F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    done = found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with `taken`, those words. Each row is placed by itself, so that rows that share an id don't meet."""
    sized = docs.withColumns({"__words": word_count(F.col("text")), "__members": F.array("source")})
    taken = mix_sources(sized, id_col="doc_id", size_col="__words", members_col="__members", weights=WEIGHTS, budget_ratio=BUDGET, max_repeats=REPEATS, seed=SEED, ties=("text",))
    return taken.where("taken > 0").select(*docs.columns, "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", one_of_each_class),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("mix_sources", mix),
]

#: The join and the SimHash windows can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result lies in the shared checkpoint folder until the next one is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4()}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs

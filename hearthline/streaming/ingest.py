"""Files of raw documents as a stream into a table of units. An extension: what the table says is what batch reading of the files gives.

A row of the table is a unit, or a document that has none: broken, emptied or without units, it still replaces what its key gave before. So the
table is also the record of what was read and when, from which catch_up finds files that were replaced in place, at which a file stream does not look
a second time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.units import keep_first
from ..sources.raw import RAW, slug

SCHEMA = f"{RAW}, _corrupt_record string"


def rows_of(docs: DataFrame) -> DataFrame:
    """path, modified, file_name, doc_source, pos and the units' columns; pos is null in the one row of a document without units."""
    named = docs.withColumns({"path": F.col("_metadata.file_path"), "modified": F.col("_metadata.file_modification_time"), "file_name": F.col("_metadata.file_name")})
    units = F.when(F.col("_corrupt_record").isNull(), F.col("units"))
    return named.select("path", "modified", "file_name", slug().alias("doc_source"), F.posexplode_outer(units).alias("pos", "u")).select("path", "modified", "file_name", "doc_source", "pos", "u.*")


def stream_raw(spark: SparkSession, folder: str, files_per_batch: int = 1000, lines: bool = False) -> DataFrame:
    """Rows of the documents in new files; lines: files hold a document a line, not one each."""
    docs = spark.readStream.schema(SCHEMA).option("multiLine", not lines).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows_of(docs)


def write_batch(rows: DataFrame, table_path: str, number: int) -> None:
    """Rows as the partition batch=number, which only this batch writes, so one that runs twice changes nothing."""
    dealt = rows.withColumn("batch", F.lit(number)).sortWithinPartitions("doc_source", "path", "pos")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table_path)


def ingest(rows: DataFrame, table_path: str, checkpoint: str):
    """Runs what is there now and stops. Batches of the stream are numbered from 0."""
    return rows.writeStream.foreachBatch(lambda batch, number: write_batch(batch, table_path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catch_up(spark: SparkSession, folder: str, table_path: str, lines: bool = False) -> int:
    """Reads the files of folder again that have changed since the table's record of them, as one more batch; gives their number.

    Files are listed, not read, to find the changed ones; those are then read alone. Such batches are numbered from -1 downwards. Files that the
    stream has not read yet are left to it.
    """
    table = spark.read.parquet(table_path)
    known = table.groupBy("path").agg(F.max("modified").alias("seen"))
    listed = spark.read.format("binaryFile").load(folder).select("path", "modificationTime")
    changed = [r["path"] for r in listed.join(known, "path").where(F.col("modificationTime") > F.col("seen")).select("path").collect()]
    if changed:
        number = min(0, table.agg(F.min("batch")).first()[0]) - 1
        write_batch(rows_of(spark.read.schema(SCHEMA).option("multiLine", not lines).json(changed)), table_path, number)
    return len(changed)


def current(table: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """The units of each document as it was read last, by when its file was modified and, of one time, by batch. key tells documents apart: the file's
    full path, or the source where a run writes new files or a file holds many documents."""
    late = F.struct("modified", F.abs("batch").alias("batch"))
    last = table.groupBy(*key).agg(F.max(late).alias("__last"))
    rows = table.join(last, list(key)).where(F.struct("modified", F.abs("batch").alias("batch")) == F.col("__last")).where("pos is not null")
    return rows.drop("__last")


def deduped(units: DataFrame, order: Sequence[str] = ("path", "pos")) -> DataFrame:
    """Of equal units of a source the first by order, over all batches: a unit that a replaced file withdraws gives way to the next."""
    return keep_first(units, ["doc_source", text.normal_address(F.col("address")), "bedrooms", "rent"], order)

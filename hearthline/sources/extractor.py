"""Readers of page texts. An Extractor takes pages (url, text) and gives one row a url of RESULT; the default answers from the cache alone.

A reader may cost money by the page. resumable() keeps each answer in a journal as soon as it is there and before anything uses it: a task that is
run again, a second action or a later run finds it there, and asks for what is missing only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .published import PublishedByKey
from .raw import OBSERVED

RESULT = f"url string, room_type string, pets string, furnished string, parking string, laundry string, summary string, method string, evidence map<string,string>, observed {OBSERVED}"
NAMES = ("url", "room_type", "pets", "furnished", "parking", "laundry", "summary", "method", "evidence", "observed")
Extractor = Callable[[DataFrame], DataFrame]


def from_cache(cache: DataFrame) -> Extractor:
    """Answers what the cache has; other pages get no row."""
    return lambda pages: cache.join(pages.select("url").distinct(), "url", "left_semi").select(*NAMES)


def by_batches(read: Callable[[pd.DataFrame], pd.DataFrame]) -> Extractor:
    """An extractor from a function of batches of pages, which runs where the pages lie; a remote reader's client goes in here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield read(batch)

    return lambda pages: pages.select("url", "text").mapInPandas(run, RESULT)


class Journal:
    """Answers in a folder that all executors share (a URI that pyarrow can write to): in each bucket of urls a file for each chunk that was asked for."""

    def __init__(self, folder: str, buckets: int = 64) -> None:
        self.folder, self.buckets = folder.rstrip("/"), buckets

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(self.buckets)).cast("int")

    def load(self, bucket: int) -> dict[str | None, dict]:
        """The answers of a bucket; of several for one url the last."""
        system, root = fs.FileSystem.from_uri(f"{self.folder}/answers/{bucket}")
        files = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        out = {}
        for info in sorted((f for f in files if f.base_name.endswith(".jsonl")), key=lambda f: (f.mtime_ns or 0, f.base_name)):
            with system.open_input_stream(info.path) as f:
                out |= {a["url"]: a for a in map(json.loads, f.read().decode().splitlines())}
        return out

    def add(self, bucket: int, answers: list[dict]) -> None:
        """Written aside and renamed, so that a chunk's answers are there whole or not at all."""
        system, root = fs.FileSystem.from_uri(f"{self.folder}/answers/{bucket}")
        system.create_dir(root, recursive=True)
        name = str(uuid.uuid4())
        with system.open_output_stream(f"{root}/.{name}") as f:
            f.write("".join(json.dumps({"url": None} | a) + "\n" for a in answers).encode())
        system.move(f"{root}/.{name}", f"{root}/{name}.jsonl")


def resumable(read: Callable[[pd.DataFrame], pd.DataFrame], journal: Journal, chunk: int = 1) -> Extractor:
    """An extractor that asks read for each url once, chunk pages at a time, and answers from the journal what is in there.

    read gives a row for each url that it can answer. What is lost when an executor dies is what read was working on: chunk pages a task. Equal
    urls are one page, and a bucket of urls is one task's, which holds its answers; only a task that Spark runs twice at the same time (speculation) asks twice. A page
    without an answer is asked for again in the next run.
    """

    def answers(frame: pd.DataFrame) -> list[dict]:
        return json.loads(frame.reindex(columns=list(NAMES)).to_json(orient="records"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, known = None, {}
        for batch in batches:
            for bucket, pages in batch.groupby("bucket", sort=False):
                if bucket != here:
                    here, known = bucket, journal.load(int(bucket))
                urls = [None if pd.isna(u) else u for u in pages["url"]]
                left = pages[[u not in known for u in urls]].drop(columns="bucket")
                for k in range(0, len(left), chunk):
                    new = answers(read(left.iloc[k : k + chunk]))
                    if new:
                        journal.add(int(bucket), new)
                        known |= {a["url"]: a for a in new}
                found = [u for u in urls if u in known]
                if found:
                    yield pd.DataFrame({"value": pd.Series([json.dumps(known[u]) for u in found], dtype=object)})

    def extract(pages: DataFrame) -> DataFrame:
        once = pages.groupBy("url").agg(F.min("text").alias("text")).withColumn("bucket", journal.bucket(F.col("url")))
        dealt = once.repartition(journal.buckets, "bucket").sortWithinPartitions("bucket", "url")
        return dealt.mapInPandas(run, "value string").select(F.from_json("value", RESULT).alias("r")).select("r.*")

    return extract


def absorb(spark: SparkSession, journal: Journal, cache: PublishedByKey) -> int:
    """Publishes the journal's answers in the cache, in place of what it had for their urls, and gives the cache's version. The journal stays: it may go
    once this version is there."""
    system, root = fs.FileSystem.from_uri(f"{journal.folder}/answers")
    if system.get_file_info(root).type == fs.FileType.NotFound:
        return cache.latest()
    rows = spark.read.schema(f"{RESULT}").option("recursiveFileLookup", True).json(f"{journal.folder}/answers")
    late = F.max_by(F.struct(*NAMES), F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_name")))
    return cache.upsert(rows.groupBy("url").agg(late.alias("r")).select("r.*"))


def read_pages(pages: DataFrame, cache: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """The cache's answers, and those of the extractor for pages that the cache lacks; without an extractor the cache's alone."""
    known = from_cache(cache)(pages)
    if extractor is None:
        return known
    return known.unionByName(extractor(pages.join(cache.select("url"), "url", "left_anti")))

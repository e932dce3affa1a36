"""python -m hearthline: merges a folder of raw documents into a table of units, with what a cache says of their pages.

    python -m hearthline RAW_FOLDER OUT [--cache FILE] [--only a,b] [--limit N] [--estimate] [--publish [--allow-empty]] [--lines]

With --publish, OUT is a published table of units by source instead: each source's units are checked, deduped and put in order, a source with an invalid unit or without units keeps
what it has (without units only, unless --allow-empty), and the run's status is printed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dashboard
from .operators import units as ops
from .operators.publishing import publish_units
from .sources import raw
from .sources.published import Published, part_of_source


def main(args: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="hearthline", description=__doc__)
    ap.add_argument("raw", help="folder of raw documents")
    ap.add_argument("out", help="folder of the merged units and facets")
    ap.add_argument("--cache", help="JSON lines of cached readings, by url")
    ap.add_argument("--only", help="sources, comma-separated")
    ap.add_argument("--limit", type=int, default=0, help="pages that are queued at most; 0: all")
    ap.add_argument("--estimate", action="store_true", help="count the pages that would be read, and write nothing")
    ap.add_argument("--publish", action="store_true", help="publish the units by source as a new version of the table OUT")
    ap.add_argument("--allow-empty", action="store_true", help="with --publish: a source without units loses what it has")
    ap.add_argument("--lines", action="store_true", help="files hold a document a line")
    given = ap.parse_args(args)
    spark = SparkSession.builder.appName("hearthline").getOrCreate()
    read = raw.read_raw(spark, given.raw, given.lines)
    docs, units = raw.readable(read).withColumn("slug", raw.slug()), raw.units_of(read)
    if given.only:
        sources = docs.select("slug").distinct()
        chosen, unknown = ops.only_slugs(sources, given.only.split(","))
        for row in unknown.orderBy("slug").toLocalIterator():
            print(f"unknown source: {row['slug']}", file=sys.stderr)
        units = units.join(chosen.select(F.col("slug").alias("doc_source")), "doc_source", "left_semi")
        docs = docs.join(chosen.select("slug"), "slug", "left_semi")
    if given.publish:
        return publish(spark, docs, units, given.out, given.allow_empty)
    cache = raw.read_table(spark, given.cache, raw.CACHE) if given.cache else spark.createDataFrame([], raw.CACHE)
    pages = ops.pages_to_read(units, cache, ["file_name", "pos"])
    queued, over = ops.queue_limit(pages, given.limit) if given.limit else (pages, pages.limit(0))
    found = queued.agg(F.count("*").alias("pages"), F.coalesce(F.sum("members"), F.lit(0)).alias("units")).first()
    print(f"queued {found['pages']} pages of {found['units']} units; beyond the limit {over.agg(F.coalesce(F.sum('members'), F.lit(0))).first()[0]} units")
    if given.estimate:
        print(f"about ${ops.flat_cost(queued, 1.0, 5.0).first()['cost']} in a batch")
        return 0
    merged = ops.merge_units(ops.fill(units, cache))
    raw.write_partitioned(merged, f"{given.out}/units")
    cells = dashboard.facets(merged, dashboard.FACETS, ["file_name", "pos"]).orderBy(*dashboard.facet_order()).select("facet", "value", "n")
    cells.write.mode("overwrite").parquet(f"{given.out}/facets")
    return 0


def publish(spark: SparkSession, docs: DataFrame, units: DataFrame, out: str, allow_empty: bool) -> int:
    """Publishes the units of documents (slug, manager) and prints a line a source. 1 if any failed."""
    table = Published(spark, out, f"{raw.UNIT}, pos int", part_of_source(F.col("source")))
    scraped = docs.groupBy("slug").agg(F.max("manager").alias("manager")).withColumn("platform", F.lit(None).cast("string"))
    own = units.withColumns({"source": F.col("doc_source"), "manager": F.coalesce("manager", "doc_manager")}).select(*[c.split(" ")[0] for c in raw.UNIT.split(", ")], "pos", "file_name")
    status = publish_units(table, scraped, own, order=("file_name", "pos"), allow_empty=allow_empty)
    for row in raw.status_rows(status).toLocalIterator():
        print(f"{row['slug']}: " + (row["error"] or f"{row['units']} units" + " preserved" * row["preserved"]))
    totals = raw.status_totals(status).first()
    print(f"{totals['sources_ok']} sources ok, {totals['sources_failed']} failed, {totals['total_units']} units; version {table.latest()}")
    return int(totals["sources_failed"] > 0)


if __name__ == "__main__":
    sys.exit(main())

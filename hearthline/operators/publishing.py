"""A run's units into the published table: dedupe, order, validation and defence together, and the run's status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import kinds, text
from ..sources.published import Published, folder_of
from . import dashboard, units as ops


def publish_units(table: Published, scraped: DataFrame, units: DataFrame, *, order: Sequence[str] = ("pos",), allow_empty: bool = False) -> DataFrame:
    """Publishes the units of a run by source and gives its status: slug, manager, platform, ok, units, error, preserved.

    scraped: slug, manager, platform of each source that the run has read; units: what it found there, by source. Of equal units of a source the first
    by order is kept, and a source's units are in the order of raw files. A source with any unit that breaks a rule is not
    replaced and fails, with the first rule broken. A source without units keeps what it has, as preserved, unless allow_empty. Readers see all
    sources change at once.
    """
    base = table.latest()
    judged = ops.keep_first(units, ["source", text.normal_address(F.col("address")), "bedrooms", "rent"], order)
    judged = cut(judged.withColumn("unit_type", kinds.unit_type(F.col("bedrooms"))).withColumn("violations", kinds.violations()))
    found = judged.groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("new"), F.min(F.when(F.size("violations") > 0, F.array_join("violations", ", "))).alias("error"))
    had = table.read(base).groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("old"))
    status = scraped.join(found, "slug", "left").join(had, "slug", "left").na.fill(0, ["new", "old"])
    preserved = (F.col("new") == 0) & (F.col("old") > 0) & F.lit(not allow_empty)
    status = cut(
        status.select(
            "slug", "manager", "platform", F.col("error").isNull().alias("ok"), F.when(F.col("error").isNotNull(), 0).when(preserved, F.col("old")).otherwise(F.col("new")).cast("long").alias("units"),
            F.when(F.col("error").isNotNull(), F.concat(F.lit("invalid: "), "error")).alias("error"), preserved.alias("preserved"),
        )
    )
    good = status.where("ok and not preserved").select(F.col("slug").alias("source"))
    rows = judged.drop("violations").join(good, "source", "left_semi")
    emptied = [folder_of(r["slug"]) for r in status.where("ok and not preserved and units = 0").select("slug").collect()]
    parts = {p: f for p, f in table.parts(base).items() if p not in set(emptied)}
    table.publish(parts | table.write(rows, dashboard.SORTS["raw"]()), base)
    return status

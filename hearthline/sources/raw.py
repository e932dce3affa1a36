"""Raw documents, caches, registries and sinks. Schemas are written out, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFLICT = "struct<field:string,parsed:string,observed:string>"
UNIT = (
    "address string, source string, manager string, city string, bedrooms double, available_date string, rent double, kind string, unit_type string, "
    "room_type string, pets string, furnished string, parking string, laundry string, summary string, available_now boolean, bathrooms double, "
    f"square_feet int, state string, postal_code string, title string, url string, conflicts array<{CONFLICT}>"
)
RAW = f"schema_version int, source string, manager string, source_url string, scraped_at string, unit_count int, units array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in UNIT.split(', ')))}>>"
OBSERVED = "struct<describes_one_unit:boolean,bedrooms:double,bathrooms:double,rent:double,square_feet:double,available_date:string,available_now:boolean,city:string,listing_kind:string>"
CACHE = f"url string, room_type string, pets string, furnished string, parking string, laundry string, summary string, method string, evidence map<string,string>, observed {OBSERVED}"
CONTACT = "slug string, manager string, phone string, emails array<string>, source_url string"
STATUS = "slug string, manager string, platform string, ok boolean, units long, error string, preserved boolean"


def read_raw(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """One row a document, with file_name and _corrupt_record. Files that start with _ are not read. lines: files hold a document a line, not one each."""
    docs = spark.read.schema(f"{RAW}, _corrupt_record string").option("multiLine", not lines).option("mode", "PERMISSIVE").json(folder)
    return docs.withColumn("file_name", F.col("_metadata.file_name"))


def readable(docs: DataFrame) -> DataFrame:
    """Documents that could be parsed to their end; of a broken one nothing counts, not even what came before the break."""
    return docs.where(F.col("_corrupt_record").isNull())


def slug() -> Column:
    """A document's source, or its file's name without the ending where it states none."""
    return F.coalesce(F.nullif("source", F.lit("")), F.regexp_replace("file_name", r"\.[^.]*$", ""))


def broken(docs: DataFrame) -> DataFrame:
    """file_name and text of documents that could not be parsed."""
    asked = F.coalesce(F.size("units"), F.lit(-1)) >= -1  # always so: Spark refuses to read the broken text alone, so another column is asked for
    return docs.where(F.col("_corrupt_record").isNotNull() & asked).select("file_name", F.col("_corrupt_record").alias("value"))


def units_of(docs: DataFrame) -> DataFrame:
    """One row a unit of readable documents, with file_name and pos, its place."""
    rows = readable(docs).select("file_name", slug().alias("doc_source"), F.col("manager").alias("doc_manager"), "scraped_at", F.posexplode("units").alias("pos", "u"))
    return rows.select("file_name", "pos", "doc_source", "doc_manager", "scraped_at", "u.*")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines table, or an empty one of the same schema where there is none; any other fault is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def store_by_url(rows: DataFrame, table: str, buckets: int = 200) -> DataFrame:
    """rows as a table that is bucketed and sorted by url, and read again: joins by url then shuffle their other side alone, day after day."""
    rows.repartition(buckets, "url").write.mode("overwrite").bucketBy(buckets, "url").sortBy("url").saveAsTable(table)
    return rows.sparkSession.table(table)


def fresh_pages(pages: DataFrame, now_seconds: float, hours: int = 24) -> DataFrame:
    """Pages fetched in the last hours; those without a time are not fresh."""
    return pages.where(F.coalesce("fetched_at", F.lit(0.0)) >= now_seconds - hours * 3600)


def batch_results(lines: DataFrame, schema: str) -> DataFrame:
    """page_id and result of the batch lines that succeeded; others, refusals and broken lines are dropped."""
    line = "custom_id string, result struct<type:string,message:struct<content:array<struct<type:string,text:string>>>>"
    rows = lines.select(F.from_json("value", line).alias("r")).where("r.result.type = 'succeeded'")
    return rows.select(F.col("r.custom_id").alias("page_id"), parse_response(F.col("r.result.message.content"), schema).alias("result")).where("result is not null")


def parse_response(content: Column, schema: str) -> Column:
    """The first text block of an answer, read as JSON; null for refusals and what is no JSON."""
    return F.from_json(F.try_element_at(F.filter(content, lambda c: c["type"] == "text"), F.lit(1))["text"], schema)


def scrapable(sources: DataFrame) -> DataFrame:
    """Sources whose platform has an adapter."""
    return sources.where(F.col("platform") != "none")


def registry(spark: SparkSession, rows: list[tuple[str, str, str, str, str | None]]) -> DataFrame:
    """slug, manager, site, platform, account, and whether it can be scraped."""
    return spark.createDataFrame(rows, "slug string, manager string, site string, platform string, account string").withColumn("scrapable", F.col("platform") != "none")


def source_url():
    """A source's page, by its platform."""
    return (
        F.when(F.col("platform") == "appfolio", F.concat(F.lit("https://"), F.col("account"), F.lit(".appfolio.com/listings")))
        .when(F.col("platform") == "buildium", F.concat(F.lit("https://"), F.col("account"), F.lit(".managebuilding.com/Resident/public/rentals")))
        .otherwise(F.col("site"))
    )


def write_partitioned(df: DataFrame, path: str, key: str = "source", order: tuple[str, ...] = ("city", "bedrooms", "rent", "address")) -> None:
    """Parquet by key, sorted inside; only the partitions that df has are replaced. path must not be one that df reads."""
    df.sortWithinPartitions(key, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def status_totals(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if("ok").alias("sources_ok"), F.count_if(~F.col("ok")).alias("sources_failed"), F.coalesce(F.sum("units"), F.lit(0)).alias("total_units"))


def status_rows(status: DataFrame) -> DataFrame:
    """A run's statuses in the order that they are written in."""
    return status.orderBy("slug")


def conflict_report(conflicts: DataFrame) -> DataFrame:
    """Rows of type conflict by field and address."""
    return conflicts.where("type = 'conflict'").orderBy(*report_order())


def report_order() -> list[Column]:
    return [F.col("field"), F.coalesce("address", F.lit("")), F.col("url")]


#: Parts of a merged payload, in their order.
SECTIONS = ("summary", "source", "facet", "manager", "excluded", "unit")


def merged_payload(units: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """section, place, value: a page's data as JSON rows, section by section in the order of SECTIONS and each in its own order.

    units and sections, by name, are in the order that they are shown in: sources and facet cells as their functions give them. Places are those of that
    order; units, of which there may be many, are written as they come and have none.
    """
    parts = []
    for name in SECTIONS:
        rows = units if name == "unit" else sections.get(name)
        if rows is None:
            continue
        value = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")
        if name == "unit":
            parts.append(rows.select(F.lit(name).alias("section"), F.lit(None).cast("long").alias("place"), value))
        else:  # no more rows than sources, managers, kinds or values of facets
            parts.append(rows.select(F.lit(name).alias("section"), F.monotonically_increasing_id().alias("place"), value))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

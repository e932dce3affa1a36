"""The dashboard: filters with their null rules, sort orders, facets and charts."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, kinds, text
from . import selection

FACETS = ("room_type", "unit_type", "pets", "furnished", "parking", "laundry")


@dataclass(frozen=True)
class Filters:
    """exact: column to value, rows without a value are left out. baths, sqft, rent and by_date keep rows without one."""

    exact: dict[str, str] = field(default_factory=dict)
    baths: float | None = None
    sqft: int | None = None
    rent: float | None = None
    beds: str | None = None
    by_date: date | None = None
    whole_only: bool = False
    now_only: bool = False

    def predicate(self) -> Column:
        keep = lambda c: F.coalesce(c, F.lit(True))
        out = F.lit(True)
        for c, v in self.exact.items():
            out = out & (F.col(c) == v)
        if self.baths is not None:
            out = out & keep(F.col("bathrooms") >= self.baths)
        if self.sqft:
            out = out & keep(F.col("square_feet") >= self.sqft)
        if self.rent is not None:
            out = out & keep(F.col("rent") <= self.rent)
        if self.beds:
            out = out & (F.col("bedrooms") >= 4 if self.beds == "4plus" else F.col("bedrooms") == float(self.beds))
        if self.by_date:
            out = out & (F.coalesce("available_now", F.lit(False)) | keep(F.col("available_date").cast("date") <= F.lit(self.by_date)))
        if self.whole_only:
            out = out & F.col("room_type").eqNullSafe(F.lit("entire_place"))
        if self.now_only:
            out = out & F.coalesce("available_now", F.lit(False))
        return out


#: Sort orders by name; every one ends with a tie-break of the caller.
SORTS = {
    "soonest": lambda: [F.coalesce("available_now", F.lit(False)).desc(), F.coalesce(F.nullif("available_date", F.lit("")), F.lit("9999-99-99")).asc(), F.coalesce("rent", F.lit(9e9)).asc()],
    "rent-asc": lambda: [F.col("rent").asc_nulls_last()],
    "rent-desc": lambda: [F.coalesce("rent", F.lit(-1.0)).desc()],
    "beds-desc": lambda: [F.col("bedrooms").desc_nulls_last()],
    "city": lambda: [F.collate(F.coalesce(F.nullif("city", F.lit("")), F.lit("~")), "UNICODE").asc()],
    "raw": lambda: [F.lower(F.coalesce(F.nullif("city", F.lit("")), F.lit("~"))).asc(), F.coalesce("bedrooms", F.lit(99.0)).asc(), F.coalesce("rent", F.lit(9e9)).asc(), text.normal_address(F.col("address")).asc()],
}


def page_of(units: DataFrame, sort: str, tie: list[str], size: int = 50, page: int = 0) -> DataFrame:
    """The rows of a page in a sort order, pages from 0: a top-k of the rows up to its end."""
    return units.orderBy(*SORTS[sort](), *tie).offset(size * page).limit(size)


def store_order(units: DataFrame, sort: str, tie: list[str], path: str, block: int = 100_000) -> None:
    """Writes units in a sort order with their place from 0, in blocks of so many places each, so that a page is read from the blocks it lies in and from
    no other, however far down it is."""
    rows = units_in_order(units, sort, tie).withColumn("block", F.floor(F.col("place") / block))
    rows.sortWithinPartitions("block", "place").write.mode("overwrite").partitionBy("block").parquet(path)


def units_in_order(units: DataFrame, sort: str, tie: list[str]) -> DataFrame:
    """units with place, from 0, in a sort order."""
    from .units import numbered  # which imports this module's neighbours

    return numbered(units, [*SORTS[sort](), *tie], "place")


def stored_page(spark: SparkSession, path: str, size: int = 50, page: int = 0, block: int = 100_000) -> DataFrame:
    """A page, from 0, of a stored order. block: as it was stored with. Only the folders of the page's blocks are listed, of however many there are."""
    first = size * page
    at = spark._jvm.org.apache.hadoop.fs.Path
    folders = [f"{path}/block={b}" for b in range(first // block, (first + size - 1) // block + 1)]
    held = [f for f in folders if at(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at(f))]
    rows = spark.read.option("basePath", path).parquet(*held) if held else spark.read.parquet(path).limit(0)
    return rows.where(F.col("place").between(first, first + size - 1)).orderBy("place").drop("block")


def top(counts: DataFrame, most: int, name: str = "value") -> DataFrame:
    """The most frequent values; of equal counts the first value."""
    return counts.orderBy(F.col("n").desc(), name).limit(most)


def bedroom_facet(df: DataFrame) -> DataFrame:
    """Counts by bedrooms, those that don't state any too, which come last."""
    return df.groupBy("bedrooms").agg(F.count("*").alias("n")).orderBy(F.col("bedrooms").asc_nulls_last())


def rent_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("rent").alias("least"), F.max("rent").alias("most"))


def median_of(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """The exact median, the mean of the two middle values of an even number."""
    return selection.median(df, value, by).select(*by, "median")


#: Rows of the room type chart, in their fixed order.
ROOM_TYPES = {"entire_place": "Entire place", "private_room": "Private room", "shared_room": "Shared room", "unknown": "Undetermined"}


def room_types(df: DataFrame) -> DataFrame:
    """place, name, n of the room types that there are, in their fixed order, those that aren't known last."""
    known = F.coalesce(F.nullif("room_type", F.lit("")), F.lit("unknown"))
    rows = list(enumerate(ROOM_TYPES.items()))
    place = F.coalesce(*[F.when(F.col("k") == key, i) for i, (key, _) in rows])
    name = F.coalesce(*[F.when(F.col("k") == key, label) for _, (key, label) in rows])
    return df.groupBy(known.alias("k")).agg(F.count("*").alias("n")).select(place.alias("place"), name.alias("name"), "n").where("place is not null").orderBy("place")


#: Labels of a unit's full record.
UNIT_TYPES = {"studio": "Studio", "1_bedroom": "1 bedroom", "2_bedroom": "2 bedroom", "3plus_bedroom": "3+ bedroom"}


def record() -> Column:
    """array<struct<label,value>> of a unit's full record, a dash for what it doesn't state."""
    c = F.col
    labelled = lambda labels, name: F.coalesce(F.try_element_at(text.literal_map(labels), c(name)), c(name))
    number = lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))
    rows = {
        "Unit type": labelled(UNIT_TYPES, "unit_type"), "Rental type": labelled({k: v for k, v in ROOM_TYPES.items() if k != "unknown"}, "room_type"),
        "Bedrooms": F.when(c("bedrooms") == 0, "Studio (0)").otherwise(number(c("bedrooms"))), "Bathrooms": number(c("bathrooms")),
        "Square feet": F.when(c("square_feet") != 0, F.format_number("square_feet", 0)), "Rent": F.when(c("rent").isNotNull(), text.money(c("rent"))),
        "Available": F.when(F.coalesce("available_now", F.lit(False)), "Now").otherwise(dates.day_label(c("available_date").try_cast("date"))),
        **{name.capitalize(): labelled(kinds.AMENITIES[name], name) for name in ("laundry", "parking", "furnished", "pets")},
        "City": c("city"), "Postal code": c("postal_code"), "State": c("state"), "Manager": c("manager"), "Source": c("source"),
    }
    return F.array(*[F.struct(F.lit(k).alias("label"), F.coalesce(F.nullif(v, F.lit("")), F.lit("—")).alias("value")) for k, v in rows.items()])


def count_facet(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Counts of a column's values, without null and empty ones."""
    return df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))


def facets(df: DataFrame, columns, order: list[str]) -> DataFrame:
    """facet, value, n and first (the order of its first row) for several columns in one pass; null and empty are unknown."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias("value")) for c in columns]))
    return df.select(cells.alias("x"), F.struct(*order).alias("o")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"), F.min("o").alias("first"))


def facet_order() -> list[Column]:
    return [F.col("facet").asc(), (F.col("value") == "unknown").asc(), F.col("n").desc(), F.col("first").asc()]


def summary(units: DataFrame, generated_at: str, stale_after: int = 48) -> DataFrame:
    """One row: when the payload was made, how many units it has, and after how many hours a source is stale."""
    return units.agg(F.lit(generated_at).alias("generated_at"), F.count("*").alias("total_units"), F.lit(stale_after).alias("stale_after_hours"))


def all_facets(units: DataFrame, order: list[str]) -> DataFrame:
    """facet, name, label, count of every facet in the order that a page shows them: cities by count, bedrooms by number and unknown last, the ends of the rent,
    and six fields with unknown last, by count, then by which value comes first."""
    text_of = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    cities = count_facet(units, "city").select(F.lit(0).alias("at"), F.lit("cities").alias("facet"), F.col("value").alias("name"), none.alias("label"), "n", F.array((-F.col("n")).cast("double")).alias("by"), F.col("value").alias("then"))
    beds = bedroom_facet(units).select(F.lit(1).alias("at"), F.lit("bedrooms").alias("facet"), text_of("bedrooms").alias("name"), kinds.bed_label(F.col("bedrooms")).alias("label"), "n", F.array(F.coalesce("bedrooms", F.lit(1e9))).alias("by"), none.alias("then"))
    ends = rent_range(units).select(F.explode(F.array(F.struct(F.lit("min").alias("label"), F.col("least").alias("v")), F.struct(F.lit("max").alias("label"), F.col("most").alias("v")))).alias("e"))
    rent = ends.select(F.lit(2).alias("at"), F.lit("rent").alias("facet"), text_of("e.v").alias("name"), F.col("e.label").alias("label"), F.lit(None).cast("long").alias("n"), F.array((F.col("e.label") == "max").cast("double")).alias("by"), none.alias("then"))
    cells = facets(units, FACETS, order)
    place = F.array_position(F.array(*map(F.lit, FACETS)), F.col("facet")) + 2
    fields = cells.select(place.cast("int").alias("at"), "facet", F.col("value").alias("name"), none.alias("label"), "n", F.array((F.col("value") == "unknown").cast("double"), (-F.col("n")).cast("double"), F.row_number().over(Window.partitionBy("facet").orderBy("first")).cast("double")).alias("by"), none.alias("then"))
    every = cities.unionByName(beds).unionByName(rent).unionByName(fields)
    return every.orderBy("at", "by", "then").select("facet", "name", "label", F.col("n").alias("count"))


def median_by_bucket(df: DataFrame, beds: Column, rent: Column, whole: Column) -> DataFrame:
    """bucket, n and median (half up) of rents of whole units by bedrooms, 4 and more together."""
    rows = df.where(whole & rent.isNotNull() & beds.isNotNull()).select(F.least(F.floor(beds), F.lit(4)).cast("int").alias("bucket"), rent.alias("r"))
    return selection.median(rows, F.col("r"), ["bucket"]).select("bucket", "n", F.floor(F.col("median") + 0.5).cast("long").alias("median"))


def headline(df: DataFrame, rent: Column, whole: Column, city: Column, manager: Column) -> DataFrame:
    """n, the exact median rent of whole units, and how many cities and managers there are; one row."""
    name = lambda c: F.nullif(c.cast("string"), F.lit(""))
    counts = df.agg(F.count("*").alias("n"), F.count_distinct(name(city)).alias("cities"), F.count_distinct(name(manager)).alias("managers"), F.lit(1).alias("__row"))
    middle = selection.median(df, F.when(whole, rent)).select(F.lit(1).alias("__row"), F.col("median").alias("median_rent"))
    return counts.join(middle, "__row", "left").select("n", "median_rent", "cities", "managers")


def by_month(df: DataFrame, day: Column, now: Column, most: int = 11) -> DataFrame:
    """month and n: those available now first, then the first months."""
    ready = df.where(now).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("now").alias("month"), "n")
    later = df.where(~F.coalesce(now, F.lit(False)) & day.isNotNull()).groupBy(dates.month_key(day).alias("month")).agg(F.count("*").alias("n"))
    return ready.unionByName(later.orderBy("month").limit(most))


def coverage(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """name and n of the tests that hold for some row, the most frequent first; one pass."""
    row = df.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(f"c{i}") for i, t in enumerate(tests.values())])
    cells = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"c{i}").alias("n")) for i, name in enumerate(tests)])
    return row.select(F.posexplode(cells).alias("i", "x")).where("x.n > 0").orderBy(F.col("x.n").desc(), "i").select("x.*")


def amenity_tests() -> dict[str, Column]:
    """What a unit states to have; null and empty texts state nothing."""
    some = lambda c: ~F.col(c).isin("none", "")
    return {"In-unit laundry": F.col("laundry") == "in_unit", "Any laundry": some("laundry"), "Parking": some("parking"), "Furnished": F.col("furnished") == "furnished", "Pets OK": some("pets")}

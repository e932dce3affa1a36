"""Operators over units: keep-first, merge, enrichment, cross-checks, reconciliation.

Every keyed operator is an equi-join or a hash aggregate with map-side combining; first and last rows are minima and
maxima of an explicit order, so a key that holds a third of all rows is one row a partition when it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import dates, kinds, places, text
from . import selection

ASSIGNABLE = ("room_type", "pets", "furnished", "parking", "laundry")
#: Fields on which the page wins over the parser.
APPLIED = ("kind", "bedrooms", "bathrooms", "available_date", "available_now")
#: What an enrichment has, besides method and evidence.
ENRICHED = (*ASSIGNABLE, "summary")


def keep_first(df: DataFrame, keys: Sequence, order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys (null equals null) the one that is first by order. keys: names or Columns."""
    named = [(k if isinstance(k, Column) else F.col(k)).alias(f"__k{i}") for i, k in enumerate(keys)]
    rows = df.select(*named, F.struct(*order).alias("__order"), F.struct(*df.columns).alias("__row"))
    return rows.groupBy(*[f"__k{i}" for i in range(len(named))]).agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")


def is_livable(kind: Column) -> Column:
    """A kind that isn't given counts as residential."""
    return F.coalesce(kind, F.lit("residential")).isin(*kinds.LIVABLE)


def is_enrichable() -> Column:
    """Has a page and a livable kind, and here a kind that isn't given doesn't count."""
    return (F.coalesce("url", F.lit("")) != "") & F.coalesce(F.col("kind").isin(*kinds.LIVABLE), F.lit(False))


def default_room_type(kind: Column, room_type: Column) -> Column:
    """A residential unit whose room type nobody stated is a whole place; a kind that isn't given is not residential here."""
    return F.when(room_type.isNull() & (kind == "residential"), "entire_place").otherwise(room_type)


def published(units: DataFrame) -> DataFrame:
    """Units as they are shown: the kind is what they were chosen by, and is left out."""
    return units.drop("kind")


def merge_units(units: DataFrame, order: Sequence[str] = ("file_name", "pos"), counted: Observation | None = None) -> DataFrame:
    """Published units: livable and covered ones first, then the first of each address, bedrooms and rent, then defaults.

    counted gets, from the same job that writes or reads the result, seen, excluded_<kind>, excluded_other, out_of_area and kept.
    """
    livable = is_livable(F.col("kind"))
    placed = places.with_area(units, None)
    if counted is not None:
        kind = F.col("kind")
        other = [k for k in kinds.KINDS if k not in kinds.LIVABLE]
        sums = [F.count_if(kind == k).alias(f"excluded_{k}") for k in other] + [F.count_if(~livable & ~kind.isin(*other)).alias("excluded_other")]
        placed = placed.observe(counted, F.count("*").alias("seen"), *sums, F.count_if(livable & ~places.is_covered()).alias("out_of_area"), F.count_if(livable & places.is_covered()).alias("covered"))
    kept = placed.where(livable & places.is_covered()).drop("area_state", "area_city")
    first = keep_first(kept, [text.normal_address(F.col("address")), "bedrooms", "rent"], order)
    done = first.withColumn("room_type", default_room_type(F.col("kind"), F.col("room_type")))
    return published(done.withColumn("unit_type", kinds.unit_type(F.col("bedrooms"))))


def excluded(units: DataFrame) -> DataFrame:
    """kind, n of the units that are not livable, by kind."""
    return units.where(~is_livable(F.col("kind"))).groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def cache_key(url: Column) -> Column:
    return F.coalesce(url, F.lit(""))


def left_by_url(units: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """units with the columns of side's row for their url. side: one row a value of key.

    Units without url may be a large part of all rows: they take the row of the empty url, if there is one, by a broadcast of that one row,
    and only the others are shuffled.
    """
    blank = cache_key(F.col("url")) == ""
    with_url = units.where(~blank).join(side.where(F.col(key) != ""), F.col("url") == F.col(key), "left")
    return with_url.unionByName(units.where(blank).join(F.broadcast(side.where(F.col(key) == "")), cache_key(F.col("url")) == F.col(key), "left"))


def fill(units: DataFrame, cache: DataFrame, fields: Sequence[str] = ENRICHED) -> DataFrame:
    """Units with their empty fields filled from the cache row of their url; what a unit has stays. cache: one row a url."""
    side = cache.select(F.col("url").alias("__url"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = left_by_url(units, side, "__url")
    return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in units.columns])


def structured_of() -> Column:
    """What a unit's own columns say, as an enrichment; its method is structured where they say something about pets or room type."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    method = F.when(said("pets") | said("room_type"), "structured").otherwise("none")
    return F.struct(*[F.col(f) for f in ENRICHED], method.alias("method"), F.lit(None).cast("map<string,string>").alias("evidence"))


def merge_enrichments(a: Column, b: Column) -> Column:
    """a laid over b: a's values win, methods are joined, and of evidence for one field b's wins."""
    methods = F.array_join(F.array_distinct(F.filter(F.array(a["method"], b["method"]), lambda m: F.coalesce(m, F.lit("none")) != "none")), "+")
    none = F.create_map().cast("map<string,string>")

    def joined(x: Column) -> Column:
        evidence = F.map_concat(F.map_filter(x["a"], lambda k, _: ~F.map_contains_key(x["b"], k)), x["b"])
        return F.when((F.size(x["a"]) > 0) | (F.size(x["b"]) > 0), evidence)

    evidence = text.let(F.struct(F.coalesce(a["evidence"], none).alias("a"), F.coalesce(b["evidence"], none).alias("b")), joined)
    return F.struct(*[F.coalesce(a[f], b[f]).alias(f) for f in ENRICHED], F.coalesce(F.nullif(methods, F.lit("")), F.lit("none")).alias("method"), evidence.alias("evidence"))


def missing_fields(e: Column) -> Column:
    """Names of the fields that an enrichment lacks; none for a complete one."""
    return F.array_compact(F.array(*[F.when(e[f].isNull(), f) for f in ENRICHED]))


def known_fields() -> Column:
    """What a reader of a unit's page is told of it: a map of the fields that it states."""
    names = [F.lit(f) for f in ENRICHED]
    return F.map_filter(F.map_from_arrays(F.array(*names), F.array(*ENRICHED)), lambda _, v: F.coalesce(v, F.lit("")) != "")


def apply_results(units: DataFrame, results: DataFrame) -> DataFrame:
    """Units after a reading of their pages: null fields and a blank summary are filled, and conflicts replaced where the reading has any.

    results: one row a url, with the fields of an enrichment and observed. Units have conflicts.
    """
    side = results.select(F.col("url").alias("__url"), *[F.col(f).alias(f"__{f}") for f in ENRICHED], F.col("observed").alias("__observed"))
    joined = left_by_url(units, side, "__url")
    page = {f: F.col(f"__observed.{f}") for f in ("bedrooms", "rent", "city")} | {"kind": F.col("__observed.listing_kind")}
    found = F.when(F.col("__observed.describes_one_unit"), inline_conflicts({f: F.col(f) for f in ("bedrooms", "rent", "city", "kind")}, page))
    new = {f: F.coalesce(F.col(f), F.col(f"__{f}")) for f in ASSIGNABLE}
    new["summary"] = F.when(F.coalesce("summary", F.lit("")) == "", F.coalesce(F.nullif("__summary", F.lit("")), "summary")).otherwise(F.col("summary"))
    new["conflicts"] = F.when(F.size(found) > 0, found).otherwise(F.col("conflicts"))
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in units.columns])


def manager_contacts(contacts: DataFrame) -> DataFrame:
    """manager, phone, emails, source_url: of a manager's contacts that of the last slug; those without manager are left out."""
    last = F.max_by(F.struct("phone", F.coalesce("emails", F.array().cast("array<string>")).alias("emails"), "source_url"), "slug")
    return contacts.where(F.coalesce("manager", F.lit("")) != "").groupBy("manager").agg(last.alias("c")).select("manager", "c.*")


def has_contact(phone: Column, emails: Column) -> Column:
    return (F.coalesce(phone, F.lit("")) != "") | (F.coalesce(F.size(emails), F.lit(0)) > 0)


def with_contacts(units: DataFrame, contacts: DataFrame, most: int = 2) -> DataFrame:
    """Units with phone and emails of their manager, so many emails at most; null where there is no phone and no email."""
    side = manager_contacts(contacts).where(has_contact(F.col("phone"), F.col("emails"))).select("manager", "phone", F.slice("emails", 1, most).alias("emails"))
    return units.join(side, "manager", "left")


def contact_coverage(contacts: DataFrame) -> DataFrame:
    """managers, phones, emails: how many managers there are, and have a phone or any email."""
    return manager_contacts(contacts).agg(F.count("*").alias("managers"), F.count_if(F.coalesce("phone", F.lit("")) != "").alias("phones"), F.count_if(F.size("emails") > 0).alias("emails"))


def first_contacts(pages: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of the pages of each slug the contact of the first: slug, contact."""
    return pages.groupBy("slug").agg(F.min_by("contact", F.struct(*order)).alias("contact"))


def with_registry(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents with the registry's row for their slug; their own manager counts first, then the registry's, then the slug. registry is a source list."""
    side = registry.select("slug", F.col("manager").alias("__manager"), "site", "platform")
    return docs.join(side, "slug", "left").withColumn("manager", F.coalesce(F.nullif("manager", F.lit("")), "__manager", "slug")).drop("__manager")


def only_slugs(registry: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the slugs that are wanted, and the slugs among them that there are none of."""
    asked = registry.sparkSession.createDataFrame([(w.strip(),) for w in wanted if w.strip()], "slug string").distinct()
    return registry.where(F.col("slug").isin([w.strip() for w in wanted])), without(asked, registry, "slug")


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows whose key others doesn't have."""
    return rows.join(others.select(key), key, "left_anti")


def results_with_meta(results: DataFrame, meta: DataFrame) -> DataFrame:
    """Results with what was asked for under their page_id; results of unknown pages are left out."""
    return results.join(meta, "page_id")


def per_source(sources: DataFrame, units: DataFrame, key: str = "source") -> DataFrame:
    """Each source with its number of units, 0 too."""
    counts = units.groupBy(key).agg(F.count("*").alias("n"))
    return sources.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def source_list(docs: DataFrame, merged: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """slug, manager, site, platform, unit_count, scraped_at, stale of every document, those with the most published units first, then by file name.

    docs: file_name, slug, manager and scraped_at of readable documents; merged: published units with file_name, the document they were kept from.
    """
    listed = per_source(with_registry(docs, registry), merged.select("file_name"), "file_name")
    rows = listed.select("slug", "manager", "site", "platform", F.col("n").alias("unit_count"), "scraped_at", dates.is_stale(F.col("scraped_at"), now).alias("stale"), "file_name")
    return rows.orderBy(F.col("unit_count").desc(), "file_name").drop("file_name")


def with_page_members(units: DataFrame) -> DataFrame:
    """Units that have a url with members, the number of units of their source on their page."""
    own = units.where(cache_key(F.col("url")) != "")
    return own.join(own.groupBy("source", "url").agg(F.count("*").alias("members")), ["source", "url"])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key new doesn't have."""
    return old.join(new, key, "left_anti").unionByName(new)


def preserve(old: DataFrame, new: DataFrame, key: str = "source", allow_empty: DataFrame | None = None) -> DataFrame:
    """new, and the old rows of sources for which new has none, unless allow_empty names them."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return (kept.join(allow_empty, key, "left_anti") if allow_empty is not None else kept).unionByName(new)


def compare_readings(df: DataFrame, keep: Sequence[Column | str], mine: dict[str, Column], page: dict[str, Column], today: Column) -> DataFrame:
    """keep and field, parser, page, type: a row for each field in which a page's own reading differs from the parser's, by the field's tolerance.

    Readings may be dear expressions: each is a column of a first projection, the page's date one of a second, and what is compared reads
    these, so all is worked out once and within generated code.
    """
    fields = (*TEXTS, *NUMBERS)
    read = df.select(*keep, *[side[f].alias(f"__{name}_{f}") for name, side in (("m", mine), ("p", page)) for f in fields])
    read = read.withColumn("__iso", dates.parse_available(F.col("__p_available_date"), today)["date"])
    of = lambda name: {f: F.col(f"__{name}_{f}") for f in fields}
    kept = read.columns[: -2 * len(fields) - 1]
    return read.select(*kept, F.explode(_differences(of("m"), of("p"), F.col("__iso"))).alias("__c")).select(*kept, "__c.*")


#: Compared fields, those in which an empty text is no statement apart.
TEXTS = ("available_date", "city", "kind")
NUMBERS = ("bedrooms", "bathrooms", "rent", "square_feet", "available_now")


def _differences(mine: dict[str, Column], page: dict[str, Column], iso: Column) -> Column:
    """iso: the page's date as the parser would write it."""
    stated = lambda side, f: F.coalesce(side[f], F.lit("")) != "" if f in TEXTS else side[f].isNotNull()
    gap = lambda f: F.abs(mine[f].cast("double") - page[f].cast("double"))
    differs = {
        "bedrooms": gap("bedrooms") > 0,
        "bathrooms": gap("bathrooms") > 0.01,
        "rent": gap("rent") > 1.0,
        "square_feet": gap("square_feet") > F.greatest(F.lit(5.0), mine["square_feet"].cast("double") * 0.02),
        "available_date": iso != mine["available_date"],
        "available_now": mine["available_now"] != page["available_now"],
        "city": F.lower(text.strip(mine["city"])) != F.lower(text.strip(page["city"])),
    }
    rows = []
    for f, other in differs.items():
        seen = iso if f == "available_date" else page[f]
        row = lambda kind, value, f=f: F.struct(F.lit(f).alias("field"), mine[f].cast("string").alias("parser"), value.cast("string").alias("page"), F.lit(kind).alias("type"))
        missing = ~stated(mine, f)
        if f == "available_now":
            missing = missing & page[f]
        rows.append(F.when(stated(page, f), F.when(missing, row("parser_missing", page[f])).when(stated(mine, f) & F.coalesce(other, F.lit(False)), row("conflict", seen))))
    kind = stated(page, "kind") & (page["kind"] != "unknown") & stated(mine, "kind") & (page["kind"] != mine["kind"])
    rows.append(F.when(kind, F.struct(F.lit("kind").alias("field"), mine["kind"].alias("parser"), page["kind"].alias("page"), F.lit("conflict").alias("type"))))
    return F.array_compact(F.array(*rows))


def inline_conflicts(mine: dict[str, Column], page: dict[str, Column]) -> Column:
    """array<struct<field,parsed,observed>>: the coarser comparison that units carry; it needs both sides."""
    row = lambda f: F.struct(F.lit(f).alias("field"), mine[f].cast("string").alias("parsed"), page[f].cast("string").alias("observed"))
    rent, seen = mine["rent"], page["rent"]
    city = lambda c: F.lower(text.strip(c))
    return F.array_compact(
        F.array(
            F.when(mine["bedrooms"] != page["bedrooms"], row("bedrooms")),
            F.when((rent != 0) & (seen != 0) & (F.abs(seen - rent) / F.greatest(seen, rent) > 0.05), row("rent")),
            F.when((F.coalesce(page["kind"], F.lit("")) != "") & (page["kind"] != "unknown") & ~mine["kind"].eqNullSafe(page["kind"]), row("kind")),
            F.when((page["city"] != "") & (mine["city"] != "") & (city(mine["city"]) != city(page["city"])), row("city")),
        )
    )


def single_unit_pages(units: DataFrame) -> DataFrame:
    """Livable units whose url no other livable unit of their source has."""
    own = units.where(is_enrichable())
    alone = own.groupBy("source", "url").agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return own.join(alone, ["source", "url"])


def cross_check(units: DataFrame, cache: DataFrame, today: Column, counted: Observation | None = None) -> DataFrame:
    """One row a difference: address, manager, url, field, parser, page, type. cache: url and observed, a struct.

    counted gets checked, the pages of one unit that have a reading, from the same job. Readings that don't describe one unit are checked and differ in nothing.
    """
    fields = ("bedrooms", "bathrooms", "rent", "square_feet", "available_date", "available_now", "city")
    joined = single_unit_pages(units).join(cache.where("observed is not null").select("url", "observed"), "url")
    if counted is not None:
        joined = joined.observe(counted, F.count("*").alias("checked"))
    page = {f: F.col(f"observed.{f}") for f in fields} | {"kind": F.col("observed.listing_kind")}
    mine = {f: F.col(f) for f in (*fields, "kind")}
    return compare_readings(joined.where("observed.describes_one_unit"), ["address", "manager", "url"], mine, page, today)


def page_values(conflicts: DataFrame) -> DataFrame:
    """url and for each applied field __field, the page's value in the last row of that url and field, null if that one states none.
    conflicts: url, field, page, type and ord, its order."""
    rows = conflicts.where(F.col("field").isin(*APPLIED) & (F.col("type") == "conflict"))
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.struct("page")), F.when(F.col("field") == f, F.col("ord")))["page"]
    return rows.groupBy(F.col("url").alias("__url")).agg(*[last(f).alias(f"__{f}") for f in APPLIED])


def reconcile(units: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Units with the page's value where a conflict on an applied field names their url; the last row of a url and field wins."""
    joined = left_by_url(units, page_values(conflicts), "__url")
    kinds_of = dict(units.dtypes)
    fixed = [F.coalesce(F.col(f"__{c}").try_cast(kinds_of[c]), F.col(c)).alias(c) if c in APPLIED else F.col(c) for c in units.columns if c != "unit_type"]
    return joined.select(*fixed).withColumn("unit_type", kinds.unit_type(F.col("bedrooms")))


def reconcile_counts(units: DataFrame, conflicts: DataFrame) -> DataFrame:
    """field, applied, n: how many values reconcile changes, by field, and how many rows on other fields are left for review."""
    kinds_of = dict(units.dtypes)
    joined = units.join(page_values(conflicts), F.col("url") == F.col("__url"))
    changed = [F.count_if(F.col(f"__{c}").try_cast(kinds_of[c]).isNotNull() & ~F.col(f"__{c}").try_cast(kinds_of[c]).eqNullSafe(F.col(c))).alias(c) for c in APPLIED if c in kinds_of]
    done = joined.agg(*changed).unpivot([], [c for c in APPLIED if c in kinds_of], "field", "n").where("n > 0").select("field", F.lit(True).alias("applied"), "n")
    return done.unionByName(conflicts.where(~F.col("field").isin(*APPLIED)).groupBy("field").agg(F.count("*").alias("n")).select("field", F.lit(False).alias("applied"), "n"))


def pages_to_read(units: DataFrame, cache: DataFrame, order: Sequence[str]) -> DataFrame:
    """url, members and the first member's row of each page of an enrichable unit that the cache lacks."""
    own = units.where(is_enrichable())
    pages = own.groupBy("url").agg(F.count("*").alias("members"), F.min_by(F.struct(*own.columns), F.struct(*order)).alias("first"))
    return pages.join(cache.select("url"), "url", "left_anti")


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """rows with their places in an order, from 0, as column name, without bringing all rows to one task. The order has no ties.

    Rows are range-partitioned and sorted; a place is the number of rows in earlier partitions, of which there is one row
    each, plus the place in its own. The rows are cut off first, so that both counts see the same partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    dealt = dealt.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    base = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    return dealt.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__id", "__part", "__at", "__base")


def numbered_pages(pages: DataFrame) -> DataFrame:
    """page_id p00000, p00001, … by url."""
    return numbered(pages, ["url"], "__place").withColumn("page_id", F.format_string("p%05d", "__place")).drop("__place")


def queue_limit(pages: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first pages by url, most of them, found as a top-k; and those beyond."""
    last = pages.select("url").orderBy("url").limit(most).agg(F.max("url")).first()[0]
    queued = F.coalesce(F.col("url") <= F.lit(last).cast("string"), F.lit(False))
    return pages.where(queued), pages.where(~queued)


def quarantine(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid units, and invalid ones with an array of what is wrong."""
    judged = units.withColumn("violations", kinds.violations())
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def token_costs(pages: DataFrame, size: Column) -> DataFrame:
    """pages, tokens in and out, and the least, upper median and most characters of a page; one row.

    A page takes a token for four characters and 700 besides, not rounded, and gives 220. Without pages there are zeros and nulls.
    """
    sizes = pages.select(size.cast("double").alias("__size"))
    sums = sizes.agg(
        F.count("*").alias("pages"), F.coalesce(F.sum(F.col("__size") / 4 + 700), F.lit(0.0)).alias("tokens_in"), (F.count("*") * 220).alias("tokens_out"),
        F.min("__size").cast("long").alias("least"), F.max("__size").cast("long").alias("most"), F.lit(1).alias("__row"),
    )
    middle = selection.upper_median(sizes, F.col("__size")).select(F.lit(1).alias("__row"), F.col("median").cast("long").alias("median"))
    return sums.join(middle, "__row", "left").select("pages", "tokens_in", "tokens_out", "least", "median", "most")


def price_table(costs: DataFrame, rates: Sequence[tuple[str, float, float]]) -> DataFrame:
    """model, at_once, in_batch: the price of a row of token_costs by rates (model, in, out) for a million tokens; a batch costs half."""
    table = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o")) for name, i, o in rates]))
    price = F.col("tokens_in") / 1e6 * F.col("r.i") + F.col("tokens_out") / 1e6 * F.col("r.o")
    return costs.select("*", table.alias("r")).select("r.model", F.round(price, 2).alias("at_once"), F.round(price / 2, 2).alias("in_batch"))


def flat_cost(pages: DataFrame, rate_in: float, rate_out: float, batch: bool = True) -> DataFrame:
    """n and cost of so many pages at 5,000 tokens in and 200 out each, by rates for a million; half in a batch."""
    price = F.lit(5000 * rate_in + 200 * rate_out)
    return pages.agg(F.count("*").alias("n")).withColumn("cost", F.round(F.col("n") * price / 1e6 / (2 if batch else 1), 2))

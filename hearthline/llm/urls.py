"""URL filters by a sort-merge range join, in DataFrame functions only.

A rule is a host and a path; it fits its host and all subdomains where the url's path starts with the rule's. With the
host's labels reversed, host and path make one key, and the urls that a rule fits on one host are those whose key lies in
the interval of keys that start with the rule's. A url asks with one key for each number of labels that rules have, so
that subdomains need no rule of their own.

Rules and keys are range-partitioned and sorted together. Rules nest, so the rules open at any key form a stack: the
latest rule of each nesting depth that the key still starts with. Depths come from a sweep over the rules alone, one up
where an interval opens and one down where it closes. In the sweep over keys the latest rule of each depth is carried
on; what partitions carry over to later ones is one row for each partition. No host's rows need to meet in one task, and
no rule is compared with keys outside its interval.

The longest fitting rule wins (host and path together; then the longer host; then block). Where none fits, the verdict
is `default`, and `block` for a url without a host.

Defined results: null urls and urls without `://` have empty host and path; of equal rules with both verdicts block
holds; repeated rows are each judged; an empty table gives an empty result; no rules leave the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Sorts after every key that starts alike.
LAST = "\U0010ffff"


def url_parts(url: Column) -> tuple[Column, Column]:
    after = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def key_of(labels: Column, path: Column) -> Column:
    """labels: a host's, in order."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def nested_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with key, labels (their number) and depth (rules open at its start, itself included)."""
    labels = F.split(F.translate("host", UPPER, LOWER), r"\.", -1)
    keyed = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
    keyed = keyed.groupBy(key_of(labels, F.col("path")).alias("key"), F.array_join(F.reverse(labels), ".").alias("place")).agg(
        F.max("verdict").alias("verdict"), F.min(F.concat("host", "path")).alias("rule"), F.max(F.size(labels)).alias("labels"), F.max(F.length("host")).alias("host_length")
    )
    events = keyed.withColumns({"at": F.col("key"), "step": F.lit(1)}).unionByName(keyed.withColumns({"at": F.concat("key", F.lit(LAST)), "step": F.lit(-1)}))
    # a host's steps add up to 0, so one running sum over all hosts gives each one's depths, and no host's rules need to meet in one task
    n = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = cut(events.repartitionByRange(n, "place", "at").withColumn("part", F.spark_partition_id()))
    sums = events.groupBy("part").agg(F.sum("step").alias("all"))
    base = sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))  # a row for each partition
    sweep = Window.partitionBy("part").orderBy("place", "at").rowsBetween(Window.unboundedPreceding, 0)
    depths = events.withColumn("in_part", F.sum("step").over(sweep)).join(F.broadcast(base), "part").withColumn("depth", (F.col("in_part") + F.col("base")).cast("int"))
    return depths.where("step = 1").drop("at", "step", "place", "part", "in_part", "base")


def filter_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict."""
    spark = pages.sparkSession
    own = pages.drop("host", "path", "rule", "verdict")
    host, path = url_parts(F.col(url_col))
    rows = own.withColumns({"host": host, "path": path, "__row": F.monotonically_increasing_id()})
    nested = cut(nested_rules(rules))
    shape = nested.agg(F.max("depth").alias("depth"), F.sort_array(F.collect_set("labels")).alias("labels")).first()
    depths = range(1, (shape["depth"] or 0) + 1)
    found = "struct<length:int,host_length:int,block:boolean,rule:string,key:string>"
    labels = F.split("host", r"\.", -1)
    keys = [F.when(F.size(labels) >= n, key_of(F.slice(labels, -n, n), F.col("path"))) for n in shape["labels"] or []]
    asked = rows.withColumn("__keys", F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>"))
    asked = asked.select("*", F.explode_outer("__keys").alias("__key")).drop("__keys")
    opens = nested.select(F.col("key").alias("__key"), F.col("depth").alias("__depth"), F.struct(F.length("rule").alias("length"), "host_length", (F.col("verdict") == "block").alias("block"), "rule", "key").cast(found).alias("__rule"))
    line = asked.unionByName(opens, allowMissingColumns=True)
    # rules sort before keys that equal them, as their row number is null
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = cut(line.repartitionByRange(n, "__key", "__row").withColumn("__part", F.spark_partition_id()))
    latest = {d: F.when(F.col("__depth") == d, F.col("__rule")) for d in depths}
    if depths:
        ends = line.where("__depth is not null").groupBy("__part").agg(*[F.max_by(latest[d], F.when(F.col("__depth") == d, F.col("__key"))).alias(f"__e{d}") for d in depths])
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        ends = spark.range(n).select(F.col("id").cast("int").alias("__part")).join(ends, "__part", "left")
        carried = ends.select("__part", *[F.last(f"__e{d}", ignorenulls=True).over(before).alias(f"__c{d}") for d in depths])
        line = line.join(F.broadcast(carried), "__part", "left")
        sweep = Window.partitionBy("__part").orderBy("__key", "__row").rowsBetween(Window.unboundedPreceding, 0)
        line = line.withColumns({f"__s{d}": F.coalesce(F.last(latest[d], ignorenulls=True).over(sweep), F.col(f"__c{d}")) for d in depths})
    stack = F.array(*[F.col(f"__s{d}") for d in depths]) if depths else F.array().cast(f"array<{found}>")
    fits = F.filter(stack, lambda r: r.isNotNull() & F.startswith(F.col("__key"), r["key"]))
    best = line.where("__row is not null").withColumn("__best", F.array_max(fits))
    best = best.groupBy("__row").agg(*[F.first(c).alias(c) for c in [*own.columns, "host", "path"]], F.max("__best").alias("__best"))
    verdict = F.when(F.col("__best").isNull(), F.when(F.col("host") == "", "block").otherwise(default)).when(F.col("__best")["block"], "block").otherwise("allow")
    return best.select(*own.columns, "host", "path", F.col("__best")["rule"].alias("rule"), verdict.alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT u.*, r.*, row_number() OVER (PARTITION BY row ORDER BY length(h) + length(q) DESC, length(h) DESC, v DESC) AS k
      FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.q))
SELECT page_id, host, path, h || q AS rule, coalesce(v, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM m WHERE k = 1
"""

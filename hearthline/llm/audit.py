"""Which of several filters removes what, in every order of them.

Each document has a mask: the filters that it fails. Copies are found by partition refinement: texts are split by their length in code
points, then by the hashes of their first, second, third ... block, and what is alone in its class is dropped each time. Texts that are left are
compared whole, so hashes that meet by chance do no harm. All figures of all orders follow from the number of documents a part and a mask.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, let, table, words

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Where blocks start, in bytes: each is about 16 times as long as what stands before it. A string has less than 2^31.
STARTS = (0, 64, 1024, 16384, 262144, 4194304, 67108864, 1073741824)
#: Classes whose ids, 16 bytes each with what a hash table needs, are broadcast at most; beyond, they are joined by a shuffle.
MOST_BROADCAST = 500_000


def block_chain(text: Column, hashed=F.xxhash64) -> Column:
    """What a text is split by, round by round: its length in code points, then a hash of length and first block of its bytes, of these and the second block,
    and so on."""
    data = text.cast("binary")
    size = F.octet_length(data)
    ends = (*STARTS[1:], 2**31 - 1)
    blocks = F.array_compact(F.array(*[F.when(size > a, F.xxhash64(F.substring(data, a + 1, b - a))) for a, b in zip(STARTS, ends, strict=True)]))
    of = lambda x: F.concat(F.array(x["size"]), F.transform(x["blocks"], lambda _, i: hashed(x["size"], F.slice(x["blocks"], 1, i + 1))))
    return let(F.struct(F.length(text).cast("long").alias("size"), blocks.alias("blocks")), of)


def refine(rows: DataFrame) -> DataFrame:
    """The rows whose text may equal another's, with key, their last class. rows: chain and others, cut off.

    A round counts classes and drops rows that are alone in theirs; rows without a further block wait. Counts are made before they are
    shuffled, and classes with much of the table are joined by a broadcast, so no task gets all rows of a class. A round unites three parts,
    each with partitions of its own; they are put together to as many as rows has, or each round would have three times those of the last.
    """
    k, alive, parts = 0, rows, rows.rdd.getNumPartitions()
    size = F.size("chain")
    while True:
        left = alive.agg(F.count("*").alias("n"), F.max(size).alias("most")).first()
        if not left["n"] or left["most"] <= k:
            return alive.withColumn("key", F.element_at("chain", -1))
        here = alive.where(size > k).withColumn("key", F.get("chain", k))
        many = here.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        alive = cut(join_counted(here, many, "key", left["n"]).select(*rows.columns).unionByName(alive.where(size <= k)).coalesce(parts))
        k += 1


def copies(docs: DataFrame, rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hashed=F.xxhash64) -> DataFrame:
    """The rows whose text another document of a smaller id has. rows: id, chain, mark and others of docs, cut off.

    Rows without id are no copies and have none. The texts of classes that refinement leaves are grouped whole, each group in each task before
    it is shuffled; a group's least id then goes to its rows by class and mark, a second hash that tells texts of one class apart.
    """
    alive = cut(refine(rows.where(F.col(id_col).isNotNull())))
    total = alive.count()
    classes = cut(alive.groupBy("key").agg(F.count("*").alias("n")))
    said = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), said.alias("said"), F.element_at(block_chain(said, hashed), -1).alias("key"))
    texts = whole.join(F.broadcast(classes.drop("n")), "key") if classes.count() <= MOST_BROADCAST else join_counted(whole, classes, "key", total)
    least = texts.groupBy("key", "said").agg(F.min(id_col).alias("least")).select("key", marked("said").alias("mark"), "least")
    sizes = alive.groupBy("key", "mark").agg(F.count("*").alias("n"))
    facts = cut(least.join(sizes, ["key", "mark"]))
    return join_counted(alive, facts, ["key", "mark"], total).where(F.col(id_col) > F.col("least")).select(*rows.columns)


def marked(text: Column | str) -> Column:
    return F.xxhash64(F.lit(7), text)


def fails(text: Column, said: Column) -> Column:
    """The filters but E that a text fails, as bits. said: its words."""
    n, kinds = F.size(said), F.size(F.array_distinct(said))
    tests = {"A": n < 50, "B": 100 * kinds < 65 * n, "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}
    return sum((F.when(test, 1 << FILTERS.index(f)).otherwise(0) for f, test in tests.items()), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of a part with one mask, and those of them that labels calls good or toxic."""
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words(text).alias("said"))
    rows = rows.select("doc_id", "part", fails(F.col("text"), F.col("said")).alias("mask"), block_chain(F.col("text")).alias("chain"), marked("text").alias("mark"))
    rows = cut(rows.join(flags, "doc_id", "left").withColumns({k: F.coalesce(k, F.lit(False)).cast("long") for k in ("good", "toxic")}))
    counts = lambda df, sign, bit: df.groupBy("part", (F.col("mask") + bit).alias("mask")).agg(*[(sign * F.sum(c)).alias(k) for k, c in (("n", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic")))])
    found = cut(counts(copies(docs, rows), 1, 0))
    moved = [found.select("part", (F.col("mask") + bit).alias("mask"), *[(sign * F.col(k)).alias(k) for k in ("n", "good", "toxic")]) for sign, bit in ((-1, 0), (1, COPY))]
    every = counts(rows, 1, 0).unionByName(moved[0]).unionByName(moved[1])
    return every.groupBy("part", "mask").agg(*[F.sum(k).cast("long").alias(k) for k in ("n", "good", "toxic")])


def audit(counts: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step, zeros included, from part, mask, n, good, toxic.

    A step depends on its filter and on which come before, not on their order: 2560 combinations of mask, filter and set before, from which
    a part's 80 rows of filter and set are summed up, which the 600 steps of the 120 orders then take.
    """
    spark, bits = counts.sparkSession, range(len(FILTERS))
    cases = []
    for f in bits:
        for before in (sum(1 << k for k in c) for r in range(len(FILTERS)) for c in combinations([k for k in bits if k != f], r)):
            for mask in range(1 << len(FILTERS)):
                has, gone = mask >> f & 1, mask & before > 0
                cases.append((f, before, mask, int(not gone and not has), int(has and not gone), int(has and gone), int(mask == 1 << f), 120 // mask.bit_count() if has else 0))
    kinds = F.broadcast(spark.createDataFrame(cases, "filter int, before int, mask int, kept long, removed long, redundant long, unique_fails long, shapley long"))
    orders = [("".join(FILTERS[k] for k in order), i + 1, f, sum(1 << k for k in order[:i])) for order in permutations(bits) for i, f in enumerate(order)]
    steps = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter int, before int"))
    sums = {k: F.sum(F.col("n") * F.col(k)) for k in ("kept", "removed", "redundant", "unique_fails")} | {f"{k}_lost": F.sum(F.col(k) * F.col("removed")) for k in ("good", "toxic")} | {"shapley": F.sum(F.col("n") * F.col("shapley"))}
    by_set = counts.join(kinds, "mask").groupBy("part", "filter", "before").agg(*[c.cast("long").alias(k) for k, c in sums.items()])
    return by_set.join(steps, ["filter", "before"]).select("part", "filter_order", "step", *sums)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over docs (doc_id, text, source), with labels (doc_id, quality, toxic).

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * letters A-Z > 5 * code points; D: one of # $ % & * |; E: the text of a document
    of a smaller id. A null text is empty, a null source the part of the empty string. Rows that share an id are no copies of each other;
    rows without id are no copies, have none and no labels. Of repeated labels any that says 1 counts. Texts of any length are
    read whole; an empty table gives no rows; other columns are not read.
    """
    return audit(masks(docs, labels))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        len(w) < 50 AS fa, 100 * len(list_distinct(w)) < 65 * len(w) AS fb,
        100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS fc, regexp_matches(text, '[#$%&*|]') AS fd,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS fe
      FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, (fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT) AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
x AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
p AS (SELECT [a.i, b.i, c.i, e.i, f.i] AS o FROM x a, x b, x c, x e, x f WHERE len(list_distinct([a.i, b.i, c.i, e.i, f.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda k: substr('ABCDE', k + 1, 1)), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, o FROM p),
t AS (SELECT filter_order, step, 1 << o[step] AS bit, coalesce(list_sum(list_transform(o[1:step - 1], lambda k: 1 << k)), 0)::INT AS before FROM s),
r AS (SELECT part, filter_order, step, bit,
        sum(n) FILTER (mask & before = 0 AND mask & bit = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
        sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
      FROM m, t GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""

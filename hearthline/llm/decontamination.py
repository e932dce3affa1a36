"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

Texts are lower-cased words; shingles are 5 words (all words of an item with fewer), hashed to 64 bits. A window is as long as an item
(or the whole text, where that is shorter), and starts at any word.

1. Bound: of two bags of a and b shingles at weighted similarity s, s * (a + b) / (1 + s) shingles at least are in both. So only windows
   of which so many shingles are shingles of some item of their length are kept; all others are below 0.8 to every item. This loses
   nothing, and leaves the SimHash of nearly all of a clean table's windows unmade.
2. A window's SimHash has 64 bits; its shingles count as often as they occur. Radius: two bags at similarity 0.8 differ in about 10 bits,
   with a deviation of 3, and equal bags in none; RADIUS is 20.
3. Multi-index: 64 bits are cut into RADIUS + 1 blocks. Two fingerprints within the radius agree in one block at least, so a join on
   (length, block, value) finds all items whose fingerprint lies within the radius; those beyond it are then left out.
4. What remains is verified: the weighted Jaccard similarity (sum of the least over sum of the greatest count of each
   shingle) has to be 0.8 or more. Of the windows for a text and an item the most similar counts, of those the first.
5. The rest: a few pairs at 0.8 differ in more bits than the radius (0.4 % of items of 5 shingles, 0.02 % of 45, most where one shingle makes much of a
   bag). So of texts with windows left by step 1, those pairs of text and item are found that share enough shingles anywhere and that the index has not
   given; their windows are verified without the radius. No leak is lost.

At 0.8 the index alone can't choose: blocks of 3 bits agree by chance in most pairs, and 0.2 % of random pairs lie within the radius.
That is why the bound comes first.

Defined results: null and empty texts and items match nothing; a text shorter than an item is one window; repeated rows
of text or item count once; rows without id are judged too; an empty table, or none of items, gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, table, window_hashes, words

N, SIMILARITY, BITS, RADIUS = 5, 0.8, 64, 20
#: Numbers (8 bytes each, those in arrays counted) of a side that is broadcast at most; larger sides are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: First bit of each block, and the end.
BLOCKS = [round(k * BITS / (RADIUS + 1)) for k in range(RADIUS + 2)]


def bounded(df: DataFrame, n: int) -> DataFrame:
    """df, broadcast if its n numbers are few. n: what its rows and their arrays hold, not only the rows."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def fingerprint(shingles: Column) -> Column:
    """SimHash: each bit is set where more than half of the shingles have it set. Bits b and b + 32 are counted in the halves of one number."""
    one = F.lit(1).cast("bigint")
    pair = F.lit((1 << 32) | 1).cast("bigint")

    def bits(h: Column) -> Column:
        def count(b: Column) -> Column:
            return F.aggregate(h, F.lit(0).cast("bigint"), lambda n, x: n + F.call_function("shiftrightunsigned", x, b).bitwiseAND(pair))

        def majority(n: Column, b: Column) -> Column:
            low, high = n.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftrightunsigned(n, 32)
            set_if = lambda c, at: F.when(c * 2 > F.size(h), F.call_function("shiftleft", one, at)).otherwise(F.lit(0).cast("bigint"))
            return set_if(low, b).bitwiseOR(set_if(high, b + 32))

        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS // 2 - 1)), F.lit(0).cast("bigint"), lambda out, b: out.bitwiseOR(let(count(b), lambda n: majority(n, b))))

    return let(shingles, bits)


def blocks(fp: Column) -> Column:
    """array<struct<block,value>>."""
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint")).alias("value")) for k, (lo, hi) in enumerate(zip(BLOCKS, BLOCKS[1:], strict=False))])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays, by their shared occurrences. Where values repeat, occurrences are numbered first, so that a
    bag is a set of (value, number)."""

    def numbered(xs: Column) -> Column:
        return let(F.sort_array(xs), lambda s: F.transform(s, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(s, x)).alias("k"))))

    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.size(F.array_intersect(numbered(a), numbered(b))))
    return let(both, lambda n: n / (F.size(a) + F.size(b) - n))


def item_table(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a key of id and text), its id, words, shingle length n and shingles; distinct rows with a word."""
    w = words(F.lower(text_col))
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("t"), w.alias("w")).where(F.size("w") > 0)
    rows = rows.select(F.xxhash64("item_id", "t").alias("item"), "item_id", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(N)).alias("n"), F.col("w")).distinct()
    by_n = F.coalesce(*[F.when(F.col("n") == n, window_hashes(F.col("w"), n)) for n in range(1, N + 1)])
    return rows.select("item", "item_id", "n_words", "n", by_n.alias("shingles"))


def least_shared(a: Column, b: Column) -> Column:
    """How many shingles bags of a and b shingles have in common at least, if their similarity is SIMILARITY."""
    return F.ceil(SIMILARITY / (1 + SIMILARITY) * (a + b) - 1e-9).cast("int")


def starts(spots: Column, size: Column, k: Column, n: Column) -> Column:
    """Starts of the windows of k words that have enough of the spots (places of known shingles, in order). size: words of the text."""
    length = F.least(size, k) - n + 1
    need = F.greatest(least_shared(length, k - n + 1), F.lit(1))

    def runs(p: Column) -> Column:
        some = F.transform(p, lambda x, i: F.struct(x.alias("first"), F.get(p, i + need - 1).alias("last")))
        some = F.filter(some, lambda r: r["last"] - r["first"] < length)
        first = lambda r: F.greatest(F.lit(0), r["last"] - length + 1)
        last = lambda r: F.least(r["first"], F.greatest(size - k, F.lit(0)))
        spans = F.filter(F.transform(some, lambda r: F.struct(first(r).alias("a"), last(r).alias("b"))), lambda r: r["a"] <= r["b"])
        # each start once: of spans in order, the part beyond the one before
        return let(spans, lambda s: F.flatten(F.transform(s, lambda r, i: let(F.greatest(r["a"], F.when(i > 0, F.get(s, F.greatest(i - 1, F.lit(0)))["b"] + 1).otherwise(0)), lambda a: F.when(a <= r["b"], F.sequence(a, r["b"])).otherwise(F.array().cast("array<int>"))))))

    return let(spots, runs)


def possible_pairs(texts: DataFrame, items: DataFrame, grams: list[int]) -> DataFrame:
    """pid, ph, possible, pk: of each text (id, text_hash, size and its hashes) the items, and their words, of which it has so many shingles as a leak
    needs, wherever they stand. What an item repeats counts as often, so this leaves out no leak."""
    parts = items.select("item", "n", F.col("n_words").alias("pk"), F.size("shingles").alias("of_item"), F.explode("shingles").alias("shingle")).groupBy("item", "n", "pk", "of_item", "shingle").agg(F.count("*").alias("times"))
    parts = bounded(parts, 5 * parts.count())
    own = [texts.select("id", "text_hash", "size", F.lit(n).alias("n"), F.explode(F.array_distinct(f"h{n}")).alias("shingle")) for n in grams]
    shared = reduce(DataFrame.unionByName, own).join(parts, ["n", "shingle"]).groupBy("id", "text_hash", "size", "n", "item", "pk", "of_item").agg(F.sum("times").alias("shared"))
    length = F.least("size", "pk") - F.col("n") + 1
    return shared.where(F.col("shared") >= least_shared(length, F.col("of_item"))).select(F.col("id").alias("pid"), F.col("text_hash").alias("ph"), F.col("item").alias("possible"), "pk")


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, text_hash, item_id, start (first word of the window), n_words, hamming and similarity of each pair of text and item."""
    items = cut(item_table(items, item_id, item_text))
    grams = sorted(r["n"] for r in items.select("n").distinct().collect())  # at most N
    known = cut(items.select("n", F.col("n_words").alias("k"), F.explode("shingles").alias("shingle")).groupBy("n", "shingle").agg(F.sort_array(F.collect_set("k")).alias("ks")))
    known = bounded(known, known.agg(F.sum(F.size("ks") + 4)).first()[0] or 0)
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    w = words(F.lower("t"))
    hits = None
    for n in grams:
        shingles = own.select("id", "text_hash", w.alias("w")).select("*", F.size("w").alias("size")).select("id", "text_hash", "size", F.posexplode(window_hashes(F.col("w"), n)).alias("at", "shingle"))
        found = shingles.join(known.where(F.col("n") == n).drop("n"), "shingle").select("id", "text_hash", "size", F.lit(n).alias("n"), "at", F.explode("ks").alias("k"))
        hits = found if hits is None else hits.unionByName(found)
    empty = "id string, text_hash long, item_id string, start int, n_words int, hamming int, similarity double"
    if hits is None:
        return docs.sparkSession.createDataFrame([], empty).select(F.col("id").cast(docs.schema[id_col].dataType), *[c.split()[0] for c in empty.split(", ")[1:]])
    # one row for a text and an item length; its spots are no more than the text's words
    spots = hits.groupBy("id", "text_hash", "size", "n", "k").agg(F.sort_array(F.collect_set("at")).alias("spots"))
    spots = spots.withColumn("starts", starts(F.col("spots"), F.col("size"), F.col("k"), F.col("n"))).where(F.size("starts") > 0)
    spots = cut(spots.groupBy("id", "text_hash").agg(F.collect_list(F.struct("n", "k", "starts")).alias("asked"), F.sum(F.size("starts")).alias("n_starts")))
    wanted = bounded(spots.select(F.col("id").alias("sid"), F.col("text_hash").alias("sh"), "asked"), spots.agg(F.sum(F.col("n_starts") + 8)).first()[0] or 0)
    again = own.join(wanted, F.col("id").eqNullSafe(F.col("sid")) & (F.col("text_hash") == F.col("sh")))
    again = again.dropDuplicates(["id", "text_hash"]).select("id", "text_hash", w.alias("w"), "asked")
    again = cut(again.select("id", "text_hash", F.size("w").alias("size"), *[window_hashes(F.col("w"), n).alias(f"h{n}") for n in grams], "asked"))
    possible = possible_pairs(again, items, grams)
    again = again.withColumn("s", F.explode("asked"))
    hashes = F.coalesce(*[F.when(F.col("s.n") == n, F.col(f"h{n}")) for n in grams])
    windows = again.select("id", "text_hash", "s.n", "s.k", hashes.alias("h"), F.explode("s.starts").alias("start"))
    windows = windows.select("id", "text_hash", "n", "k", "start", F.slice("h", F.col("start") + 1, F.col("k") - F.col("n") + 1).alias("window"))
    windows = cut(windows.withColumns({"fp": fingerprint(F.col("window")), "row": F.monotonically_increasing_id()}))
    prints = cut(items.select("item", "item_id", "n_words", F.col("n").alias("item_n"), F.col("n_words").alias("k"), "shingles", fingerprint(F.col("shingles")).alias("item_fp")))
    weight = prints.agg(F.sum(F.size("shingles") + 8)).first()[0] or 0
    index = prints.select("item", "k", "item_n", "item_fp", F.explode(blocks(F.col("item_fp"))).alias("b")).select("item", F.col("item_n").alias("n"), "k", "item_fp", "b.block", "b.value")
    near = windows.select("row", "n", "k", "fp", F.explode(blocks(F.col("fp"))).alias("b")).select("row", "n", "k", "fp", "b.block", "b.value")
    near = near.join(bounded(index, prints.count() * (RADIUS + 1)), ["n", "k", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("row", "item").distinct()
    prints = bounded(prints, weight)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).withColumn("similarity", similarity(F.col("window"), F.col("shingles")))
        return pairs.where(F.col("similarity") >= SIMILARITY).select("id", "text_hash", "item", "item_id", "n_words", "start", "similarity", "hamming")

    given = cut(verified(windows.drop("n", "k").join(near, "row").join(prints, "item")))
    same = F.col("id").eqNullSafe(F.col("pid")) & (F.col("text_hash") == F.col("ph"))
    rest = possible.join(given.select("id", "text_hash", "item").distinct(), same & (F.col("item") == F.col("possible")), "left_anti")
    others = windows.join(rest, same & (F.col("k") == F.col("pk"))).drop("n", "k").withColumnRenamed("possible", "item").join(prints, "item")
    best = given.unionByName(verified(others)).groupBy("id", "text_hash", "item", "item_id", "n_words").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("hamming")).alias("h"))).alias("b"))
    return best.select("id", "text_hash", "item_id", (-F.col("b.back")).alias("start"), "n_words", (-F.col("b.h")).cast("int").alias("hamming"), F.col("b.similarity").alias("similarity"))


def without_leaks(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The rows of docs in which no item is found."""
    leaks = cut(find_leaks(docs, items, **names).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    return docs.join(bounded(leaks, 2 * leaks.count()), F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "n_words", "hamming", "similarity")

"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a column that is true where a text is rejected. A sample of rows is cut off; on it each rule's cost is measured, as
the time of a job that computes the rule less that of one that only reads the sample, and one more job finds
which rules reject which rows. From that the driver orders the rules, each time taking the rule
that rejects most of the rows still alive for its cost. In that order they become one CASE, of which Spark evaluates a
branch only where all earlier ones did not reject. The verdict does not depend on the order, nor on how the measurement came out.

Defined results: null texts are empty; an empty text has no words and is rejected by the rule on few words; an empty
table gives an empty result; repeated rows are judged alike; other columns stay as they are.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, table, window_hashes, word_count, words

SYMBOLS = r"[#*$%&|<>]"
#: Rows that the cascade's order is estimated on, about.
SAMPLE_ROWS = 2_000


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(word_array: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more.

    Windows are compared by 64-bit hashes. Only texts in which some hash comes twice sort them; neighbours that are equal give the
    windows' places, and each place adds the words up to the next one, n at most.
    """

    def places(s: Column) -> Column:
        at = F.transform(s, lambda e, j: F.when((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == e["h"]) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)), e["i"]))
        return F.sort_array(F.filter(at, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda v, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - v, F.lit(n)))), F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(pairs, places), covered)).otherwise(F.lit(0)).cast("long")

    return let(window_hashes(word_array, n), count)


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")


def word_chars(word_array: Column) -> Column:
    return F.length(F.array_join(word_array, "")).cast("long")


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    own = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    stats = let(
        words(F.col(text_col)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(F.col(text_col)).alias("n_symbols"), n_dup_lines(F.col(text_col)).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words")),
    )
    return own.withColumn("__stats", stats).select(*own.columns, "__stats.*")


@dataclass(frozen=True)
class Rule:
    """rejects: true where a row is rejected, never null."""

    name: str
    rejects: Column


def default_rules(text: Column) -> list[Rule]:
    """The rules, each computed from the text alone."""
    w = words(text)
    n_words = word_count(text)
    return [
        Rule("few_words", n_words < 10),
        Rule("symbols", 10 * n_symbols(text) > 3 * n_words),
        Rule("capitals", 2 * F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Z]")) > F.length(F.coalesce(text, F.lit("")))),
        Rule("dup_lines", 2 * n_dup_lines(text) > F.size(F.split(F.coalesce(text, F.lit("")), "\n"))),
        Rule("word_length", let(w, lambda x: (word_chars(x) < 2 * F.size(x)) | (word_chars(x) > 15 * F.size(x)))),
        Rule("repeats", let(w, lambda x: 100 * n_repeat_words(x) > 20 * F.size(x))),
    ]


def rules_on_stats() -> list[Rule]:
    """The same rules over columns of with_stats and `text`."""
    n = F.col("n_words")
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        Rule("few_words", n < 10),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("capitals", 2 * F.regexp_count(text, F.lit("[A-Z]")) > F.length(text)),
        Rule("dup_lines", 2 * F.col("n_dup_lines") > F.size(F.split(text, "\n"))),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("repeats", 100 * F.col("n_repeat_words") > 20 * n),
    ]


def sample_of(docs: DataFrame, columns: list[str], sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About sample_rows rows from all over the table, cut off in one partition; they only choose an order."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    rows = docs.select(*columns)
    return cut((rows.sample(share, seed) if share < 1 else rows).repartition(1))


def measured_costs(sample: DataFrame, rules: list[Rule], times: int = 2) -> list[float]:
    """Seconds that each rule takes on the sample, of several runs the shortest, without what reading alone takes; 0.1 ms at least."""

    def seconds(c: Column) -> float:
        took = []
        for _ in range(times):
            start = time.perf_counter()
            sample.agg(F.count_if(c)).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    reading = seconds(F.col(sample.columns[0]).isNull())
    return [max(1e-4, seconds(r.rejects) - reading) for r in rules]


def order_rules(sample: DataFrame, rules: list[Rule], costs: list[float] | None = None) -> list[Rule]:
    """rules by what they reject for their cost among rows that the earlier ones let pass, both found on the sample.

    Its rows come back as counts for each set of rejecting rules, at most two to the power of the number of rules.
    """
    costs = measured_costs(sample, rules) if costs is None else costs
    mask = sum((F.when(r.rejects, 1 << k).otherwise(0) for k, r in enumerate(rules)), F.lit(0))
    seen = sample.select(mask.alias("m")).groupBy("m").agg(F.count("*").alias("n")).collect()
    left, order = list(range(len(rules))), []
    while left:
        alive = [r for r in seen if not any(r["m"] >> k & 1 for k in order)]
        best = max(left, key=lambda k: (sum(r["n"] for r in alive if r["m"] >> k & 1) / costs[k], -costs[k]))  # noqa: B023
        left.remove(best)
        order.append(best)
    return [rules[k] for k in order]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule, in this order, that rejects; null where none does."""
    first = F.when(rules[0].rejects, rules[0].name)
    for r in rules[1:]:
        first = first.when(r.rejects, r.name)
    return first


def quality_filter(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, by the ordered cascade: a text is put to the rules until one rejects it."""
    return docs.where(cascade(order_rules(sample_of(docs, [text_col], sample_rows), default_rules(F.col(text_col)))).isNull())


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract asks for every statistic of every row, so here the cascade decides over computed ones and saves only what it reads besides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = cut(with_stats(sample_of(docs, docs.columns)))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = with_stats(docs).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & cascade(order_rules(sample, rules_on_stats())).isNull()).drop("text")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row_number() OVER () AS row, *, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM d),
g AS (SELECT row, i, list_slice(w, i, i + 4) AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM l)),
c AS (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
r AS (SELECT row, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words FROM c GROUP BY row),
s AS (SELECT doc_id, text, lines, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM l LEFT JOIN r USING (row))
SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
       OR 2 * len(regexp_extract_all(text, '[A-Z]')) > length(text) OR 2 * n_dup_lines > len(lines)
       OR coalesce(word_chars, 0) < 2 * n_words OR coalesce(word_chars, 0) > 15 * n_words) AS kept
FROM s
"""

"""What the text operators share: tables, words, let-bindings and checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, ensure_checkpoint_dir

__all__ = ["HEAVY", "SPACES", "WORD", "cut", "ensure_checkpoint_dir", "join_counted", "let", "table", "window_hashes", "word_count", "words"]

#: A word: a run of code points other than space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def window_hashes(word_array: Column, n: int) -> Column:
    """The 64-bit hash of each n-word window, in order; empty for fewer than n words. Each word is hashed once."""
    return let(
        F.transform(word_array, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>")),
    )


#: Keys that hold one in HEAVY of all rows or more; there can be no more than HEAVY of them.
HEAVY = 500


def join_counted(rows: DataFrame, facts: DataFrame, key: str | list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined to facts, which has one row a key and column n, the key's number of rows; that is dropped.

    Facts of keys with one in HEAVY of all rows or more, at most HEAVY, are broadcast: such a key's rows stay where they lie and no task
    gets them all. The others are joined by a shuffle. rows is read twice, so it should be cut off before.
    """
    least = max(1000, total // HEAVY)
    heavy, light = F.broadcast(facts.where(F.col(n) >= least).drop(n)), facts.where(F.col(n) < least).drop(n)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))

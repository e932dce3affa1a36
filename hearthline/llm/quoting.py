"""Chat formatting by quotation linking.

Lines that start with `>` are quoted, as deep as they have `>`; neighbouring lines of one depth are a passage. Passages are
normalised (case, spaces, marks at the ends of words) and hashed whole, and line by line for lines of 3 words or more. The same hashes
of what messages say themselves name the original: the earliest message of the conversation that says the passage, if
it is earlier than the one that quotes it. A message replies to the latest original of its depth-1 passages, or, where no passage is
found whole, of their lines. Replies and what they answer form threads, found by pointer doubling, and (thread_turn, turn)
is the reply order: a thread's messages together, each after what it answers; position is a message's place in it, from 0. Texts come back
without quoted lines and the attribution lines over them.

A conversation is never gathered in one task: originals are minima by conversation and hash, links are one row for each
message that quotes, and positions come from one range sort of all messages, in which a long conversation spreads over partitions.

Defined results: null texts are empty; a message that quotes nothing known starts a thread; rows without conversation or
turn start their own and have no position; rows that repeat a turn share its links and have places of their own; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

QUOTED = re.compile(r"[\x20\t]*>(?:[\x20\t]?>)*\x20?")
ATTRIBUTION = re.compile(r"(?i)\b(?:wrote|writes|said|a écrit|schrieb|escribió)\s*:\s*$")
LINE_WORDS = 3


def normal(passage: str) -> str:
    return " ".join(w for w in (x.strip(".,;:!?\"'()") for x in passage.casefold().split()) if w)


def key(passage: str) -> int | None:
    n = normal(passage)
    return int.from_bytes(hashlib.blake2b(n.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) if n else None


def line_keys(lines: list[str]) -> list[int]:
    return [k for x in lines if len(x.split()) >= LINE_WORDS and (k := key(x)) is not None]


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(depth, lines) in order; depth 0 is the message's own."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = QUOTED.match(line)
        depth, rest = (m.group().count(">"), line[m.end() :]) if m else (0, line)
        if not out or out[-1][0] != depth:
            out.append((depth, []))
        out[-1][1].append(rest)
    for (depth, lines), (after, _) in zip(out, out[1:], strict=False):
        if depth == 0 and after > 0:
            told = False
            while lines and (not lines[-1].strip() or not told and ATTRIBUTION.search(lines[-1])):
                last = lines.pop()
                told = told or bool(last.strip())
    return out


def parse(texts: pd.Series) -> pd.DataFrame:
    clean, own, quoted = [], [], []
    for text in texts:
        parts = passages(text or "")
        says = [lines for depth, lines in parts if depth == 0]
        if len(parts) == 1 and parts[0][0] == 0:
            clean.append(text or "")
        else:
            clean.append("\n".join("\n".join(x) for x in says if x).strip("\n"))
        said = [key("\n".join("\n".join(x) for x in says)), *(key("\n".join(x)) for x in says), *(k for x in says for k in line_keys(x))]
        own.append(sorted({k for k in said if k is not None}))
        quoted.append([{"depth": depth, "whole": k, "lines": line_keys(lines)} for depth, lines in parts if depth and (k := key("\n".join(lines))) is not None])
    return pd.DataFrame({"clean": clean, "own": own, "quoted": quoted})


def link_quotes(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """messages with text without quotes, parent_turn (null: none), thread_turn, position, n_quotes and n_linked."""
    parsed = F.pandas_udf(parse, "clean string, own array<long>, quoted array<struct<depth:int,whole:long,lines:array<long>>>")
    own = messages.drop("parent_turn", "thread_turn", "position", "n_quotes", "n_linked")
    rows = cut(own.withColumn("__p", parsed(text_col)).withColumns({"__c": F.col(conv_col), "__t": F.col(turn_col)}))
    known = rows.where("__c is not null and __t is not null")
    asks = known.select("__c", "__t", F.posexplode("__p.quoted").alias("at", "q")).select("__c", "__t", "at", "q.depth", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("q.whole").alias("key"))), F.transform("q.lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("key"))))).alias("k")).select("__c", "__t", "at", "depth", "k.whole", "k.key").distinct()
    asks = cut(asks)
    if not asks.isEmpty():
        wanted = asks.select("__c", "key").distinct()
        says = known.select("__c", "__t", F.explode("__p.own").alias("key")).groupBy("__c", "key").agg(F.min("__t").alias("origin"))
        found = asks.join(says.join(wanted, ["__c", "key"]), ["__c", "key"]).where("origin < __t")
        linked = found.groupBy("__c", "__t", "at", "depth").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("whole"), F.col("origin"))).alias("by_whole"), F.max("origin").alias("by_line"))
        first = F.col("depth") == 1
        links = linked.groupBy("__c", "__t").agg(F.coalesce(F.max(F.when(first, F.col("by_whole"))), F.max(F.when(first, F.col("by_line")))).alias("parent_turn"), F.count("*").alias("n_linked"))
        links = cut(links)
        roots = roots_of(links.where("parent_turn is not null").select("__c", "__t", F.col("parent_turn").alias("up")))
        rows = rows.join(links, ["__c", "__t"], "left").join(roots.withColumnRenamed("up", "thread_turn"), ["__c", "__t"], "left")
    else:
        rows = rows.withColumns({"parent_turn": F.lit(None).cast("long"), "thread_turn": F.lit(None).cast("long"), "n_linked": F.lit(0).cast("long")})
    cols = [F.col("__p.clean").alias(text_col) if c == text_col else F.col(c) for c in own.columns]
    out = rows.select(*cols, "__c", "__t", F.col("parent_turn").cast("long").alias("parent_turn"), F.coalesce("thread_turn", F.col(turn_col)).cast("long").alias("thread_turn"), F.size("__p.quoted").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    return with_positions(out, text_col).select(*own.columns, "parent_turn", "thread_turn", "position", "n_quotes", "n_linked")


def with_positions(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with position, a row's place in its conversation's reply order; null for rows without conversation or turn.

    Rows that share thread, turn and text, whatever else they have, take their places in any order. Rows are range-partitioned by that order. A place is the place in its partition plus the conversation's rows in earlier partitions,
    which only a conversation that crosses a border has: no more rows than there are partitions, twice.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["thread_turn", "__t", F.xxhash64(text_col)]
    placed = F.col("__c").isNotNull() & F.col("__t").isNotNull()
    dealt = cut(rows.repartitionByRange(n, "__c", *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.where(placed).groupBy("__c", "__part").agg(F.count("*").alias("n"))
    crossing = counts.groupBy("__c").agg(F.sort_array(F.collect_list(F.struct("__part", "n"))).alias("parts")).where(F.size("parts") > 1)
    before = crossing.select("__c", F.posexplode("parts").alias("i", "p"), "parts").select("__c", "p.__part", F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("base"))
    here = F.row_number().over(Window.partitionBy("__part", "__c").orderBy(*order)) - 1
    numbered = dealt.withColumn("__here", here).join(F.broadcast(before), ["__c", "__part"], "left")
    return numbered.withColumn("position", F.when(placed, F.col("__here") + F.coalesce("base", F.lit(0))).cast("long"))


def roots_of(links: DataFrame) -> DataFrame:
    """__c, __t, up with up moved to the end of the chain of links: twice as far each round, until none moves."""
    while True:
        higher = links.select("__c", F.col("__t").alias("up"), F.col("up").alias("far"))
        moved = cut(links.join(higher, ["__c", "up"], "left"))
        if moved.where("far is not null").isEmpty():
            return links
        links = moved.select("__c", "__t", F.coalesce("far", "up").alias("up"))


def op5_quote_chat(spark, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text", "parent_turn", "thread_turn", "position", "n_quotes", "n_linked")

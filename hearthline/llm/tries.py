"""The prefix trie of conversations: which share their first turns, and what that saves.

A prefix has an id of 128 bits: two sums of hash(turn i) * R**i, modulo 2**64. Such sums add up over partitions, so conversations of any
length are numbered where their turns lie. A node's owner is its least member. Nodes of one owner form a chain; a chain hangs on a node
of another, and the way there, (-depth, owner) for each chain that is entered, is a key by which conversations are put in lexicographic order:
the members of a node then are neighbours, and nodes by their owner's rank and depth are in preorder. A subtree is an interval of that order,
and its leaves and savings are differences of running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, table, word_count
from .scans import PART, extended, ordered, running

#: What the two sums multiply by: odd, so that no turn's part is lost; arbitrary otherwise.
R = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MOST = 1 << 64
#: How many first turns a conversation takes over at most, and from whom: the first of its block.
HEAD, BLOCK = 3, 20


def powers(r: int, n: int) -> np.ndarray:
    """r to the power of 0 to n, modulo 2**64."""
    out = np.full(n + 1, r, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def runs(keys: pa.Array) -> tuple[list, np.ndarray]:
    """The keys of runs of equal keys, and where they start."""
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
    return [keys[int(i)].as_py() for i in starts], starts


def in_run(starts: np.ndarray, rows: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's run and its place there, from 1; the first run goes on after so many rows."""
    run = np.repeat(np.arange(len(starts)), np.diff([*starts, rows]))
    return run, np.arange(rows) - starts[run] + 1 + np.where(run == 0, first, 0)


def terms(batch: pa.RecordBatch, k: int, run: np.ndarray, place: np.ndarray, first: int) -> np.ndarray:
    """hash * R**place of each row; places of the first run begin after first."""
    local = np.where(run == 0, place - first, place)
    scale = np.where(run == 0, np.uint64(pow(R[k], first, MOST)), np.uint64(1))
    return unsigned(batch.column(f"x{k}")) * powers(R[k], int(local.max()))[local] * scale


def tails(df: DataFrame) -> dict[int, tuple]:
    """By partition what an unfinished conversation brings into it: its key, turns and sums so far."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, key, n, sums, several = None, None, None, 0, [0, 0], False
        for batch in (b for b in batches if b.num_rows):
            keys, starts = runs(batch.column("c"))
            if part is None:
                part, head = batch.column(PART)[0].as_py(), keys[0]
            elif keys[0] != key:
                n, sums, several = 0, [0, 0], True
            run, place = in_run(starts, batch.num_rows, n)
            at = run == len(starts) - 1
            for k in (0, 1):
                here = int(terms(batch, k, run, place, n)[at].sum(dtype=np.uint64))
                sums[k] = (here + (sums[k] if len(starts) == 1 else 0)) % MOST
            key, n, several = keys[-1], int(place[-1]), several or len(starts) > 1
        if part is not None:
            signed = [int(np.uint64(s).astype(np.int64)) for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (part, head, key, n, *signed, several)], ["part", "head", "key", "n", "s0", "s1", "several"])

    found = df.mapInArrow(last, f"part long, head {dict(df.dtypes)['c']}, key {dict(df.dtypes)['c']}, n long, s0 long, s1 long, several boolean").collect()
    carry, state = {}, None
    for r in sorted(found, key=lambda r: r["part"]):
        goes_on = state is not None and state[0] == r["head"]
        carry[r["part"]] = state if goes_on else (r["head"], 0, 0, 0)
        s = [r["s0"] % MOST, r["s1"] % MOST]
        if goes_on and not r["several"]:
            state = (r["key"], state[1] + r["n"], *[(state[2 + k] + s[k] * pow(R[k], state[1], MOST)) % MOST for k in (0, 1)])
        else:
            state = (r["key"], r["n"], *s)
    return carry


def prefixes(turns: DataFrame) -> DataFrame:
    """c, pos, p0, p1, q0, q1, w of each turn: its place from 1, the ids of the prefixes with and without it, and its words.

    turns: c, turn, role, text. Turns are ordered by turn (null first), role and text.
    """
    said = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("role", "text")]
    rows = turns.where("c is not null").select("c", "turn", *said)
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(f"x{k}") for k in (0, 1)]
    df = ordered(rows, F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), columns=["c", *hashes, word_count(F.col("text")).alias("w")])
    carry = tails(df)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in (b for b in batches if b.num_rows):
            if state is None:
                state = carry[batch.column(PART)[0].as_py()]
            keys, starts = runs(batch.column("c"))
            if keys[0] != state[0]:
                state = (keys[0], 0, 0, 0)
            run, place = in_run(starts, batch.num_rows, state[1])
            out = []
            for k in (0, 1):
                part = terms(batch, k, run, place, state[1])
                total = np.concatenate([[np.uint64(0)], np.cumsum(part)])
                upto = total[1:] - total[starts][run] + np.where(run == 0, np.uint64(state[2 + k]), np.uint64(0))
                out.append((upto, upto - part))
            state = (keys[-1], int(place[-1]), int(out[0][0][-1]), int(out[1][0][-1]))
            ids = [out[0][0], out[1][0], out[0][1], out[1][1]]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(place), *[pa.array(x.view(np.int64)) for x in ids], batch.column("w")], ["c", "pos", "p0", "p1", "q0", "q1", "w"])

    return df.select("c", "x0", "x1", "w", PART).mapInArrow(number, f"c {dict(df.dtypes)['c']}, pos long, p0 long, p1 long, q0 long, q1 long, w long")


PATH = ["c", "depth", "i0", "i1", "q0", "q1", "w", "last"]


def as_paths(rows: DataFrame) -> DataFrame:
    """The paths of conversations as they are: a row for each turn of prefixes(), and one for the root."""
    ends = rows.groupBy("c").agg(F.max("pos").alias("n"))
    own = rows.join(ends, "c").select("c", F.col("pos").alias("depth"), F.col("p0").alias("i0"), F.col("p1").alias("i1"), "q0", "q1", "w", (F.col("pos") == F.col("n")).alias("last"))
    return own.unionByName(root_rows(ends.select("c", F.lit(False).alias("last"))))


def root_rows(ends: DataFrame) -> DataFrame:
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    return ends.select("c", zero.alias("depth"), zero.alias("i0"), zero.alias("i1"), none.alias("q0"), none.alias("q1"), zero.alias("w"), "last")


def rebuilt_paths(rows: DataFrame) -> DataFrame:
    """The paths of rebuilt conversations: c has the first h turns of the first of its block of 20, then its own after its first h; h is
    crc32(c) % 4. Ids of what follows are those of the own prefix, moved to their new places."""
    heads = F.array(*[F.max(F.when(F.col("pos") == k, F.struct("p0", "p1", "w"))) for k in range(1, HEAD + 1)])
    facts = cut(rows.groupBy("c").agg(F.max("pos").alias("n"), heads.alias("own")))
    given = facts.select(F.col("c").alias("b"), F.col("n").alias("n_base"), F.col("own").alias("base"))
    info = facts.withColumns({"h": (F.crc32(F.col("c").cast("string")) % 4).cast("int"), "b": F.col("c") - F.col("c") % BLOCK}).join(given, "b", "left")
    info = info.withColumn("m", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))).cast("int"))
    info = cut(info.withColumns({"total": F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)), "given": F.get("base", F.col("m") - 1), "left_out": F.get("own", F.col("h") - 1)}))
    zero = F.lit(0).cast("long")
    taken = info.select("c", "total", F.posexplode(F.slice(F.coalesce("base", F.array().cast("array<struct<p0:long,p1:long,w:long>>")), 1, F.col("m"))).alias("k", "x"), "base")
    before = F.get("base", F.col("k") - 1)
    taken = taken.select("c", (F.col("k") + 1).cast("long").alias("depth"), F.col("x.p0").alias("i0"), F.col("x.p1").alias("i1"), F.coalesce(before["p0"], zero).alias("q0"), F.coalesce(before["p1"], zero).alias("q1"), F.col("x.w").alias("w"), (F.col("k") + 1 == F.col("total")).alias("last"))
    parts = [F.coalesce(F.col(f"{side}.p{k}"), zero).alias(f"{short}{k}") for side, short in (("given", "g"), ("left_out", "o")) for k in (0, 1)]
    own = rows.join(info.select("c", "h", "m", "total", *parts), "c").where("pos > h")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = (b.column("h").to_numpy(zero_copy_only=False) - b.column("m").to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = []
            for c in ("p", "q"):
                for k in (0, 1):
                    scale = powers(pow(R[k], -1, MOST), HEAD)[by]
                    ids.append(pa.array(((unsigned(b.column(f"{c}{k}")) - unsigned(b.column(f"o{k}"))) * scale + unsigned(b.column(f"g{k}"))).view(np.int64)))
            depth = b.column("pos").to_numpy(zero_copy_only=False) - by
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(depth), *ids, b.column("w"), pa.array(depth == b.column("total").to_numpy(zero_copy_only=False))], PATH)

    kind = dict(rows.dtypes)["c"]
    moved = own.mapInArrow(move, f"c {kind}, depth long, i0 long, i1 long, q0 long, q1 long, w long, last boolean")
    return moved.unionByName(taken).unionByName(root_rows(info.select("c", (F.col("total") == 0).alias("last"))))


NODE = ["depth", "i0", "i1"]


def with_parents(paths: DataFrame) -> DataFrame:
    """The distinct nodes: conv_id, their owner, n_convs, w, parent_conv_id and n_children."""
    nodes = cut(paths.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.min("w").alias("w"), F.min("q0").alias("q0"), F.min("q1").alias("q1")))
    inner = nodes.where("depth > 0")
    kids = inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("q0").alias("i0"), F.col("q1").alias("i1")).agg(F.count("*").alias("n_children"))
    family = cut(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    up = family.select((F.col("depth") + 1).alias("depth"), F.col("i0").alias("q0"), F.col("i1").alias("q1"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = join_counted(family.where("depth > 0"), up.where("n > 0"), ["depth", "q0", "q1"], family.count())
    root = family.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(dict(paths.dtypes)["c"]))
    return cut(below.unionByName(root, allowMissingColumns=True))


def ranked(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """c, rank of each conversation, in the lexicographic order of the chains that its path enters."""
    tops = nodes.where("conv_id <> parent_conv_id")
    shared = tops.where("n_convs > 1").select(*NODE, F.col("conv_id").alias("owner"), F.col("n_convs").alias("n"))
    entered = join_counted(paths.where("depth > 0").select("c", *NODE), shared, NODE, paths.count()).select("c", "depth", "owner")
    entered = entered.unionByName(tops.where("n_convs = 1").select(F.col("conv_id").alias("c"), "depth", F.col("conv_id").alias("owner")))
    # as many entries as chains on a path: k of them need k conversations of 1, 2 ... k turns, so no more than the root of twice all turns
    ways = entered.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("depth", "owner"))).alias("way"))
    first = nodes.where("depth = 0").select(F.col("conv_id").alias("c"), F.lit(True).alias("first"))
    ends = paths.where("last").select("c", F.col("depth").alias("total"))
    rows = ends.join(ways, "c", "left").join(F.broadcast(first), "c", "left")
    way = F.coalesce("way", F.array().cast(dict(ways.dtypes)["way"]))
    own = F.col("first").isNotNull() | F.exists(way, lambda x: x["owner"] == F.col("c"))
    way = F.when(own, way).otherwise(F.concat(way, F.array(F.struct((F.col("total") + 1).alias("depth"), F.col("c").alias("owner")))))
    keyed = rows.select("c", F.transform(way, lambda x: F.struct((-x["depth"]).alias("d"), x["owner"].alias("o"))).alias("key"), F.lit(1).cast("long").alias("one"))
    return running(ordered(keyed, "key", columns=["c", "one"]), rank="one").select("c", (F.col("rank") - 1).alias("rank"))


def hashed_ends(paths: DataFrame) -> DataFrame:
    """depth, i0, i1, ends_sha256 of nodes at which conversations end. SHA-256 goes through a node's ids one after another, so a task streams
    them from its sorted partition and holds none."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            done = []
            for *key, c in zip(*[b.column(k).to_pylist() for k in (*NODE, "c")], strict=True):
                if key != node:
                    done += [(*node, sha.hexdigest())] if node else []
                    node, sha = key, hashlib.sha256(str(c).encode())
                else:
                    sha.update(f",{c}".encode())
            yield out(done)
        yield out([(*node, sha.hexdigest())] if node else [])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=kinds[i]) for i in range(4)], [*NODE, "ends_sha256"])

    ends = paths.where("last").select(*NODE, "c").repartition(n, *NODE).sortWithinPartitions(*NODE, "c")
    return ends.mapInArrow(stream, "depth long, i0 long, i1 long, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """One row a node of the trie of paths: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, first and
    last, its place in preorder and that of the last node below it."""
    paths = cut(paths)
    nodes = with_parents(paths)
    ranks = cut(ranked(paths, nodes))
    sums = {"leaf": (F.col("n_children") == 0).cast("long"), "saves": (F.col("n_convs") - 1) * F.col("w"), "one": F.lit(1).cast("long")}
    placed = nodes.join(ranks.select(F.col("c").alias("conv_id"), "rank"), "conv_id").withColumns(sums)
    kept = ["conv_id", "rank", *NODE, "parent_conv_id", "n_convs", "n_children", *sums]
    placed = cut(running(ordered(placed, "rank", "depth", columns=kept), leaves="leaf", saved="saves", first="one"))
    owned = ranks.select("rank").join(placed.groupBy("rank").agg(*[F.sum(k).alias(k) for k in sums]), "rank", "left").na.fill(0)
    ends = running(ordered(owned, "rank"), leaves_to="leaf", saved_to="saves", last="one").select(F.col("rank").alias("end"), "leaves_to", "saved_to", "last")
    spans = placed.withColumn("end", F.col("rank") + F.col("n_convs") - 1).join(ends, "end").join(hashed_ends(paths), NODE, "left")
    return spans.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_to") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_to") - F.col("saved") + F.col("saves")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), (F.col("first") - 1).alias("first"), (F.col("last") - 1).alias("last"),
    )


def conversation_trie(turns: DataFrame, *, rebuild: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of turns (or of conversations rebuilt as in rebuilt_paths). Turns go by turn_col, null first, then role and text; each row is a
    turn, repeated ones too. Null roles and texts are empty; rows without a conversation belong to none. Texts of any length are hashed
    whole. No conversations give no rows, not even a root; other columns are not read."""
    named = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = cut(prefixes(named))
    return trie(rebuilt_paths(rows) if rebuild else as_paths(rows))


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True).drop("first", "last")


OP12_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(x ORDER BY pos) AS xs FROM t GROUP BY c),
h AS (SELECT c, xs, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ord(substr(c::VARCHAR, i, 1))::BIGINT),
        lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 4 AS h FROM o),
s AS (SELECT h.c, coalesce(b.xs[1:h.h], []) || h.xs[h.h + 1:] AS xs FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
n AS (SELECT xs[1:d] AS p, d AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(xs) = d), '')) AS ends_sha256
      FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM s) GROUP BY ALL),
k AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n_convs - 1) * coalesce(len(regexp_extract_all(n.p[depth].t, '[^\x20\x09-\x0D]+')), 0) AS saves FROM n LEFT JOIN k ON n.p = k.p),
a AS (SELECT p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves) AS saved_tokens FROM (SELECT p, n_children, saves, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY ALL),
u AS (SELECT p, conv_id AS parent_conv_id FROM n),
z AS (SELECT f.conv_id, f.depth::BIGINT AS depth, u.parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
      FROM f JOIN a ON f.p = a.p LEFT JOIN u ON f.depth > 0 AND u.p = f.p[1:f.depth - 1])
SELECT * FROM z
"""

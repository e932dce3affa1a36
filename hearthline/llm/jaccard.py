"""N-gram Jaccard join by chosen paths.

A text is the set of its 5-word shingles (of all its words if it has 1 to 4), and two texts are linked where the sets'
Jaccard similarity is at least 0.8. Texts with equal sets are one class from the start. For the others:

1. Each set becomes T minhash values; two sets share a value with the probability of their similarity.
2. In a run, all sets start in one bucket. A bucket is split by sampled values: given the path so far, a value is chosen
   with probability 1 / (THRESHOLD * T), and a set goes to a child for each chosen value it has, about 1.25 on average.
   The choice is a hash of path and value, so sets agree on it without meeting.
3. After DEPTH levels (one more for each 64-fold of sets) the sets of a bucket are compared pair by pair on 2-bit sketches:
   at once in a bucket of at most SMALL sets; in blocks, of which each pair is a task's group, in larger ones, so that no
   pair of a bucket is left out. Only buckets of more than LARGE sets that are not tight (splits would not part a tight one) are
   split on, in as many sub-runs as keep 0.9 of the pairs, up to SPLITS times; what is still large then goes to blocks too.
4. Runs are independent. A pair at the threshold survives a run with a probability that follows from the levels
   (Poisson branching with mean 1), so the number of runs follows from TARGET, the recall asked for. Each split costs a tenth at
   most: pairs that meet nowhere but in buckets split SPLITS times are found with 0.99 (see recall_after).
5. The sketch-linked sets form candidate components. Inside each, exact Jaccard similarity is computed for all pairs, by
   blocks of rows and columns that are tasks of their own, so that a large component is spread out; no pair of rows is
   written. That gives each set its number of links, and the exact links give the classes.

Defined results: ids are of any type that has an order. A text without words (null, empty, only spaces) is a class of its own
without links, whose class is its id. Rows without id are linked like all others; a class is named by the least id in it, and has no
name where no row of it has an id. Repeated rows count as copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import cut, join_counted, table
from .components import components

N, THRESHOLD, TARGET = 5, 0.8, 0.999
T, DEPTH, SMALL, LARGE, BLOCK, SPLITS = 128, 3, 512, 8192, 512, 3
#: Blocks that a bucket or component has while its blocks grow; from the largest block on, it has more blocks and no larger ones.
EVEN_BLOCKS = 64
#: Sets of a block at most: in a bucket, and in a component, where a task holds the shingles of two blocks and a square of counts.
LARGEST_BUCKET, LARGEST_BLOCK = 2048, 1024
#: Shingles of a block on average at most, 8 bytes each, however long the texts are.
BLOCK_SHINGLES = 2_000_000
#: Share of a bucket's pairs that a split keeps at least.
KEPT = 0.9
#: Mean agreement of two sketches' bits from which a bucket is tight: what a similarity of 0.4 gives.
TIGHT = 0.7
#: Sketches agree in so many of T places at least to make a candidate: what a similarity of 0.65 gives, 0.15 below the threshold and over 3 deviations of a sketch.
LEAST_AGREE = int(T * (0.65 + 0.35 / 4))
#: Bytes that are broadcast at most, as few() counts them; more are joined by a shuffle.
MOST_BROADCAST = 64 << 20

SKETCH = tuple(f"s{k}" for k in range(T // 32))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


_rng = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _rng.integers(1, 2**63, T, dtype=np.uint64) * U(2) + U(1)
PLACES = _rng.integers(1, 2**63, N, dtype=np.uint64) * U(2) + U(1)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return h


_WORDS = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """The set of 64-bit hashes of N-word windows, sorted."""
    words = WORD.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    w = np.array([_WORDS[x] for x in words], dtype=np.uint64)
    n = min(N, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h += w[k : len(w) - n + 1 + k] * PLACES[k]
    return np.unique(mix(h))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray) -> bytes:
    """T minhash values of 16 bits."""
    least = np.full(T, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 2048):
        x = s[k : k + 2048, None] * FACTORS
        np.minimum(least, x.min(axis=0), out=least)
    return (mix(least) & U(0xFFFF)).astype(np.uint16).tobytes()


def survival(levels: int) -> float:
    """The probability that a pair at the threshold is still in some bucket together after so many levels."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return alive


def runs_for(target: float, depth: int) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - survival(depth)))


def recall_after(splits: int, target: float = TARGET, depth: int = DEPTH) -> float:
    """The least recall of a pair at the threshold whose buckets are split so many times in every run."""
    return 1 - (1 - survival(depth) * KEPT**splits) ** runs_for(target, depth)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and h as they are, the key of the text's set and its signature."""
    for batch in batches:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), keys, pa.array([signature(s) if len(s) else None for s in sets], pa.binary())], ["id", "h", "set", "sig"])


def split(sig: np.ndarray, path: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths after so many levels. sig: T values a row; path: the row's path so far."""
    token = mix(sig.astype(np.uint64) + (np.arange(T, dtype=np.uint64) + U(1)) * GOLD)
    rows, chance = np.arange(len(sig)), U(int(2**64 / (THRESHOLD * T)))
    for _ in range(levels):
        out_rows, out_path = [], []
        for k in range(0, len(rows), 8192):
            r, p = rows[k : k + 8192], path[k : k + 8192]
            child = mix((p * GOLD)[:, None] ^ token[r])
            i, j = np.nonzero(child < chance)
            out_rows.append(r[i])
            out_path.append(mix(child[i, j] + U(1)))
        rows, path = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((out_rows, np.int64), (out_path, np.uint64)))
    return rows, path


def sketch(sig: np.ndarray) -> np.ndarray:
    """2 bits of each value, T / 32 numbers a row."""
    bits = (sig & np.uint16(3)).astype(np.uint64).reshape(len(sig), -1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * U(2))).sum(axis=2, dtype=np.uint64)


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint16).reshape(-1, T)


def paths(rows: DataFrame, levels: int, runs: int, go_on: bool = False) -> DataFrame:
    """path, set and sketch, as numbers s0 and on. rows: set and sig. Each run starts a path of its own; if go_on, from each of the row's paths."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sig, sets = _signatures(batch["sig"]), batch["set"].to_numpy()
            if go_on:
                each = batch["paths"].map(len).to_numpy()
                sig, sets = np.repeat(sig, each, axis=0), np.repeat(sets, each)
            small = sketch(sig)
            begin = np.concatenate(batch["paths"].to_list()).astype(np.int64).view(np.uint64) if go_on else np.zeros(len(sig), np.uint64)
            starts = [mix(begin + s) for s in mix(np.arange(1, runs + 1, dtype=np.uint64) * GOLD)]
            got = [split(sig, s, levels) for s in starts]
            at, path = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            for k in range(0, len(at), 20_000):
                i = at[k : k + 20_000]
                yield pd.DataFrame({"path": path[k : k + 20_000].view(np.int64), "set": sets[i]} | {c: small[i, j].view(np.int64) for j, c in enumerate(SKETCH)})

    return rows.mapInPandas(walk, f"path long, set binary, {', '.join(f'{c} long' for c in SKETCH)}")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n rows with links a-b, the first row of each one's component."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def held_together(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The batches, cut so that no run of equal keys is divided; the rows are sorted by keys."""
    left: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if left and (batch[keys].iloc[0] == left[-1][keys].iloc[-1]).all() and (batch[keys].iloc[0] == batch[keys].iloc[-1]).all():
            left.append(batch)
            continue
        new = (batch[keys] != batch[keys].iloc[-1]).any(axis=1).to_numpy()
        at = int(np.nonzero(new)[0][-1]) + 1 if new.any() else 0
        if left and (batch[keys].iloc[0] != left[-1][keys].iloc[-1]).any():
            yield pd.concat(left, ignore_index=True)
            left = []
        if at:
            yield pd.concat([*left, batch.iloc[:at]], ignore_index=True)
            left = []
        left.append(batch.iloc[at:])
    if left:
        yield pd.concat(left, ignore_index=True)


def pairs_of(start: int, count: int, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of a bucket's pairs, in parts; with side, only pairs of rows whose sides differ."""
    if side is None:
        i, j = np.triu_indices(count, 1)
        for k in range(0, len(i), 200_000):
            yield start + i[k : k + 200_000], start + j[k : k + 200_000]
        return
    left, right = start + np.nonzero(side)[0], start + np.nonzero(~side)[0]
    for k in range(0, len(left), max(1, 200_000 // max(1, len(right)))):
        part = left[k : k + max(1, 200_000 // max(1, len(right)))]
        yield np.repeat(part, len(right)), np.tile(right, len(part))


def compare_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between a row and the first of its sketch-linked component in its bucket; rows sorted by path and set.

    side: null in whole buckets; in a pair of blocks, which of the two a row is of, and only pairs across are compared.
    """
    for rows in held_together(batches, ["path"]):
        path = rows["path"].to_numpy()
        start = np.nonzero(np.concatenate([[True], path[1:] != path[:-1]]))[0]
        count = np.diff(np.append(start, len(path)))
        marks = rows[list(SKETCH)].to_numpy(np.int64).view(np.uint64)
        sides = rows["side"].to_numpy()
        a_out, b_out, pending, held = [], [], [], 0

        def flush() -> None:
            i, j = np.concatenate([x[0] for x in pending]), np.concatenate([x[1] for x in pending])  # noqa: B023
            differ = marks[i] ^ marks[j]  # noqa: B023
            differ = np.bitwise_count((differ | (differ >> U(1))) & U(0x5555555555555555)).sum(axis=1, dtype=np.int64)
            good = T - differ >= LEAST_AGREE
            a_out.append(i[good])  # noqa: B023
            b_out.append(j[good])  # noqa: B023

        small = {n: np.triu_indices(n, 1) for n in np.unique(count[(count > 1) & (count <= 64)])}
        for s, n in zip(start[count > 1], count[count > 1], strict=True):
            if n in small and sides[s] < 0:
                parts = [(s + small[n][0], s + small[n][1])]
            else:
                parts = pairs_of(s, n, sides[s : s + n] > 0 if sides[s] >= 0 else None)
            for part in parts:
                pending.append(part)
                held += part[0].size
                if held > 200_000:
                    flush()
                    pending, held = [], 0
        if pending:
            flush()
        if not a_out:
            continue
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        root = _roots(len(rows), a, b)
        member = np.nonzero(root != np.arange(len(rows)))[0]
        sets = rows["set"].to_numpy()
        yield pd.DataFrame({"a": sets[member], "b": sets[root[member]]})


def few(df: DataFrame, *ids: str, row: int = 64) -> DataFrame:
    """df, broadcast if it is small: row bytes a row, and twice what its ids, of any type, take as text. df is cut off."""
    size = df.agg(F.sum(sum((2 * F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ids), F.lit(row)))).first()[0] or 0
    return F.broadcast(df) if size <= MOST_BROADCAST else df


def n_blocks(n, least: int, most: int):
    """How many blocks n sets are dealt into."""
    return F.ceil(n / F.least(F.greatest(F.lit(least), F.ceil(n / EVEN_BLOCKS)), F.lit(most))).cast("int")


def bucket_links(rows: DataFrame) -> DataFrame:
    """a, b of rows (path, set, side and sketch) whose paths have a bounded number of rows each."""
    return rows.repartition("path").sortWithinPartitions("path", "set").mapInPandas(compare_buckets, "a binary, b binary").distinct()


def agreement():
    """How much the sketches of a group agree: the mean over some bits of the share of pairs that have the same bit."""
    bits = [F.shiftrightunsigned(F.col(c), b).bitwiseAND(F.lit(1).cast("long")) for c in SKETCH for b in range(0, 64, 8)]
    return sum((F.avg(x) * F.avg(x) + (1 - F.avg(x)) * (1 - F.avg(x)) for x in bits), F.lit(0.0)) / len(bits)


def block_links(rows: DataFrame) -> DataFrame:
    """a, b of rows (path, n, set and sketch) of large paths: all pairs, in blocks of rows of which each pair is a group of its own."""
    dealt = rows.withColumn("blocks", n_blocks(F.col("n"), BLOCK, LARGEST_BUCKET)).withColumn("own", F.pmod(F.xxhash64("set", "path"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") < F.col("other")).cast("int"))
    return bucket_links(dealt.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "set", *SKETCH, side.alias("side")))


def candidate_links(reps: DataFrame, n: int, target: float = TARGET) -> DataFrame:
    """a, b: links between sets that some run puts in one bucket and whose sketches agree. reps: set, sig."""
    depth = max(DEPTH, math.ceil(math.log(max(n, 2)) / math.log(64)))
    found = None
    at = paths(reps, depth, runs_for(target, depth))
    for k in range(SPLITS + 1):
        many = cut(at.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > SMALL))
        go_on = False
        if many.isEmpty():
            links = bucket_links(at.withColumn("side", F.lit(-1)))
        else:
            large = few(many)
            links = bucket_links(at.join(large, "path", "left_anti").withColumn("side", F.lit(-1)))
            stay = cut(at.join(large, "path"))
            go_on = k < SPLITS and not many.where(F.col("n") > LARGE).isEmpty()
            if go_on:
                loose = cut(stay.where(F.col("n") > LARGE).groupBy("path").agg(agreement().alias("agree")).where(F.col("agree") < TIGHT).select("path"))
                loose = few(loose)
                # a set has no more paths than runs give it: they are gathered, so that its signature is sent once
                own = cut(stay.join(loose, "path", "left_semi").groupBy("set").agg(F.collect_list("path").alias("paths")))
                stay = stay.join(loose, "path", "left_anti")
                at = paths(own.join(reps, "set"), 2, runs_for(KEPT, 2), go_on=True)
            links = links.unionByName(block_links(stay))
        found = links if found is None else found.unionByName(links)
        if not go_on:
            break
    return found.distinct()


def link_counts(sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set, the linked copies, the linked sets, and the first row of its exact component.

    left: where given, rows of one side; only pairs across count.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    values, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = seen[at] > 1  # a shingle of one set only is in no intersection
    row, at = row[shared], at[shared]
    both = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    columns, at = np.unique(at, return_inverse=True)
    for k in range(0, len(columns), 4096):
        lo, hi = np.searchsorted(at, [k, k + 4096])
        m = np.zeros((n, min(4096, len(columns) - k)), dtype=np.float32)
        m[row[lo:hi], at[lo:hi] - k] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = both * 5 >= union * 4
    np.fill_diagonal(linked, False)
    if left is not None:
        linked &= left[:, None] != left[None, :]
    a, b = np.nonzero(np.triu(linked))
    return linked @ copies, linked.sum(axis=1), _roots(n, a, b)


def exact_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each row of a block pair, its links in there and the first row of its component; rows sorted by component and block pair."""
    for rows in held_together(batches, ["cid", "p", "q"]):
        ends = np.append(np.nonzero(np.concatenate([[True], (rows[["cid", "p", "q"]].iloc[1:].to_numpy() != rows[["cid", "p", "q"]].iloc[:-1].to_numpy()).any(axis=1)]))[0], len(rows))
        out = []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            g = rows.iloc[lo:hi]
            sets = [np.frombuffer(bytes(x), np.uint64) for x in g["shingles"]]
            left = (g["block"] == g["p"]).to_numpy() if g["p"].iat[0] != g["q"].iat[0] else None
            links, linked, root = link_counts(sets, g["copies"].to_numpy(np.int64), left)
            keys = g["set"].to_numpy()
            out.append(pd.DataFrame({"set": keys, "links": links, "linked": linked, "root": keys[root]}))
        yield pd.concat(out, ignore_index=True)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingles(t) for t in batch.pop("text")]
        good = [set_key(s) == bytes(k) for s, k in zip(sets, batch["set"], strict=True)]
        yield batch.assign(shingles=[s.tobytes() for s in sets])[good]


def jaccard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: float = TARGET) -> DataFrame:
    """id, h (hash of the text), set, best, n_links and n_set_links of each row.

    best: struct<no,id,h> of the class's first row, those without id (no) last; null for a text without words.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    of = docs.schema[id_col].dataType.simpleString()
    own = cut(texts.mapInArrow(_sets, f"id {of}, h long, set binary, sig binary"))
    row = F.struct(F.col("id").isNull().alias("no"), "id", "h")
    reps = cut(own.where("set is not null").groupBy("set").agg(F.min(row).alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")))
    found = components(candidate_links(reps.select("set", "sig"), reps.count(), target)).select(F.col("node").alias("set"), F.col("root").alias("cid"))
    members = cut(found.join(reps.select("set", "rep", "copies"), "set"))
    n_members = members.count()
    at = texts.join(few(members, "rep.id", row=160), F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("h") == F.col("rep.h"))).select("set", "cid", "copies", "text").mapInPandas(_members, "set binary, cid binary, copies long, shingles binary")
    at = cut(at.groupBy("set").agg(*[F.first(c).alias(c) for c in ("cid", "copies", "shingles")]))  # rows that repeat an id and its text
    # a component of more than BLOCK / 4 sets is dealt into blocks, of which each pair is a task's group
    blocks = F.greatest(n_blocks(F.col("n"), BLOCK // 4, LARGEST_BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int"))
    sizes = at.groupBy("cid").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles") / 8).alias("all")).withColumn("blocks", blocks).drop("all")
    dealt = join_counted(at, sizes, "cid", n_members).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select("cid", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "blocks", "set", "copies", "shingles")
    exact = dealt.repartition("cid", "p", "q").sortWithinPartitions("cid", "p", "q", "set").mapInPandas(exact_links, "set binary, links long, linked long, root binary")
    exact = cut(exact)
    counts = exact.groupBy("set").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    classes = components(exact.where("set <> root").select(F.col("set").alias("a"), F.col("root").alias("b")).distinct())
    named = cut(classes.select(F.col("node").alias("set"), "root").join(reps.select("set", "rep"), "set"))
    named = join_counted(named, named.groupBy("root").agg(F.count("*").alias("n"), F.min("rep").alias("best")), "root", n_members).select("set", "best")
    facts = reps.select("set", "rep", "copies").join(counts, "set", "left").join(named, "set", "left")
    facts = cut(facts.select("set", F.col("copies").alias("n"), F.coalesce("best", "rep").alias("best"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("linked", F.lit(0)).cast("long").alias("n_set_links")))
    rows = own.select("id", "h", "set")
    alone = rows.where("set is null").select("id", "h", "set", F.lit(None).cast(f"struct<no:boolean,id:{of},h:bigint>").alias("best"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_set_links"))
    full = rows.where("set is not null")
    return join_counted(full, facts, "set", full.count()).select(alone.columns).unionByName(alone)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: float = TARGET) -> DataFrame:
    """id, class_id (least id of the class), n_links (other rows at similarity THRESHOLD or more), n_set_links (other sets)."""
    rows = jaccard_rows(docs, id_col, text_col, target)
    return rows.select(F.col("id").alias(id_col), F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("class_id"), "n_links", "n_set_links")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class of linked rows one: that with the least id (rows without id last), then the least hash of its text, then the least row.

    Texts without words stay. Rows leave by id and text, so other rows of the same id stay. Columns are those of docs.
    """
    rows = cut(jaccard_rows(docs, id_col, text_col).where("set is not null").select("id", "h", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))).alias("stays")))
    keys = rows.groupBy("id", "h", "stays").agg(F.count("*").alias("n"))
    here = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h"))
    key = (F.col("id").alias("__id"), F.col("h").alias("__h"))

    kept = docs.join(few(cut(keys.where("not stays").select(*key)), "__id"), here, "left_anti")
    again = few(cut(keys.where("stays and n > 1").select(*key)), "__id")
    if again.isEmpty():
        return kept
    # rows that repeat both id and text: the least of each is found with partial aggregation
    same = kept.join(again, here, "left_semi").withColumn("__h", F.xxhash64(text_col))
    order = F.struct(*[F.to_json(F.struct(c)).alias(c) if isinstance(docs.schema[c].dataType, (MapType, VariantType)) else F.col(c) for c in docs.columns])
    same = same.groupBy(id_col, "__h").agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")
    return kept.join(again, here, "left_anti").unionByName(same)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))

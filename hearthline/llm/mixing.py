"""Mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to); only these totals reach the
driver. A network carries words from patterns to source quotas: a pattern offers its words once per repetition, each
repetition at a higher cost than the one before, so a flow of least cost repeats as little as the quotas allow. Each
pattern's flow is then turned into documents: in the order of a seeded hash they lie one after another on a line as
long as the pattern, the line is walked as often as the flow needs, and the last document reached is taken in part, so
that a quota is met to the word.

Defined results: a null source is a source of its own; a document without source, and one of size null, 0 or less, is
taken 0 times; of repeated rows each counts by itself; an empty table gives an empty result. Columns of the input stay;
those that the operator adds replace input columns of the same name.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict, deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

#: Membership patterns that the driver plans for; they grow with the sources' overlaps, not with the documents. More are refused, never dropped.
MAX_PATTERNS = 1_000_000


@dataclass(frozen=True)
class Plan:
    """sizes and targets by source; flow: words from each pattern for each of its sources."""

    sources: list[str | None]
    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    flow: dict[tuple[str | None, ...], list[tuple[str | None, int]]]


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none above cap times its size; what is above is shared by weight among the rest."""
    targets = [0.0] * len(sizes)
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: (cap * sizes[i] / weights[i], i))
    left, rest = total, sum(weights[i] for i in order)
    for k, i in enumerate(order):
        if left * weights[i] / rest <= cap * sizes[i]:
            for j in order[k:]:
                targets[j] = left * weights[j] / rest
            break
        targets[i] = float(cap * sizes[i])
        left, rest = left - targets[i], rest - weights[i]
    return targets


class Network:
    """Arcs as parallel lists; arc e's reverse is e ^ 1."""

    def __init__(self) -> None:
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def distances(self, start: int, price: list[int]) -> list[float]:
        """Shortest reduced costs from start over arcs with room."""
        far = [float("inf")] * len(self.out)
        far[start] = 0
        queue: list[tuple[float, int]] = [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] > 0 and (n := d + self.cost[e] + price[a] - price[b]) < far[b]:
                    far[b] = n
                    heapq.heappush(queue, (n, b))
        return far

    def fill_shortest(self, start: int, end: int, price: list[int]) -> None:
        """As much flow as arcs of reduced cost 0 can carry, by levels and blocking flows."""
        while True:
            level = [-1] * len(self.out)
            level[start] = 0
            at = deque([start])
            while at:
                a = at.popleft()
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and level[b] < 0 and self.cost[e] + price[a] - price[b] == 0:
                        level[b] = level[a] + 1
                        at.append(b)
            if level[end] < 0:
                return
            tried, path, a = [0] * len(self.out), [], start
            while True:
                if a == end:
                    moved = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= moved
                        self.room[e ^ 1] += moved
                    k = next(i for i, e in enumerate(path) if not self.room[e])
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while tried[a] < len(self.out[a]):
                    e = self.out[a][tried[a]]
                    b = self.to[e]
                    if self.room[e] > 0 and level[b] == level[a] + 1 and self.cost[e] + price[a] - price[b] == 0:
                        break
                    tried[a] += 1
                else:
                    if not path:
                        break
                    a = self.to[path.pop() ^ 1]
                    tried[a] += 1
                    continue
                path.append(self.out[a][tried[a]])
                a = self.to[path[-1]]


def min_cost_flow(supply: dict, demand: dict, arcs: dict, max_repeats: int) -> dict:
    """Words from each supply to each demand over arcs, all demand that can be met, at the least sum of repetition costs.

    The k-th use of a supply's words costs k * k a word. Node prices come from shortest paths; for each length of a shortest path all
    flow of that length is sent at once, so that there are as many rounds as lengths, not as many as supplies.
    """
    net = Network()
    start, end = net.node(), net.node()
    at_demand = {s: net.node() for s in demand}
    used = {}
    for p, size in supply.items():
        own = net.node()
        for k in range(1, max_repeats + 1):
            net.arc(start, own, size, k * k)
        for s in arcs[p]:
            used[p, s] = net.arc(own, at_demand[s], size * max_repeats, 0)
    for s, quota in demand.items():
        net.arc(at_demand[s], end, quota, 0)
    price = [0] * len(net.out)
    while True:
        far = net.distances(start, price)
        if far[end] == float("inf"):
            return {k: net.room[e ^ 1] for k, e in used.items() if net.room[e ^ 1]}
        # nodes beyond the end's distance need no higher price than its own
        price = [p + int(min(f, far[end])) for p, f in zip(price, far, strict=True)]
        net.fill_shortest(start, end, price)


def plan_mix(patterns: dict[tuple, int], weights, budget_ratio: float, max_repeats: int) -> Plan:
    """weights: by source, or a cycle dealt over the sources in code-point order, null last."""
    sizes: dict = defaultdict(int)
    for p, size in patterns.items():
        for s in p:
            sizes[s] += size
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    by = [weights.get(s, 0) for s in sources] if isinstance(weights, dict) else [weights[i % len(weights)] for i in range(len(sources))]
    total = budget_ratio * sum(patterns.values())
    targets = dict(zip(sources, water_fill([sizes[s] for s in sources], by, total, max_repeats), strict=True))
    # patterns that share no source have nothing to do with one another: each such part is a network of its own
    parent = {s: s for s in sources}

    def root(s):
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for p in patterns:
        for s in p[1:]:
            parent[root(s)] = root(p[0])
    parts: dict = defaultdict(list)
    for p in patterns:
        if p:
            parts[root(p[0])].append(p)
    flow: dict = defaultdict(list)
    for own in parts.values():
        quotas = {s: int(targets[s] + 0.5) for p in own for s in p}
        got = min_cost_flow({p: patterns[p] for p in own}, quotas, {p: p for p in own}, max_repeats)
        for (p, s), w in sorted(got.items(), key=lambda x: sources.index(x[0][1])):
            flow[p].append((s, w))
    return Plan(sources, dict(sizes), targets, dict(flow))


def mix_sources(docs: DataFrame, *, id_col: str, size_col: str, members_col: str, weights, budget_ratio: float, max_repeats: int = 2, seed: str = "mix", ties: Sequence[str] = ()) -> DataFrame:
    """docs with `taken` (words that the mix takes, repeats counted) and `drawn` (array of source and words it counts for).

    members_col: array of the document's sources. Sources share budget_ratio times all words by weight, each at most
    max_repeats times its own words. Ties of the seeded order fall back to id, size and the columns in ties, so reruns agree.
    """
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.drop("taken", "drawn").withColumns({"__size": size, "__pattern": F.to_json(F.array_sort(F.array_distinct(F.col(members_col)))), "__key": key}).withColumn("__slot", F.substring("__key", 1, 3))
    slots = rows.where(F.col("__pattern").isNotNull()).groupBy("__pattern", "__slot").agg(F.sum("__size").alias("__in_slot"))
    totals = slots.groupBy("__pattern").agg(F.sum("__in_slot").alias("__all")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; merge sources first")
    names = {r["__pattern"]: tuple(json.loads(r["__pattern"])) for r in totals}
    plan = plan_mix({names[r["__pattern"]]: int(r["__all"]) for r in totals}, weights, budget_ratio, max_repeats)
    lines = [(r["__pattern"], int(r["__all"]), [{"source": s, "words": w} for s, w in plan.flow.get(names[r["__pattern"]], [])]) for r in totals]
    flows = docs.sparkSession.createDataFrame(lines, "__pattern string, __all long, __flow array<struct<source:string,words:long>>")
    # one row for each pattern and slot, at most 4096 a pattern; the order of slots is the order of their documents' keys
    before = Window.partitionBy("__pattern").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.withColumn("__base", F.coalesce(F.sum("__in_slot").over(before), F.lit(0))).drop("__in_slot").join(_small(flows, len(lines)), "__pattern")
    earlier = Window.partitionBy("__pattern", "__slot").orderBy("__key", id_col, "__size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__from", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).join(starts, ["__pattern", "__slot"], "left").withColumn("__from", F.col("__from") + F.col("__base"))
    wanted = F.aggregate("__flow", F.lit(0).cast("long"), lambda a, x: a + x["words"])

    def overlap(lo, hi):
        """Words of [lo, hi) that this document covers on any of the pattern's rounds."""
        covered = F.lit(0).cast("long")
        for k in range(max_repeats):
            a = F.col("__from") + k * F.col("__all")
            covered = covered + F.greatest(F.lit(0).cast("long"), F.least(hi, a + F.col("__size")) - F.greatest(lo, a))
        return covered

    ends = F.aggregate("__flow", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<source:string,lo:long,hi:long>>").alias("out")), lambda a, x: F.struct((a["at"] + x["words"]).alias("at"), F.concat(a["out"], F.array(F.struct(x["source"].alias("source"), a["at"].alias("lo"), (a["at"] + x["words"]).alias("hi")))).alias("out")))["out"]
    taken = F.coalesce(overlap(F.lit(0).cast("long"), wanted), F.lit(0).cast("long"))
    drawn = F.filter(F.transform(ends, lambda e: F.struct(e["source"].alias("source"), overlap(e["lo"], e["hi"]).alias("words"))), lambda e: e["words"] > 0)
    out = placed.withColumns({"taken": taken, "drawn": F.coalesce(drawn, F.array().cast("array<struct<source:string,words:long>>"))})
    return out.drop("__size", "__pattern", "__key", "__slot", "__base", "__from", "__all", "__flow")


def _small(df: DataFrame, n: int) -> DataFrame:
    """n rows of a few dozen bytes for each of a pattern's sources: broadcast up to 10,000, joined like any table beyond."""
    return F.broadcast(df) if n <= 10_000 else df


#: Parameters of the query.
WEIGHTS, BUDGET, REPEATS, SEED = (3, 1, 2), 1.5, 2, "mix"


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))  # texts are read once
    mixed = mix_sources(docs.withColumn("members", F.array("source")), id_col="doc_id", size_col="size", members_col="members", weights=WEIGHTS, budget_ratio=BUDGET, max_repeats=REPEATS, seed=SEED)
    return with_targets(docs, mixed).select("doc_id", "source", "size", "source_size", "target", "taken")


def with_targets(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """mixed with the size and target of each row's source; one row a source is collected, as in mix_sources."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("n")).collect()
    plan = plan_mix({(r["source"],): int(r["n"]) for r in sums}, WEIGHTS, BUDGET, REPEATS)
    side = docs.sparkSession.createDataFrame([(s, plan.sizes[s], plan.targets[s]) for s in plan.sources], "__source string, source_size long, target double")
    return mixed.join(_small(side, len(sums)), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        CASE (row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
      FROM d GROUP BY source),
o AS (SELECT *, sum(2 * source_size) OVER q - 2 * source_size AS capped, sum(w) OVER () - (sum(w) OVER q - w) AS rest,
        1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total, row_number() OVER q AS k
      FROM s WINDOW q AS (ORDER BY 2.0::DOUBLE * source_size / w, (source IS NULL), encode(source) ROWS UNBOUNDED PRECEDING)),
f AS (SELECT min(k) AS k FROM o WHERE (total - capped) * w / rest <= 2.0::DOUBLE * source_size),
l AS (SELECT (o.total - o.capped)::DOUBLE AS lft, o.rest::DOUBLE AS rest, o.k FROM o JOIN f ON o.k = f.k),
t AS (SELECT o.source, o.source_size, CASE WHEN o.k >= l.k THEN l.lft * o.w / l.rest ELSE 2.0::DOUBLE * o.source_size END::DOUBLE AS target FROM o LEFT JOIN l ON true),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  (greatest(0, least(quota, pos + size) - pos) + greatest(0, least(quota, source_size + pos + size) - source_size - pos))::BIGINT AS taken
FROM p
"""

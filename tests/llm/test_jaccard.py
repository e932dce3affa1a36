import os
import random
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hearthline.llm import components, jaccard


def brute(docs):
    """id to (class, links): docs are (id, text); exact similarity of every pair."""
    sets = [jaccard.shingles(t) for _, t in docs]
    full = [set(s.tolist()) for s in sets]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(docs)
    for a, b in combinations(range(len(docs)), 2):
        if full[a] and full[b]:
            k = len(full[a] & full[b])
            if 5 * k >= 4 * (len(full[a]) + len(full[b]) - k):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, least.get(root(i)), links[i]) for i, (d, _) in enumerate(docs)), key=repr)


def brute_kept(docs):
    """Rows (id, text) that stay: of each class the least by id, rows without id last, then by the text's hash, which plain Python lacks."""
    sets = [frozenset(jaccard.shingles(t).tolist()) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        k = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k):
            parent[root(a)] = root(b)
    classes = {}
    for i, s in enumerate(sets):
        if s:
            classes.setdefault(root(i), []).append(docs[i])
    return [d for d, s in zip(docs, sets, strict=True) if not s], list(classes.values())


def corpus(seed, groups, size, words=60):
    rng = random.Random(seed)
    shared = " ".join(f"s{k}" for k in range(40))
    docs = []
    for g in range(groups):
        base = [f"v{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            docs.append((len(docs) * 3, (shared + " " if g % 3 == 0 else "") + " ".join(w)))
    return docs


def run(spark, docs):
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, class_id string")
    out = jaccard.jaccard_classes(df)
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in out.collect()), key=repr)


def test_against_brute_force(spark):
    docs = corpus(1, 40, 8)
    docs += [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "one  two"), (9006, "two one"), (None, docs[0][1]), (9007, "z " * 30_000), (9008, docs[5][1]), (9008, docs[5][1])]
    assert run(spark, docs) == brute(docs)


def test_one_large_group(spark):
    """One group of near copies that fills buckets beyond their limit, and blocks of its own."""
    rng = random.Random(2)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for k in range(420):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            w[rng.randrange(len(w))] = f"n{k}-{rng.randrange(99)}"
        docs.append((k, " ".join(w)))
    assert run(spark, docs) == brute(docs)


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """Loose and tight buckets beyond every limit: a passage that all texts share, and near copies; pairs across blocks and splits count."""
    monkeypatch.setattr(jaccard, "SMALL", 16)
    monkeypatch.setattr(jaccard, "LARGE", 100)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(8)
    shared = " ".join(f"s{k}" for k in range(60))
    docs = []
    for g in range(300):
        base = [f"v{rng.randrange(10**6)}" for _ in range(50)]
        for k in range(2):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            docs.append((len(docs), f"{shared} {' '.join(w)}"))
    tight = [f"b{k}" for k in range(90)]
    for k in range(300):
        w = list(tight)
        w[rng.randrange(len(w))] = f"n{k}"
        docs.append((len(docs), " ".join(w)))
    want, got = brute(docs), run(spark, docs)
    links = sum(n for _, _, n in want)
    assert sum(n for _, _, n in got) >= 0.99 * links and len(got) == len(docs)
    assert all(a[2] >= b[2] for a, b in zip(want, got, strict=True)), "links are exact"
    assert jaccard.recall_after(0) >= 0.999 and jaccard.recall_after(jaccard.SPLITS) >= 0.99


def test_ids_of_any_type_and_repeats(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    near = text + " thirteen"
    docs = [("b", text), ("b", near), (None, text), ("a", "all else is far from what stands in the other rows"), ("c", None), ("c", None), (None, near), (None, "a class without any id at all in its rows"), (None, "a class without any id at all in its rows"), ("b", text)]
    df = spark.createDataFrame([(*d, k % 2) for k, d in enumerate(docs)], "doc_id string, text string, best long")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(df).collect()), key=repr)
    assert got == brute(docs)
    kept = jaccard.one_of_each_class(df)
    assert kept.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    wordless, classes = brute_kept(docs)
    assert sorted((r for r in rows if r[1] is None), key=repr) == wordless
    rows = [r for r in rows if r[1] is not None]
    assert len(rows) == len(classes) and all(sum(r in c for r in rows) == 1 for c in classes)
    assert {r[0] for r in rows} == {min((d for d, _ in c), key=lambda d: (d is None, d or "")) for c in classes}
    assert jaccard.one_of_each_class(df.limit(0)).count() == 0


def test_blocks_stay_bounded(spark, monkeypatch):
    """With low limits a component and a bucket need more than 64 blocks; no task's group is larger than two blocks may be, and the counts stay exact."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "EVEN_BLOCKS", 4)
    monkeypatch.setattr(jaccard, "LARGEST_BUCKET", 16)
    monkeypatch.setattr(jaccard, "LARGEST_BLOCK", 4)
    rng = random.Random(3)
    words = [f"b{k}" for k in range(120)]
    docs = []
    for k in range(300):
        w = list(words)
        w[rng.randrange(len(w))] = f"n{k}"
        docs.append((k, " ".join(w)))
    sizes = jaccard.n_blocks(F.col("n"), 4, 4)
    assert spark.createDataFrame([(300,)], "n long").select(sizes).first()[0] == 75
    seen = group_sizes(monkeypatch)
    assert run(spark, docs) == brute(docs)
    assert 2 < max(seen()) <= 30, "two blocks of 4 on average"


def group_sizes(monkeypatch):
    """How many rows the groups of exact_links have, noted in files by the workers."""
    import tempfile
    from pathlib import Path

    folder = tempfile.mkdtemp()

    def exact_links(batches):
        sizes = {}

        def noted():
            for batch in batches:
                for key, n in batch.groupby(["cid", "p", "q"]).size().items():
                    sizes[key] = sizes.get(key, 0) + n
                yield batch

        yield from EXACT(noted())
        Path(folder, f"{os.getpid()}-{id(sizes)}").write_text("".join(f"{n}\n" for n in sizes.values()))

    monkeypatch.setattr(jaccard, "exact_links", exact_links)
    return lambda: [int(x) for p in Path(folder).iterdir() for x in p.read_text().split()]


EXACT = jaccard.exact_links


def test_recall_at_real_settings(spark):
    """Pairs near the threshold among texts with a passage in common, at the settings of the query: measured, not by formula."""
    rng = random.Random(17)
    shared = " ".join(f"s{k}" for k in range(30))
    docs = []
    for g in range(500):
        base = [f"v{rng.randrange(10**6)}" for _ in range(90)]
        near = list(base)
        near[rng.randrange(10, 80)] = f"n{g}"
        if g % 2:
            near[5] = f"m{g}"
        docs += [(len(docs), f"{shared} {' '.join(base)}"), (len(docs) + 1, f"{shared} {' '.join(near)}")]
    want, got = brute(docs), run(spark, docs)
    links = sum(n for _, _, n in want)
    assert links > 700 and sum(n for _, _, n in got) >= 0.999 * links


def test_rows_with_maps(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", {"a": 1}), (1, "one two three four five six", {"a": 1}), (2, "else", None)], "doc_id long, text string, m map<string,int>")
    assert sorted((r["doc_id"], r["m"]) for r in jaccard.one_of_each_class(docs).collect()) == [(1, {"a": 1}), (2, None)]


def test_empty(spark):
    assert run(spark, [(1, "a b c")])[0] == (1, 1, 0)
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_and_survival():
    assert jaccard.runs_for(0.999, 3) == 15
    rng = np.random.default_rng(0)
    # pairs whose signatures agree in 80 % of places survive a run as often as the formula says, or more
    a = rng.integers(0, 2**16, (3000, jaccard.T)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 2**16, a.shape).astype(np.uint16))
    start = np.full(3000, np.uint64(7))
    ra, pa = jaccard.split(a, start, 3)
    rb, pb = jaccard.split(b, start, 3)
    met = {(r, p) for r, p in zip(ra.tolist(), pa.tolist(), strict=True)} & {(r, p) for r, p in zip(rb.tolist(), pb.tolist(), strict=True)}
    assert len({r for r, _ in met}) / 3000 > 0.33


def test_held_together():
    frames = [pd.DataFrame({"k": k, "v": range(len(k))}) for k in ([1, 1, 2], [2, 2], [2, 3], [], [3], [4])]
    out = list(jaccard.held_together(iter(frames), ["k"]))
    assert [x["k"].tolist() for x in out] == [[1, 1], [2, 2, 2, 2], [3, 3], [4]]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + k, 1001 + k) for k in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    assert got == {x: root(x) for x in parent}
    assert components.components(df.limit(0)).count() == 0

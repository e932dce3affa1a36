import random
import re
from collections import Counter

from hearthline.llm import decontamination as dec

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, items):
    """(id, item) to similarity over all windows of all texts."""
    out = {}
    for d, t in docs:
        w = [x.lower() for x in WORD.findall(t or "")]
        for i, it in items:
            v = [x.lower() for x in WORD.findall(it or "")]
            if not v or not w:
                continue
            n = min(5, len(v))
            if len(w) < n:
                continue
            want = Counter(tuple(v[j : j + n]) for j in range(len(v) - n + 1))
            grams = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
            best = 0.0
            for s in range(max(1, len(w) - len(v) + 1)):
                c = Counter(grams[s : s + len(v) - n + 1])
                best = max(best, sum((c & want).values()) / sum((c | want).values()))
            if best >= 0.8:
                out[d, i] = max(out.get((d, i), 0), round(best, 9))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    items = [(k, text(rng.randrange(12, 60))) for k in range(15)] + [(50, "two words"), (51, None), (52, ""), (53, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for k in range(60):
        words = items[k % 15][1].split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = f"x{k}"
        if k % 5 == 0:
            words.insert(len(words) // 2, "new")
        if k % 7 == 0:
            words = words[:-2]
        docs.append((k, text(rng.randrange(0, 80)) + " " + " ".join(words).upper() + " " + text(rng.randrange(0, 40))))
    docs += [(100, None), (101, ""), (102, "here are two words more"), (103, "w1 " * 3000), (None, items[3][1]), (104, items[4][1]), (104, items[4][1]), (105, text(20_000))]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]): round(r["similarity"], 9) for r in dec.find_leaks(frame, bench).collect()}
    assert got == brute(docs, items)
    lost = {d for d, _ in got}
    kept = dec.without_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in lost)
    assert dec.find_leaks(frame.limit(0), bench).count() == 0
    assert dec.find_leaks(frame, bench.limit(0)).count() == 0 and dec.without_leaks(frame, bench.limit(0)).count() == len(docs)


def test_moved_parts_and_long_items(spark):
    """Halves that changed places, words put in, a text shorter than its item, an item of 700 words, a phrase that all items share."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    a, b, long, phrase = words(25), words(25), words(700), words(8)
    items = [(1, " ".join(a + b)), (2, " ".join(long)), (3, " ".join(words(9))), *((10 + k, " ".join(phrase + words(k) + phrase)) for k in range(12))]
    parts = [b + a, a + ["x"] + b, b, a + b[:-4], long[:300] + ["x", "y"] + long[301:], long[5:690], long[350:] + long[:350], items[2][1].split()[1:], items[2][1].split(), phrase * 6, phrase, items[9][1].split()]
    docs = [(k, " ".join(words(60) + p + words(60))) for k, p in enumerate(parts)] + [(100 + k, " ".join(p)) for k, p in enumerate(parts)] + [(300, " ".join(phrase) + " "), (301, " ".join(phrase * 400))]
    got = {(r["id"], r["item_id"]): round(r["similarity"], 9) for r in dec.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and (0, 1) in want and (6, 2) in want


def test_radius_loses_no_leak(spark):
    """Windows near the threshold, of items of 5 to 60 words: fingerprints of all pairs at 0.8 or more lie within the radius."""
    rng = random.Random(12)
    items, docs = [], []
    for k in range(400):
        w = [f"i{k}-{j}" for j in range(rng.randrange(9, 60))]
        items.append((k, " ".join(w)))
        cut = rng.randrange(0, max(1, len(w) // 9) + 1)
        docs.append((k, " ".join([*w[cut:], *(f"x{j}" for j in range(cut))])))
    got = {(r["id"], r["item_id"]): round(r["similarity"], 9) for r in dec.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 250


def test_pairs_beyond_the_radius_are_found(spark, monkeypatch):
    """Items of 9 words of which a text has 8, and bags of which one shingle makes the most: some differ in more bits than the radius. So do nearly all where
    the radius is 2."""
    rng = random.Random(21)
    items = [(k, " ".join(f"i{k}-{j}" for j in range(9))) for k in range(600)] + [(900, " ".join("ab"[j % 2] for j in range(13))), (901, "a b c d e " * 4)]
    docs = [(k, " ".join(f"i{k}-{j}" for j in range(8))) for k in range(600)] + [(900, " ".join("ba"[j % 2] for j in range(13))), (901, "x " + "a b c d e " * 3 + "a b c"), (902, " ".join(f"i{rng.randrange(600)}-{j}" for j in range(300)))]
    docs += [(1000 + k, f"i{k}-0 x i{k}-1 i{k}-2 i{k}-3 y i{k}-4 i{k}-5 i{k}-6 i{k}-7 z") for k in range(50)]
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    mine = [d for d in docs if d[0] in range(0, 600, 12) or d[0] >= 900]
    want = {(d, i): 0.8 for d in range(600) for i in [d]} | brute([d for d in mine if d[0] >= 900], items[:60] + items[600:])
    for radius in (dec.RADIUS, 2):
        monkeypatch.setattr(dec, "RADIUS", radius)
        monkeypatch.setattr(dec, "BLOCKS", [round(k * dec.BITS / (radius + 1)) for k in range(radius + 2)])
        assert {(r["id"], r["item_id"]): round(r["similarity"], 9) for r in dec.find_leaks(*frames).collect()} == want
    assert (900, 900) in want


def test_blocks_hold_the_guarantee():
    """Two numbers that differ in RADIUS bits agree in a block, wherever the bits are."""
    rng = random.Random(5)
    for _ in range(300):
        bits = set(rng.sample(range(dec.BITS), dec.RADIUS))
        assert any(not bits & set(range(a, b)) for a, b in zip(dec.BLOCKS, dec.BLOCKS[1:], strict=False))
    assert dec.BLOCKS[0] == 0 and dec.BLOCKS[-1] == 64 and len(set(dec.BLOCKS)) == dec.RADIUS + 2


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(x.lower() for x in w[j : j + 5]) for _, t in items for w in [WORD.findall(t)] for j in range(len(w) - 4)}
    near = [(d, t) for d, t in docs if any(tuple(x.lower() for x in w[j : j + 5]) in grams for w in [WORD.findall(t or "")] for j in range(len(w) - 4))]
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in dec.op7_decontamination(spark, sf).collect()}
    assert got == brute(near, items) and got

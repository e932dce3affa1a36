"""Quality classifier and language identification."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hearthline.llm import gam, langid


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    right = ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean()
    assert right > 0.93 and (0, 1) in [(a, b) for a, b, *_ in model.pairs]


def test_gam_scores_are_sums_of_bins():
    x = np.array([[0.0, 1.0], [1.0, 0.0], [0.0, 0.0], [1.0, 1.0]] * 30)
    model = gam.fit(x, (x[:, 0] > 0).astype(float))
    z = model.base + sum(t[np.searchsorted(e, x[0, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    z += sum(t[np.searchsorted(ea, x[0, a], side="right"), np.searchsorted(eb, x[0, b], side="right")] for a, b, ea, eb, t in model.pairs)
    assert model.score(x[:1])[0] == 1 / (1 + math.exp(-z))


def slow_fit(x, y):
    """The model of the module's docstring, row by row: scores of the training rows."""
    share = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    z = [math.log(share / (1 - share))] * len(y)

    def edges(values, bins):
        values = sorted(set(values))
        if len(values) > bins:
            raise ValueError("too many values for this version")
        return [(a + b) / 2 for a, b in zip(values, values[1:])]

    def slopes():
        p = [1 / (1 + math.exp(-v)) for v in z]
        return [(t - q, max(q * (1 - q), 1e-6)) for t, q in zip(y, p)]

    def leaf(rows, s):
        return sum(s[i][0] for i in rows) / (sum(s[i][1] for i in rows) + gam.RIDGE)

    def gain(rows, s):
        return sum(s[i][0] for i in rows) ** 2 / (sum(s[i][1] for i in rows) + gam.RIDGE)

    def tree(spots, n, s):
        parts = [(0, n)]
        inside = lambda a, b: [i for i, k in enumerate(spots) if a <= k < b]
        while len(parts) < gam.LEAVES:
            best = (1e-9, None, None)
            for k, (a, b) in enumerate(parts):
                for c in range(a + 1, b):
                    more = gain(inside(a, c), s) + gain(inside(c, b), s) - gain(inside(a, b), s)
                    if more > best[0] + 1e-12:
                        best = (more, k, c)
            if best[1] is None:
                break
            a, b = parts[best[1]]
            parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
        return {k: leaf(inside(a, b), s) for a, b in parts for k in range(a, b)}

    columns = list(zip(*x))
    cuts = [edges(c, gam.BINS) for c in columns]
    spots = [[sum(v > e for e in cut) for v in c] for c, cut in zip(columns, cuts)]
    for _ in range(gam.ROUNDS):
        for at, cut in zip(spots, cuts):
            values = tree(at, len(cut) + 1, slopes())
            z = [v + gam.RATE * values[k] for v, k in zip(z, at)]
    return [1 / (1 + math.exp(-v)) for v in z]


def test_gam_equals_a_plain_version(monkeypatch):
    """Boosting of the lookup tables, without pairs."""
    monkeypatch.setattr(gam, "ROUNDS", 12)
    monkeypatch.setattr(gam, "PAIRS", 0)
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 7, 80), rng.integers(0, 2, 80), rng.integers(0, 5, 80) / 3]).astype(float)
    y = (x[:, 0] + 2 * x[:, 1] + rng.normal(size=80) > 4).astype(float)
    got = gam.fit(x, y).score(x)
    assert np.allclose(got, slow_fit(x.tolist(), y.tolist()), atol=1e-9)


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA", "#", "12"], rng.integers(3, 40))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("#" in t)) for k, t in enumerate(texts)], "doc_id long, quality int")
    scores = [{r["doc_id"]: r["score"] for r in gam.classify(d, gam.learn(d, labels)).collect()} for d in (docs, docs.repartition(5))]
    assert scores[0] == scores[1]


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    out = gam.op8_quality_classifier(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum((r["quality"] > 0) == (r["predicted"] == 1) for r in rows) / len(rows) > 0.95
    assert out.where("score is null or score < 0 or score > 1").count() == 0


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "word " * 30_000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    out = gam.classify(docs, gam.learn(docs, labels))
    assert out.count() == 4 and out.where("score between 0 and 1").count() == 4
    assert gam.classify(docs.limit(0), gam.learn(docs, labels.limit(0))).count() == 0
    assert {r["score"] for r in gam.classify(docs, gam.learn(docs, labels.limit(0))).collect()} == {gam.PRIOR}


def test_repeated_ids_give_one_training_row(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 30 + [(2, 0)], "doc_id long, quality int")
    model = gam.learn(docs, labels)
    assert model.base == 0.0, "one row of each label"
    assert gam.learn(docs, labels, rows=1).base != 0.0


def slow_bits(texts, text):
    """Code length of escape method C, a byte at a time."""
    out = []
    for lang in sorted(texts):
        counts = [Counter() for _ in range(langid.ORDER + 1)]
        for t in texts[lang]:
            s = b" " * langid.ORDER + t.encode()
            for i in range(langid.ORDER, len(s)):
                for k in range(langid.ORDER + 1):
                    counts[k][s[i - k : i + 1]] += 1
        s, total = b" " * langid.ORDER + text.encode(), 0.0
        for i in range(langid.ORDER, len(s)):
            for k in range(langid.ORDER, -1, -1):
                ctx = s[i - k : i]
                after = {g[-1]: n for g, n in counts[k].items() if g[:-1] == ctx}
                n, d = sum(after.values()), len(after)
                if s[i] in after:
                    total += math.log2((n + d) / after[s[i]])
                    break
                if n:
                    total += math.log2((n + d) / d)
            else:
                total += math.log2(256)
        out.append(total)
    return out


def test_code_lengths_are_exact(monkeypatch):
    texts = {"en": ["the cat and the hat", "that is it"], "de": ["der hut und die katze", "das ist es ß"], "uk": ["це не той кіт", "і не та шапка"], "ja": ["猫と帽子"]}
    asked = ["the hut ist ñ!", "це кіт", "", "ß", "猫 the 帽子 cat", "\x00\xff~"]
    model = langid.fit(texts)
    for chunk in (7, 1 << 20):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        fast, sizes = langid.code_lengths(asked, model)
        assert np.allclose(fast, [slow_bits(texts, t) for t in asked], rtol=1e-5) and sizes.tolist() == [len(t.encode()) for t in asked]


def test_lookup():
    rng = np.random.default_rng(3)
    numbers = np.unique(rng.integers(0, 2**32, 5000).astype(np.uint64))
    table = langid.Lookup(numbers)
    assert (table.find(numbers) == np.arange(len(numbers))).all()
    other = np.setdiff1d(rng.integers(0, 2**32, 5000).astype(np.uint64), numbers)
    assert (table.find(other) == -1).all()


def test_languages_of_one_script_are_told_apart(spark):
    """Cyrillic and ideographic texts: bytes that are rare over all texts tell these languages apart."""
    own = {"ru": "это не тот кот который был в шляпе ы э ъ", "uk": "це не той кіт який був у капелюсі і ї є ґ", "bg": "това не е котката която беше с шапка щ ъ", "ja": "これは帽子をかぶった猫ではない", "zh": "这不是戴帽子的那只猫"}
    docs = spark.createDataFrame([(lang, f"{own[lang]} {i % 7} {own[lang][i % 9:]}") for lang in own for i in range(40)], "lang string, text string")
    model = langid.learn(docs, "text", "lang")
    assert [langid.score_texts([own[s][3:]], model)[0][0] for s in own] == list(own)
    for lang in ("ru", "zh"):
        assert len(langid.sample_texts(docs.where(F.col("lang") == lang), "text", "lang")[lang]) == docs.where(F.col("lang") == lang).distinct().count(), "few texts give all"
    assert len(langid.sample_texts(docs, "text", "lang", 10)["ru"]) == 10


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    out = langid.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    rows = out.where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert {r["held_out"] for r in out.collect()} == {True, False}


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "der " * 40_000, "x"), (4, "the", "x"), (None, "die katze", None)], "doc_id long, text string, score string")
    model = langid.fit({"en": ["the cat"], "de": ["der hut die katze"]})
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"] > 0) for r in langid.identify(docs, model).collect())
    assert got == [(0, "de", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "de", True), (4, "en", True)]
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit({})).collect()} == {"und"}
    assert langid.sample_texts(docs.withColumn("lang", F.lit(None).cast("string")), "text", "lang") == {}


def test_language_learns_whole_texts(spark):
    """Long documents that open with the same head: what tells their languages apart comes after it."""
    head = "license terms apply to all of this. " * 300
    own = {"de": "der hut und die katze sind nicht hier ", "en": "the cat and the hat are not over there "}
    docs = spark.createDataFrame([(lang, head + own[lang] * (20 + i)) for lang in own for i in range(30)], "lang string, text string")
    model = langid.learn(docs, "text", "lang")
    fitted = langid.fit(langid.sample_texts(docs, "text", "lang"))
    assert model.langs == fitted.langs and model.key == fitted.key
    assert all(sum(n) == sum(len(t) for t in docs.where(F.col("lang") == s).toPandas()["text"]) for s, (_, n) in zip(model.langs, model.counts, strict=True))
    assert [langid.score_texts([own[s]], model)[0] for s in ("de", "en")] == [["de"], ["en"]]
    assert langid.learn(docs.limit(0), "text", "lang").langs == []


def test_number_signs_are_no_letters():
    model = langid.model_of({"de": langid.string_counts("ein kleiner Text"), "en": langid.string_counts("a little text")})
    texts = ["½ ② ²", "Ⅷ ⅷ ¾", "12 _ -", "", None, "² a", "日本", "ª"]
    langs, scores = langid.score_texts(texts, model)
    assert [x == "und" for x in langs] == [True, True, True, True, True, False, False, False]
    assert all(s == 0.0 for s, x in zip(scores, langs, strict=True) if x == "und")

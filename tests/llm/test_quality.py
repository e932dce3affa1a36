import re
from collections import Counter

from pyspark.sql import functions as F

from hearthline.llm import quality
from tests.rows import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "  \n\t ", "one", "a b c d e " * 6, "a b c d e f g h i j k l", "x y\nx y\n\n\nz\nx y\n \n ", "é ü ñ # $$$ | <>", "a b c d e x a b c d e y a b c d e", " ".join(f"w{i}" for i in range(20_000)), "w " * 9_000, "ONE TWO THREE " * 8]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_stats(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    rows = quality.with_stats(docs).collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows] == [brute(r["text"]) for r in rows]


def test_cascade_order_changes_no_verdict(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rules = quality.default_rules(F.col("text"))
    ordered = quality.order_rules(quality.sample_of(docs, ["text"]), rules)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in rules)
    a, b = ({r["doc_id"] for r in docs.where(quality.cascade(x).isNull()).collect()} for x in (ordered, rules[::-1]))
    assert a == b == {r["doc_id"] for r in quality.quality_filter(docs).collect()} == {9}
    assert quality.quality_filter(docs.limit(0)).count() == 0


def test_rules_are_ordered_by_rejection_for_cost(spark):
    docs = quality.sample_of(spark.createDataFrame([(i, "word " * 3) for i in range(50)], "doc_id long, text string"), ["text"])
    never, cheap, dear = (quality.Rule(n, c) for n, c in (("never", F.lit(False)), ("cheap", F.length("text") < 50), ("dear", F.length("text") < 60)))
    assert [r.name for r in quality.order_rules(docs, [never, dear, cheap], [1.0, 5.0, 1.0])] == ["cheap", "never", "dear"]
    assert [r.name for r in quality.order_rules(docs, [never, dear, cheap], [1.0, 0.5, 1.0])][0] == "dear"


def test_costs_are_measured(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(3000))) for i in range(60)], "doc_id long, text string")
    rules = {r.name: r for r in quality.default_rules(F.col("text"))}
    few, repeats = quality.measured_costs(quality.sample_of(docs, ["text"]), [rules["few_words"], rules["repeats"]])
    assert 0 < few < repeats


def test_query(spark, sf, duck):
    same(quality.op6_quality_rules(spark, sf), duck, quality.OP6_SQL)

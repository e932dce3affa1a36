"""Personal data by bootstrapped contextual extraction.

Fixed patterns give seed entities. A pattern of the bootstrap is the lexical context of a place: the two words before it, the word
before it, or the word after it, with the coarse class of what stands there (has an `@`, has letters, has neither). An instance is a
text that looks like an identifier, and its form is its characters by class. Spark builds the graph of patterns and instances by
counting, and scores it in rounds. A pattern is as good as the instances it stands by: the weighted share of believed identifiers
among its occurrences, where an unknown one weighs less the better the patterns are that its form stands in; so a format that no fixed
pattern has, but that is met where identifiers are, is no evidence against those places. An instance is as good as its patterns
above the thresholds (one minus the product of their doubts), and a believed one counts for all its other patterns in the next round,
those without a seed too. Patterns of the last round above the thresholds then mark places in every text that no fixed pattern found.

The places that can become entities are those with a digit or an `@` that no fixed pattern covers: tokens, and runs of tokens of digits,
dots, hyphens and brackets with one space between them. A row of more than RUN_DIGITS digits is no identifier but a row of numbers, and
gives its tokens. So the graph grows with identifiers and not with words. Texts are read twice: once to count, once to mark.

Defined results: null texts are empty; repeated rows are scanned alike and each occurrence counts as evidence; an empty
table gives an empty result; other columns stay as they are, those added replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, table
from .decontamination import bounded

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. Each possible start is tried once, so that long runs of digits or letters cost no more than their length.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: A token with a digit or @. It is tried where a token starts and gives nothing back, so a long one costs no more than its length.
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^0-9@\x20\x09-\x0D]*+[0-9@][^\x20\x09-\x0D]*+")
NUMERIC = re.compile(r"[+(]*[0-9][0-9().-]*")
#: The most digits of a known kind, a card number.
RUN_DIGITS = 19

#: Parameters: rounds of scoring, least score of a pattern, prior doubt in it. An identifier that occurs n times weighs log(1 + n); a pattern needs more
#: evidence than doubt, however large the table is.
ROUNDS, LEAST_SCORE, PRIOR = 3, 0.6, 3.0
#: What the identifiers by a pattern must weigh for any score above LEAST_SCORE: w / (w + PRIOR).
LEAST_WEIGHT = LEAST_SCORE * PRIOR / (1 - LEAST_SCORE)
#: How often in a round the scores of patterns and the doubt in forms are counted from each other.
PASSES = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if not DIGITS.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m.group())) <= 15]
    return sorted(out)


def shape(token: str) -> str:
    """The token's characters by class, each class once in a row, so that identifiers of one format agree; long ones by their hash."""
    form = re.sub(r"(?s)(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token))
    return form if len(form) <= 32 else hashlib.blake2b(form.encode("utf-8", "replace"), digest_size=8).hexdigest()


def before(text: str, at: int) -> list[str]:
    """The two words before a place, nearest first; words of more than 40 characters by their end."""
    return [w.strip(",.;:\"'()[]").lower()[-40:] for w in text[max(0, at - 120) : at].split()[::-1][:2]]


def coarse(token: str) -> str:
    return "@" if "@" in token else "a" if any(c.isalpha() for c in token) else "9"


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns that what is at this place stands in; the first character tells their side."""
    form = coarse(text[start:end])
    left = before(text, start)
    right = text[end : end + 60].split(None, 1)[:1]
    out = []
    if left:
        out.append(f"1 {left[0]} _ {form}")
    if len(left) > 1:
        out.append(f"2 {left[1]} {left[0]} _ {form}")
    if right:
        out.append(f"3 _ {right[0].strip(',.;:').lower()[:40]} {form}")
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The place without the punctuation around it; a bracket that opens stays where it is closed inside."""
    while b > a and not text[b - 1].isalnum():
        b -= 1
    close = text.rfind(")", a, b)
    while a < b and not (text[a].isalnum() or text[a] in "@+_" or (text[a] == "(" and a < close)):
        a += 1
    return a, b


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or @ and runs of numeric tokens, of 5 characters or with an @, that touch no base span."""
    if "@" not in text and not DIGITS.search(text):
        return
    run: list[tuple[int, int]] = []
    k = 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][2] <= a:
            k += 1
        ta, tb = trimmed(text, a, b)
        if any(x[0] < tb and ta < x[2] for x in base[k : k + 8]):
            yield from _places_of_run(text, run)
            run = []
            continue
        # the next group of the same number: one space and no punctuation between, and a bracket opens only after a short prefix
        joins = run and a == run[-1][1] + 1 and text[a - 1] == " " and text[a - 2] not in ".-"
        joins = joins and (text[a] != "(" or (len(run) == 1 and a - 1 - run[0][0] <= 4)) and text[a] != "+"
        m = NUMERIC.match(text, a, b)
        if not (joins and m and m.end() >= tb):
            yield from _places_of_run(text, run)
            run = []
        run.append((a, b))
        m = NUMERIC.match(text, ta, b)
        if not (m and m.end() == b):
            yield from _places_of_run(text, run)
            run = []
    yield from _places_of_run(text, run)


def _places_of_run(text: str, run: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    if len(run) > 1 and len(DIGITS.findall(text, run[0][0], run[-1][1])) <= RUN_DIGITS:
        run = [(run[0][0], run[-1][1])]
    for a, b in run:
        a, b = trimmed(text, a, b)
        if b - a >= 5 or (b > a and "@" in text[a:b]):
            yield a, b


def _graph_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """pattern, form, instance (its hash), kind (-1: not a known identifier) for every seed and candidate."""
    for batch in batches:
        rows = []
        for text in batch["text"]:
            if not text:
                continue
            base = base_spans(text)
            known = [(a, b, kind) for a, kind, b in base]
            for a, b, kind in known + [(a, b, -1) for a, b in candidates(text, base)]:
                h = int.from_bytes(hashlib.blake2b(text[a:b].encode(), digest_size=8).digest(), "big", signed=True)
                form = shape(text[a:b])
                rows += [(p, form, h, kind) for p in contexts(text, a, b)]
        yield pd.DataFrame(rows, columns=["pattern", "form", "instance", "kind"])


def _scores(belief: DataFrame, forms: DataFrame | None) -> DataFrame:
    """Of each pattern score and the occurrences of believed instances by kind (n0, n1, ...)."""
    rows = belief.withColumn("near", F.lit(0.0)) if forms is None else belief.join(bounded(forms, forms.count()), "form", "left")
    weight, doubt = F.log1p("n"), F.greatest(F.col("p"), 1 - F.coalesce("near", F.lit(0.0)))
    of = [F.sum(F.when((F.col("p") > 0) & (F.col("kind") == i), F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(KINDS))]
    score = F.sum(weight * F.col("p")) / (F.sum(weight * doubt) + PRIOR)
    return rows.groupBy("pattern").agg(score.alias("score"), *of)


def learn_patterns(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind and score of every pattern above the thresholds.

    Edges are counted before anything else, so a pattern or identifier that makes up a third of all places is one row a
    partition when it is shuffled.
    """
    raw = docs.select("text").mapInPandas(_graph_rows, "pattern string, form string, instance long, kind int")
    edges = cut(raw.groupBy("pattern", "form", "instance", "kind").agg(F.count("*").alias("n")))
    side = F.substring("pattern", 1, 1).alias("side")
    met = cut(edges.where("kind < 0").groupBy(side, "form").agg(F.sum("n").alias("met")))
    # a pattern whose instances, all believed, would not weigh enough passes in no round
    live = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.log1p("n")).alias("weight")).where(F.col("weight") >= LEAST_WEIGHT).select("pattern", "n")
    live = cut(live)
    edges = cut(join_counted(edges, live.select("pattern", F.col("n").alias("rows")), "pattern", edges.count(), "rows"))
    total = edges.count()
    belief = edges.withColumn("p", (F.col("kind") >= 0).cast("double"))
    good, before = None, None
    with_counts = lambda facts: facts.join(live.select("pattern", F.col("n").alias("rows")), "pattern")
    for k in range(rounds):
        forms = None
        for _ in range(PASSES):
            # by form, the mean score of the patterns that its unknown instances stand in, on the side where that is most
            scores = _scores(belief, forms).where("score > 0").select("pattern", "score")
            near = join_counted(belief.where("p = 0"), with_counts(scores), "pattern", total, "rows").groupBy(side, "form").agg(F.sum(F.col("n") * F.col("score")).alias("near"))
            forms = cut(near.join(met, ["side", "form"]).groupBy("form").agg(F.max(F.col("near") / F.col("met")).alias("near")))
        scores = _scores(belief, forms)
        good = scores.where(F.col("score") >= LEAST_SCORE)
        most = F.array_max(F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("i")) for i in range(len(KINDS))]))
        good = cut(good.select("pattern", (-most["i"]).cast("int").alias("kind"), "score"))
        now = tuple(good.agg(F.count("*"), F.bit_xor(F.xxhash64("pattern", "kind"))).first())
        if now == before:
            break  # the same patterns as a round ago: another one would find no more
        before = now
        if k + 1 < rounds:
            trust = 1 - F.exp(F.sum(F.log(F.lit(1.0) - F.least(F.col("score"), F.lit(0.99)))))
            found = join_counted(edges.where("kind < 0").drop("kind"), with_counts(good), "pattern", total, "rows").groupBy("instance").agg(trust.alias("trust"), F.max_by("kind", F.struct("score", "kind")).alias("as"))
            kind, p = F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("as", F.lit(-1))), F.when(F.col("kind") >= 0, 1.0).otherwise(F.coalesce(F.col("trust") * 0.9, F.lit(0.0)))
            belief = cut(edges.join(found, "instance", "left").select("pattern", "form", "instance", kind.alias("kind"), "n", p.alias("p")))
    return good


def _places(texts: pd.Series) -> pd.DataFrame:
    """Each text's base spans, and its candidates with their patterns."""
    base_out, found = [], []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        base_out.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
        found.append([{"start": a, "end": b, "patterns": contexts(text, a, b)} for a, b in candidates(text, base)])
    return pd.DataFrame({"base": base_out, "found": found})


def scan_pii(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """docs without text, with `base` and `spans`: arrays of struct<start,kind,end> in order; spans has the discovered ones too.

    Patterns are joined to the few rows that have candidates, exploded, and never collected; patterns that stand by much of all places are
    broadcast, so their places stay where they lie.
    """
    patterns = learn_patterns(docs) if patterns is None else patterns
    span = "struct<start:int,kind:int,end:int>"
    places_of = F.pandas_udf(_places, f"base array<{span}>, found array<struct<start:int,end:int,patterns:array<string>>>")
    own = docs.drop("base", "found", "spans")
    placed = own.withColumn("__p", places_of("text")).select(*[c for c in own.columns if c != "text"], "__p.*")
    places = cut(placed.withColumn("__row", F.monotonically_increasing_id()))
    asked = places.select("__row", F.explode("found").alias("f")).select("__row", "f.start", "f.end", F.explode("f.patterns").alias("pattern"))
    asked = cut(asked)
    counts = asked.groupBy("pattern").agg(F.count("*").alias("n"))
    hits = join_counted(asked, patterns.join(counts, "pattern"), "pattern", asked.count()).groupBy("__row", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    hits = hits.groupBy("__row").agg(F.collect_list(F.struct("start", F.col("kind").cast("int").alias("kind"), "end")).alias("__more"))
    spans = F.array_sort(F.concat("base", F.coalesce("__more", F.array().cast(f"array<{span}>"))))
    return places.join(hits, "__row", "left").withColumn("spans", spans).drop("__row", "__more", "found")


def as_string(spans):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = scan_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(as_string(F.col("base")), 256).alias("base_sha256"), as_string(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_found"))


def _is(k: int):
    return lambda s: s["kind"] == k

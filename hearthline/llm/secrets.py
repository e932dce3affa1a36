"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window entropy over long tokens.

Places come from marking: a pattern's matches are wrapped in a character that the text doesn't have, the text is split
there, and running lengths of the pieces are the code-point places of the matches. Pieces are dealt into parts of PART, places are
counted within each part and the parts' lengths are added up, so that many matches don't copy one growing list.

Entropy: a candidate is a long run of a class's characters that isn't on the allow-list. A window slides over it while
an array of counts, one for each character of the class, is kept up: one count goes up, one goes down, and the sum of
c * log2(c) moves by the difference, so each step costs the same. Windows at or above the class's threshold give a span
from the first one's start to the last one's end. What a pattern's span covers of it is cut out, the rest stays.

Defined results: null texts are empty and have no spans; repeated rows are scanned alike; an empty table gives an empty
result; columns of the input stay, those added replace input columns of the same name. No pattern repeats a group, so long texts and
tokens cost no stack.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

#: Fixed patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")



@dataclass(frozen=True)
class Allowed:
    """What is no secret: a token in which all of has and none of lacks is found."""

    has: tuple[str, ...]
    lacks: tuple[str, ...] = ()


ALLOW = (
    Allowed((r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",)),
    Allowed((r"(?i)example|placeholder|changeme|dummy|lorem|x{6}",)),
    # words of letters, joined by single dashes, underscores or slashes
    Allowed(("^[A-Za-z]", "[-_/]", "[A-Za-z]$"), ("[^A-Za-z_/-]", "[-_/]{2}")),
)


@dataclass(frozen=True)
class CharClass:
    """alphabet: the class's characters, all ASCII; needs: patterns that a candidate must have besides; bits: least entropy of a window."""

    name: str
    alphabet: str
    pattern: str
    window: int
    bits: float
    needs: tuple[str, ...] = ()


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = (
    CharClass("hex", DIGITS + "ABCDEF", r"(?<![0-9A-F])[0-9A-F]{20,}", 20, 3.0, ("[A-F]", "[0-9]")),
    CharClass("lower", LOWER + DIGITS, r"(?<![a-z0-9])[a-z0-9]{20,}", 20, 3.6, ("[g-z]", "[0-9]")),
    CharClass("upper", UPPER + DIGITS, r"(?<![A-Z0-9])[A-Z0-9]{20,}", 20, 3.6, ("[G-Z]", "[0-9]")),
    CharClass("base64", UPPER + LOWER + DIGITS + "+/_=-", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 20, 3.9, ("[A-Z]", "[a-z]", "[0-9]")),
)
#: What every class's candidates lie in; a text without one has none. It is tried once a run of these characters.
ANY_CLASS = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"
PART = 256
SPAN = "struct<start:bigint,end:bigint,kind:int,hit:string>"
MARK, OTHER = "\x01", "\x02"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def parts_of(xs: Column) -> Column:
    """xs dealt into arrays of PART, in order."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(PART)), lambda i: F.slice(xs, i + 1, PART))


def furthest(ends: Column) -> Column:
    """The greatest of the ends so far, at each place: within parts first, then over the parts before."""
    grow = lambda a, v: F.concat(a, F.array(F.greatest(F.element_at(a, -1), v)))
    zero = F.array(F.lit(0).cast("bigint"))

    def whole(parts: Column) -> Column:
        before = F.aggregate(parts, zero, lambda a, p: grow(a, F.array_max(p)))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, i: F.transform(F.aggregate(p, F.slice(zero, 1, 0), lambda a, v: F.concat(a, F.array(F.greatest(F.coalesce(F.try_element_at(a, F.lit(-1)), v), v)))), lambda v: F.greatest(v, F.get(b, i))))))

    return let(parts_of(ends), whole)


def find(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Leftmost non-overlapping matches, array of SPAN; keep: of a match, whether it counts. text isn't null."""
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), f"(?:{pattern})", f"{MARK}$0{MARK}"), MARK, -1)
    zero = F.lit(0).cast("bigint")

    def walk(part: Column) -> Column:
        """The length of a part and its spans, counted from its start."""

        def step(a: Column, x: Column) -> Column:
            to = (a["at"] + F.length(x["text"])).cast("bigint")
            span = F.struct(a["at"].alias("start"), to.alias("end"), F.lit(kind).alias("kind"), x["text"].alias("hit"))
            good = x["odd"] if keep is None else x["odd"] & keep(x["text"])
            return F.struct(to.alias("at"), F.when(good, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        return F.aggregate(part, F.struct(zero.alias("at"), no_spans().alias("out")), step)

    def whole(walked: Column) -> Column:
        before = F.aggregate(walked, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["at"])))
        moved = lambda s, by: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"))
        return let(before, lambda b: F.flatten(F.transform(walked, lambda x, i: F.transform(x["out"], lambda s: moved(s, F.get(b, i))))))

    numbered = F.transform(pieces, lambda s, i: F.struct(s.alias("text"), (i % 2 == 1).alias("odd")))
    return F.when(text.rlike(pattern), let(let(numbered, lambda p: F.transform(parts_of(p), walk)), whole)).otherwise(no_spans())


def base_spans(text: Column) -> Column:
    return F.concat(
        find(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
        find(text, ACCESS, 1, lambda m: F.length(m) >= 18),
        find(text, HEX, 2),
    )


#: Counts are kept 12 in a number, 5 bits each, so a window has 31 characters at most.
LANES, LANE_BITS = 12, 5


def loud_part(token: Column, c: CharClass) -> Column:
    """struct<lo,hi>: from the first loud window's start to the last one's end in token; hi 0 where no window is loud."""
    w = c.window
    gain = F.array(*[F.lit(float(k * math.log2(k)) if k else 0.0) for k in range(w + 2)])
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    state = F.struct(F.array_repeat(zero, -(-len(c.alphabet) // LANES)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    place = F.transform(F.split(token, ""), lambda x: F.call_function("locate", x, F.lit(c.alphabet)) - 1)
    lanes = F.transform(place, lambda p: F.struct((p / LANES).cast("int").alias("word"), (p % LANES * LANE_BITS).alias("shift"), F.call_function("shiftleft", one, p % LANES * LANE_BITS).alias("one"), p.alias("p")))

    def walk(chars: Column) -> Column:
        def step(a: Column, at: Column) -> Column:
            """The window that ends with character i: one count up, and once the window is full one down."""
            i, new, old = at["i"], at["new"], at["old"]
            count = lambda x: F.call_function("shiftrightunsigned", F.get(a["counts"], x["word"]), x["shift"]).bitwiseAND(F.lit(31).cast("bigint")).cast("int")

            def result(m: Column) -> Column:
                counts = F.when(m["same"], a["counts"]).otherwise(F.transform(a["counts"], lambda n, j: n + F.when(j == new["word"], new["one"]).otherwise(zero) - F.when(j == old["word"], old["one"]).otherwise(zero)))
                loud = (i >= w - 1) & (F.lit(math.log2(w)) - m["sum"] / w >= c.bits)
                return F.struct(counts.alias("counts"), m["sum"].alias("sum"), F.when(loud & (a["hi"] == 0), i - (w - 1)).otherwise(a["lo"]).alias("lo"), F.when(loud, i + 1).otherwise(a["hi"]).alias("hi"))

            same = F.coalesce(new["p"] == old["p"], F.lit(False))
            up, down = let(count(new), lambda n: F.get(gain, n + 1) - F.get(gain, n)), F.when(old.isNotNull(), let(count(old), lambda n: F.get(gain, n - 1) - F.get(gain, n))).otherwise(F.lit(0.0))
            return let(F.struct(same.alias("same"), F.when(same, a["sum"]).otherwise(a["sum"] + up + down).alias("sum")), result)

        steps = F.transform(chars, lambda x, i: F.struct(i.alias("i"), x.alias("new"), F.get(chars, i - w).alias("old")))
        return F.aggregate(steps, state, step, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))

    return let(lanes, walk)


def entropy_spans(text: Column, classes=CLASSES, allow=ALLOW, any_class: str = ANY_CLASS) -> Column:
    """Loud spans of each class, kind 3. any_class: what a text must have to be looked at."""
    return F.when(text.rlike(any_class), F.concat(*[_loud(text, c, allow) for c in classes])).otherwise(no_spans())


def _loud(text: Column, c: CharClass, allow) -> Column:
    def keep(m: Column) -> Column:
        good = F.lit(True)
        for p in c.needs:
            good = good & m.rlike(p)
        for rule in allow:
            allowed = F.lit(True)
            for p in rule.has:
                allowed = allowed & m.rlike(p)
            for p in rule.lacks:
                allowed = allowed & ~m.rlike(p)
            good = good & ~allowed
        return good

    def part(s: Column) -> Column:
        hit = lambda x: F.when(x["hi"] > 0, F.substring(s["hit"], x["lo"] + 1, x["hi"] - x["lo"]))
        return let(loud_part(s["hit"], c), lambda x: F.struct((s["start"] + x["lo"]).cast("bigint").alias("start"), (s["start"] + x["hi"]).cast("bigint").alias("end"), F.lit(3).alias("kind"), hit(x).alias("hit")))

    return F.filter(F.transform(find(text, c.pattern, 3, keep), part), lambda s: s["hit"].isNotNull())


def scan_secrets(docs: DataFrame, text_col: str = "text", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """docs with `base` and `spans`, arrays of SPAN by start and kind; spans has the loud ones too."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def joined(b: Column) -> Column:
        loud = let(let(entropy_spans(text, classes, allow), distinct_loud), lambda x: F.when(F.size(x) > 0, beyond(x, b)).otherwise(x))
        return F.struct(b.alias("base"), F.array_sort(F.concat(b, loud)).alias("spans"))

    own = docs.drop("base", "spans")
    return own.withColumn("__found", let(F.array_sort(base_spans(text)), joined)).select(*own.columns, "__found.*")


def distinct_loud(loud: Column) -> Column:
    """One of spans that overlap: the one that starts first, then the longest; a span is left out where any before it reaches beyond its start.

    loud is used more than once, so it should be a column or a bound value.
    """
    order = F.array_sort(F.transform(loud, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s.alias("span"))))

    def first(xs: Column) -> Column:
        ends = furthest(F.transform(xs, lambda x: x["span"]["end"]))
        return let(ends, lambda far: F.transform(F.filter(xs, lambda x, i: F.coalesce(F.get(far, i - 1), F.lit(0)) <= x["start"]), lambda x: x["span"]))

    return F.when(F.size(loud) > 1, let(order, first)).otherwise(loud)


def beyond(loud: Column, base: Column) -> Column:
    """The parts of loud spans that no span of base covers, in order. base by start. Base spans are looked up by part, then in the parts met."""
    inside = lambda s: lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])
    part = F.transform(parts_of(base), lambda p: F.struct(p[0]["start"].alias("start"), F.array_max(F.transform(p, lambda x: x["end"])).alias("end"), p.alias("spans")))

    def rest(s: Column, met: Column) -> Column:
        gap = lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.lit(3).alias("kind"), F.substring(s["hit"], (a - s["start"] + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).alias("hit"))
        starts, ends = F.concat(F.array(s["start"]), furthest(F.transform(met, lambda x: x["end"]))), F.concat(F.transform(met, lambda x: x["start"]), F.array(s["end"]))
        return F.filter(F.zip_with(starts, ends, gap), lambda g: g["end"] > g["start"])

    def each(parts: Column) -> Column:
        def one(s: Column) -> Column:
            met = F.filter(F.flatten(F.transform(F.filter(parts, inside(s)), lambda p: p["spans"])), inside(s))
            return let(met, lambda m: F.when(F.size(m) > 0, rest(s, m)).otherwise(F.array(s)))

        return F.flatten(F.transform(loud, one))

    return F.when(F.size(base) > 0, let(part, each)).otherwise(loud)


def as_string(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """text with each span, or chain of overlapping spans, replaced. spans by start.

    Parts of PART spans each take their stretch of the text first, so that a place is looked up in a stretch and not in the whole text.
    """
    zero = F.lit(0).cast("bigint")

    def gaps(xs: Column) -> Column:
        """Of each span, where the text before it starts, and where it ends: at the span, or at once where an earlier one covers it."""
        far = furthest(F.transform(xs, lambda s: s["end"]))
        return let(far, lambda f: F.transform(xs, lambda s, i: let(F.coalesce(F.get(f, i - 1), zero), lambda a: F.struct(a.alias("from"), F.greatest(a, s["start"]).alias("to"), (s["start"] >= a).alias("new")))))

    def stretch(part: Column) -> Column:
        lo, hi = part[0]["from"], F.element_at(part, -1)["to"]

        def pieces(t: Column) -> Column:
            cut = lambda g: F.substring(t, (g["from"] - lo + 1).cast("int"), (g["to"] - g["from"]).cast("int"))
            return F.array_join(F.transform(part, lambda g: F.when(g["new"], F.concat(cut(g), F.lit(by))).otherwise(F.lit(""))), "")

        return let(F.substring(text, (lo + 1).cast("int"), (hi - lo).cast("int")), pieces)

    rest = F.substring(text, (F.array_max(F.transform(spans, lambda s: s["end"])) + 1).cast("int"), F.length(text))
    done = F.concat(F.array_join(let(gaps(spans), lambda g: F.transform(parts_of(g), stretch)), ""), rest)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_string(F.col("base")), 256).alias("base_sha256"), as_string(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_entropy"))

"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of 0 to ORDER bytes is counted on sample texts and then frozen. The code length
of a byte is that of escape method C without exclusions: in a context seen n times with d different followers, a
follower seen c times costs log2((n + d) / c) bits; any other costs log2((n + d) / d) bits for the escape, and then what
the next shorter context asks; below order 0 all bytes are alike. A context never seen costs no escape. A text's
language is the one that codes all its bytes in the fewest bits.

All 256 byte values count. Strings of ORDER + 1 bytes that any language has seen are one table, with the code length of its last byte in every
language, worked out once a worker from the counts; a text's strings are looked up in it by hash, all of a batch at once in
numpy, and only those that no language has seen go on to shorter contexts.

Bounds: at most DOCS_PER_LANG documents of a language, by the order of a hash, are learned from, each one whole. Executors
count contexts, and the driver gets the counts: a row for each string of ORDER + 1 bytes that the sample has in a language. That, and so
the model, grows with the number of languages and with how many such strings a language has, not with the documents.
Scoring reads whole texts.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text when there is nothing
to learn from; ties go to the language first in code-point order; repeated rows are scored alike; an empty table gives
an empty result; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table
from .decontamination import bounded

ORDER, BYTES = 3, 256
DOCS_PER_LANG = 600
#: What may be a letter; of these, number signs such as ½, ② or Ⅷ are none.
LETTER = re.compile(r"[^\W\d_]")
#: The share of a text's code-length lead, in bits a byte, that makes the score; 1 / (1 + 2 ** -(EVIDENCE * lead)).
EVIDENCE = 16.0
#: Places that are scored at once.
CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def last_bytes(k: int) -> np.uint64:
    """What keeps the last k bytes of a string's number."""
    return np.uint64((1 << (8 * k)) - 1)


class Lookup:
    """Places of numbers in a sorted array, by open addressing in a table that is at most a quarter full."""

    def __init__(self, numbers: np.ndarray):
        self.bits = max(4, int(len(numbers) * 4).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        slot, left = self.first(numbers), np.arange(len(numbers))
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several that want a slot the last has it
            self.keys[slot[free]] = numbers[left[free]]
            wait = self.at[slot] != left
            slot, left = (slot[wait] + 1) % len(self.at), left[wait]

    def first(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that aren't there."""
        slot = self.first(numbers)
        found = self.at[slot]
        look = np.nonzero((found >= 0) & (self.keys[slot] != numbers))[0]
        while len(look):
            slot[look] = (slot[look] + 1) % len(self.at)
            found[look] = self.at[slot[look]]
            look = look[(found[look] >= 0) & (self.keys[slot[look]] != numbers[look])]
        return found


class Model:
    """langs: in code-point order; counts: of each, the numbers of its strings of ORDER + 1 bytes and how often each is met."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.counts = langs, counts
        self.key = hash((tuple(langs), *(c.tobytes() + n.tobytes() for c, n in counts)))

    def tables(self) -> list[tuple[Lookup, np.ndarray, Lookup, np.ndarray]]:
        """For contexts of 0 to ORDER bytes: strings seen by any language with the last byte's bits in each, and contexts with the escape's bits."""
        out = []
        for k in range(ORDER + 1):
            strings = np.unique(np.concatenate([c & last_bytes(k + 1) for c, _ in self.counts]))
            contexts, of = np.unique(strings >> np.uint64(8), return_inverse=True)
            bits, escapes = np.empty((len(strings), len(self.langs)), np.float32), np.empty((len(contexts), len(self.langs)), np.float32)
            for j, (codes, numbers) in enumerate(self.counts):
                seen = np.bincount(np.searchsorted(strings, codes & last_bytes(k + 1)), numbers, len(strings))
                n, d = np.bincount(of, seen, len(contexts)), np.bincount(of, seen > 0, len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(n > 0, np.log2((n + d) / d), 0)
                    shorter = out[-1][1][out[-1][0].find(strings & last_bytes(k)), j] if k else np.log2(BYTES)
                    bits[:, j] = np.where(seen > 0, np.log2((n + d)[of] / seen), escape[of] + shorter)
                escapes[:, j] = escape
            out.append((Lookup(strings), bits, Lookup(contexts), escapes))
        return out


_TABLES: dict[int, list] = {}


def tables_of(model: Model) -> list:
    if model.key not in _TABLES:
        _TABLES.clear()
        _TABLES[model.key] = model.tables()
    return _TABLES[model.key]


def strings_of(raw: bytes) -> np.ndarray:
    """At each byte after the first ORDER the number that it makes with the ORDER bytes before it."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(b) - ORDER
    out = b[:n].copy()
    for k in range(1, ORDER + 1):
        out = (out << np.uint64(8)) | b[k : k + n]
    return out


def place_bits(codes: np.ndarray, tables: list) -> np.ndarray:
    """Bits of each place in every language."""
    out, left = None, np.arange(len(codes))
    for k in range(ORDER, -1, -1):
        strings, bits, contexts, escapes = tables[k]
        at = strings.find(codes[left] & last_bytes(k + 1))
        if out is None:
            out = bits[at]
            out[at < 0] = 0
        else:
            out[left[at >= 0]] += bits[at[at >= 0]]
        left = left[at < 0]
        if not len(left):
            return out
        ctx = contexts.find((codes[left] & last_bytes(k + 1)) >> np.uint64(8))
        out[left[ctx >= 0]] += escapes[ctx[ctx >= 0]]
    out[left] += np.float32(np.log2(BYTES))
    return out


def code_lengths(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, its bits in every language, and its bytes."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    pad = b" " * ORDER
    codes = strings_of(pad + pad.join(raw))
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    total = np.zeros((len(texts), len(model.langs)))
    tables = tables_of(model)
    for lo in range(0, len(codes), CHUNK):
        hi = min(lo + CHUNK, len(codes))
        bits = place_bits(codes[lo:hi], tables)
        own = np.nonzero((starts < hi) & (starts + sizes > lo) & (sizes > 0))[0]
        if len(own):
            # a text's places, then those that belong to the next one's spaces
            edges = np.stack([np.maximum(starts[own], lo) - lo, np.minimum(starts[own] + sizes[own], hi) - lo], axis=1).ravel()
            edges = edges[:-1] if edges[-1] == hi - lo else edges
            total[own] += np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[::2]
    return total, sizes


def string_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ORDER + 1 bytes of a text, with spaces before it, and how often each is met."""
    return np.unique(strings_of(b" " * ORDER + text.encode("utf-8", "replace")), return_counts=True)


def model_of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: by language, strings, which may repeat, and their numbers."""
    langs = sorted(counts, key=str.encode)
    merged = []
    for s in langs:
        codes, at = np.unique(counts[s][0].astype(np.uint64), return_inverse=True)
        merged.append((codes, np.bincount(at, counts[s][1]).astype(np.int64)))
    return Model(langs, merged)


def fit(texts: dict[str, list[str]]) -> Model:
    """The model of whole texts by language, for texts that are at hand."""
    found = {s: [string_counts(t) for t in texts[s]] for s in texts}
    return model_of({s: (np.concatenate([c for c, _ in one]), np.concatenate([n for _, n in one])) for s, one in found.items()})


def sample_rows(docs: DataFrame, text_col: str, lang_col: str, per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """lang, t: of each language the first per_lang distinct texts by a hash; a language with no more gives all.

    An estimate of each language's distinct texts gives a threshold that about twice as many pass, so that only their hashes, and then only the
    chosen texts, are moved; of the copies of a text a partition gives one.
    """
    text = F.col(text_col)
    kept = docs.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text)) > 0))
    rows = kept.select(F.col(lang_col).alias("lang"), F.xxhash64(text).alias("h"), text.alias("t")).withColumn("at", F.pmod("h", F.lit(1 << 30)))
    sizes = cut(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).select("lang", (F.least(F.lit(1.0), 2.0 * per_lang / F.col("n")) * (1 << 30)).alias("most")))
    near = rows.join(bounded(sizes, 2 * sizes.count()), "lang").where(F.col("at") < F.col("most")).select("lang", "at", "h").distinct()
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("at", "h"))).where(F.col("k") <= per_lang).select("lang", "h")
    first = cut(first)
    return rows.join(bounded(first, 2 * first.count()), ["lang", "h"]).groupBy("lang", "h").agg(F.min("t").alias("t")).select("lang", "t")


def sample_texts(docs: DataFrame, text_col: str, lang_col: str, per_lang: int = DOCS_PER_LANG) -> dict[str, list[str]]:
    """The rows of the sample on the driver, for texts that fit there; learn() does not collect them."""
    out: dict[str, list[str]] = {}
    for r in sample_rows(docs, text_col, lang_col, per_lang).collect():
        out.setdefault(r["lang"], []).append(r["t"])
    return out


def learn(docs: DataFrame, text_col: str, lang_col: str, per_lang: int = DOCS_PER_LANG) -> Model:
    """The model of the sample's whole texts, counted where they lie."""

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, t in zip(b["lang"], b["t"], strict=True):
                codes, n = string_counts(t)
                yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})

    counts = sample_rows(docs, text_col, lang_col, per_lang).mapInPandas(met, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return model_of({lang: (one["code"].to_numpy(), one["n"].to_numpy()) for lang, one in counts.groupby("lang")})


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Of each text, its language and score."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    good = [i for i, t in enumerate(texts) if t and model.langs and has_letter(t)]
    if good:
        total, sizes = code_lengths([texts[i] for i in good], model)
        bits = total / sizes[:, None]
        best = bits.argmin(axis=1)
        rest = np.where(np.arange(len(model.langs)) == best[:, None], np.inf, bits).min(axis=1)
        lead = np.where(np.isfinite(rest), rest - bits[np.arange(len(good)), best], 1.0)
        for i, k, v in zip(good, best.tolist(), (1 / (1 + np.exp2(-EVIDENCE * lead))).tolist(), strict=True):
            langs[i], scores[i] = model.langs[k], v
    return langs, scores


def parts_of(texts: list[str | None]) -> Iterator[list[str | None]]:
    """texts in parts of about CHUNK characters, so that what is held at once is bounded by that and the longest text."""
    part: list[str | None] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held > CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score. The model goes to workers as one broadcast of bounded size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [score_texts(part, sent.value) for part in parts_of(list(texts))]
            yield pd.DataFrame({"lang_pred": [x for langs, _ in got for x in langs], "score": [x for _, scores in got for x in scores]})

    # hints in this module are strings, so the kind of the function is told by annotations that Spark can read
    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    scored = F.pandas_udf(score, "lang_pred string, score double")
    own = docs.drop("lang_pred", "score")
    return own.withColumn("__s", scored(text_col)).select(*[c for c in own.columns if c != text_col], "__s.*")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = learn(docs.where(F.coalesce(~held_out, F.lit(True))), "text", "lang")
    return identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)

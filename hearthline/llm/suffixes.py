"""Repeats of LENGTH bytes or more over a whole corpus, found in batches by a logarithmic family of suffix indexes.

A suffix array of every byte would be many times the corpus. It is sampled: of each window of LENGTH bytes the place whose GRAM bytes
have the least hash is its anchor, so equal windows have anchors at equal places, and about one byte in 32 is one. An entry is the suffix at
an anchor: g, a hash of the bytes it starts with, by which arrays are bucketed and sorted, where the windows of this anchor start (a, n of them), and s, a
hash of all bytes that they cover. Windows can be equal only where entries share g.

A new batch of documents gets an array, which is merge-scanned against each level of the family and itself: entries with g and s of an
earlier one are repeats as a whole; of others that share g the bytes are fetched and their windows compared one by one. What is
new becomes a level, and levels of similar size are merged, so there are about log2 of the number of batches.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, join_counted, table

LENGTH, GRAM = 100, 32
#: Bytes that are worked through at once: about 100 times as many are used meanwhile. Longer texts are cut where windows start.
CHUNK = 1 << 19
#: Entries of one g that are compared in one task; more are compared by a shuffle of their windows.
MOST_OF_GRAM = 8192
#: Stands for a null id.
LAST = 2**63 - 1
#: The batches that a table is read in: so many at least, and no more bytes than this each.
BATCHES, BATCH_BYTES = 4, 4 << 40
#: Two families of hashes, each of 64 bits: odd multipliers, otherwise arbitrary, and a value for each byte.
MIX = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
VALUES = [np.random.default_rng(k).integers(0, 2**64, 256, dtype=np.uint64) for k in (1, 2)]
ENTRY = "g long, s long, doc long, th long, a int, n int"
COLUMNS = ["g", "s", "doc", "th", "a", "n"]
SPAN = ["doc", "th", "a", "n"]


def mix(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    t = a * np.uint64(MIX[k][0])
    t += b
    t ^= t >> np.uint64(29)
    t *= np.uint64(MIX[k][1])
    return t


def window_hashes(data: np.ndarray, k: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM bytes and of the length bytes at each place, by doubling; 64 <= length <= 128."""
    h, m, grams = VALUES[k][data], 1, None
    while m < 64:
        h, m = mix(h[:-m], h[m:], k), 2 * m
        grams = h if m == GRAM else grams
    return grams, mix(h[: len(h) - (length - 64)], h[length - 64 :], k)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values."""
    m = 1
    while 2 * m <= width:
        values, m = np.minimum(values[:-m], values[m:]), 2 * m
    return np.minimum(values[: len(values) - (width - m)], values[width - m :]) if m < width else values


def pieces(texts: Iterator[bytes], chunk: int, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text's number, where it starts there, bytes) of about chunk bytes in all; each window lies in one."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, chunk):
            part = text[at : at + chunk + length - 1]
            group.append((i, at, part))
            size += len(part)
            if size >= chunk:
                yield group
                group, size = [], 0
    if group:
        yield group


def entries_of(group: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """g, s, number of the text, a, n of the entries of some pieces."""
    data = np.frombuffer(b"".join(p for _, _, p in group), dtype=np.uint8)
    sizes = np.array([len(p) for _, _, p in group])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    grams, windows = window_hashes(data, 0, length)
    low = np.uint64((1 << 22) - 1)  # the place; what is above decides, and the first of equal ones
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (least_of(packed, length - GRAM + 1) & low).astype(np.int64)
    of = anchor
    for end in ends[:-1]:  # windows that would cross into the next piece are none
        of[max(0, end - length + 1) : end] = -1
    first = np.flatnonzero(np.diff(of, prepend=-2))
    n = np.diff(np.append(first, len(of)))
    n, first = n[of[first] >= 0], first[of[first] >= 0]
    piece = np.searchsorted(ends, first, side="right")
    s = mix(mix(windows[first], windows[first + n - 1], 1), (n * 1024 + anchor[first] - first).astype(np.uint64), 1)
    which, at = np.array([i for i, _, _ in group]), np.array([a for _, a, _ in group])
    return grams[anchor[first]], s, which[piece], (first - starts[piece] + at[piece]).astype(np.int32), n.astype(np.int32)


def spread(doc: np.ndarray, a: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64), a.astype(np.uint64), 1)


def index_entries(docs: DataFrame, *, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """The entries of docs (doc, th, text as binary). gone: one whose g and s an earlier one of the same chunk has; it is a repeat and no entry, and its g
    is replaced so that copies by the thousand don't meet in a bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("doc", "th"))
            placed = np.lexsort((th, doc))
            doc, th = doc[placed], th[placed]
            for group in pieces((batch.column("text")[int(k)].as_py() or b"" for k in placed), chunk, length):
                g, s, i, a, n = entries_of(group, length)
                order = np.lexsort((s, g))  # stable: of equal entries the earlier comes first
                g, s, i, a, n = (x[order] for x in (g, s, i, a, n))
                d, t = doc[i], th[i]
                head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])) if len(g) else np.zeros(0, dtype=np.int64)
                of = np.repeat(head, np.diff(np.append(head, len(g))))
                gone = (d != d[of]) | (t != t[of]) | (a != a[of])
                g = np.where(gone, spread(d, a), g)
                columns = [g.view(np.int64), s.view(np.int64), d, t, a, n, gone]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [*COLUMNS, "gone"])

    return docs.select("doc", "th", "text").mapInArrow(work, f"{ENTRY}, gone boolean")


def compared(rows: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows of own pieces that an earlier piece has. rows: pieces by g; groups of equal g are compared together."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            whole = pa.Table.from_batches(held).combine_chunks()
            g = whole.column("g").to_numpy()
            end = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if end:
                yield repeated(whole.slice(0, end), length)
                held = whole.slice(end).to_batches()
    if held:
        yield repeated(pa.Table.from_batches(held), length)


def flat_windows(part: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """For each window of the pieces: two hashes, its piece's number and its place there."""
    data = [x.as_py() for x in part.column("bytes")]
    n = part.column("n").to_numpy()
    starts = np.concatenate([[0], np.cumsum([len(x) for x in data])[:-1]])
    joined = np.frombuffer(b"".join(data), dtype=np.uint8)
    piece = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    w = [window_hashes(joined, k, length)[1][starts[piece] + place] for k in (0, 1)]
    return w[0], w[1], piece, place


def repeated(part: pa.Table, length: int) -> pa.RecordBatch:
    if part.num_rows:
        doc, th, a = (part.column(k).to_numpy() for k in ("doc", "th", "a"))
        part = part.take(pa.array(np.lexsort((a, th, doc))))
        doc, th, a, mine = (part.column(k).to_numpy() for k in ("doc", "th", "a", "mine"))
        w0, w1, piece, place = flat_windows(part, length)
        order = np.lexsort((w1, w0))  # stable: equal windows stay in the order of where they start
        w0, w1 = w0[order], w1[order]
        head = np.flatnonzero(np.concatenate([[True], (w0[1:] != w0[:-1]) | (w1[1:] != w1[:-1])]))
        first = order[np.repeat(head, np.diff(np.append(head, len(order))))]
        at = a[piece] + place
        p, f = piece[order], piece[first]
        later = mine[p] & ((doc[p] != doc[f]) | (th[p] != th[f]) | (at[order] != at[first]))
        found = np.sort(order[later])
        start = np.flatnonzero(np.concatenate([[True], (np.diff(found) > 1) | (np.diff(piece[found]) > 0)])) if len(found) else np.zeros(0, dtype=np.int64)
        n = np.diff(np.append(start, len(found)))
        found = found[start]
        out = [doc[piece[found]], th[piece[found]], at[found].astype(np.int32), n.astype(np.int32)]
    else:
        out = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], SPAN)


def hot_windows(found: DataFrame, length: int) -> DataFrame:
    """As compared(), for entries whose g is very frequent: their windows are grouped by two hashes, in each task before they are shuffled."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            part = pa.Table.from_batches([batch])
            w0, w1, piece, place = flat_windows(part, length)
            doc, th, a, mine = (part.column(k).to_numpy() for k in ("doc", "th", "a", "mine"))
            columns = [w0.view(np.int64), w1.view(np.int64), doc[piece], th[piece], (a[piece] + place).astype(np.int32), mine[piece]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["w0", "w1", "doc", "th", "a", "mine"])

    rows = found.mapInArrow(windows, "w0 long, w1 long, doc long, th long, a int, mine boolean")
    start = F.struct("doc", "th", "a")
    facts = rows.groupBy("w0", "w1").agg(F.min(start).alias("first"), F.count("*").alias("n"), F.max("mine").alias("mine")).where("n > 1 and mine").drop("mine")
    return join_counted(rows.where("mine").drop("mine"), facts, ["w0", "w1"], max(1, found.count() * 32)).where(start > F.col("first")).select("doc", "th", "a", F.lit(1).alias("n"))


#: What lets tables that are bucketed and sorted by g meet without a shuffle or a sort, also where they are joined by g and s.
MERGE_SCANS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while; afterwards they are as they were."""
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class SuffixFamily:
    """Levels of entries, the oldest first, each one or more sorted runs: tables that are bucketed and sorted by g; and the documents that they point
    into, tables bucketed by doc.

    add() takes a batch of documents (doc, th, text) that come after all of earlier batches and gives the runs of windows, a and n of (doc, th), that start
    earlier too. A batch shuffles its texts once and its entries once; what the levels hold is read and not shuffled. Tables lie in the
    warehouse, what a batch needs besides in the checkpoint folder; close() removes both.
    """

    def __init__(self, spark: SparkSession, *, length: int = LENGTH, chunk: int = CHUNK, most_of_gram: int = MOST_OF_GRAM) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.length, self.chunk, self.most = spark, length, chunk, most_of_gram
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"suffixes_{uuid.uuid4().hex}"
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{self.name}"
        self.levels: list[tuple[list[str], int]] = []  # each level's runs, and how many entries it has
        self.texts: list[str] = []
        self.tables: set[str] = set()
        self.made = 0

    def table(self, rows: DataFrame, key: str = "g", dealt: bool = False, name: str | None = None, parts: Sequence[str] = ()) -> str:
        """rows as a table bucketed and sorted by key, or appended to one; dealt: they are in their buckets already. parts: columns whose values are read apart."""
        if name is None:
            self.made += 1
            name = f"{self.name}_{self.made}"
            self.tables.add(name)
        (rows if dealt else rows.repartition(self.buckets, key)).write.mode("append").partitionBy(*parts).bucketBy(self.buckets, key).sortBy(key).saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        """The entries of a run; of a batch's table those that share g with no other when it came."""
        rows = self.spark.table(name)
        return (rows.where("not shared") if "shared" in rows.columns else rows).select(*COLUMNS)

    def store(self, rows: DataFrame) -> DataFrame:
        self.made += 1
        rows.write.parquet(f"{self.folder}/{self.made}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{self.made}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.tables.discard(name)

    def merge(self) -> None:
        """Merges the last levels while one is at least half as large as the one before it."""
        while len(self.levels) > 1 and 2 * self.levels[-1][1] >= self.levels[-2][1]:
            (one, n), (two, m) = self.levels[-2:]
            every = reduce(DataFrame.unionByName, [self.run(name) for name in [*one, *two]])
            self.levels[-2:] = [([self.table(every)], n + m)]
            self.drop(*one, *two)

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The batch's documents, as they are read again, and its runs."""
        with configured(self.spark, MERGE_SCANS):
            return self.added(docs)

    def added(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        self.merge()
        self.texts.append(self.table(docs.select("doc", "th", F.col("text").cast("binary").alias("text")), "doc"))
        texts = self.spark.table(self.texts[-1])
        name = self.table(index_entries(texts, length=self.length, chunk=self.chunk), parts=["gone"])
        every = self.spark.table(name)
        own = every.where("not gone").select(*COLUMNS)
        near = self.table(self.spark.createDataFrame([], ENTRY))
        for run in (r for runs, _ in self.levels for r in runs):  # the merge scan: both sides are bucketed and sorted by g
            self.table(self.run(run).join(own.select("g"), "g", "left_semi"), dealt=True, name=near)
        met = self.spark.table(near)
        of_near = met.groupBy("g").agg(F.count("*").alias("n_near"))
        several = (F.count("*").over(Window.partitionBy("g")) > 1).alias("several")  # in the order of the table, without a shuffle or a sort
        marked = own.select("*", several).join(of_near, "g", "left").select(*COLUMNS, (F.col("several") | F.col("n_near").isNotNull()).alias("shared"))
        batch = self.table(marked, dealt=True, parts=["shared"])
        likely = self.spark.table(batch).where("shared").select(*COLUMNS)
        firsts = likely.groupBy("g", "s").agg(F.min(F.struct("doc", "th", "a", "n")).alias("first"))
        hits = met.groupBy("g", "s").agg(F.lit(True).alias("hit"))
        facts = self.table(firsts.join(hits, ["g", "s"], "left"), dealt=True)
        known = self.spark.table(facts)
        later = F.struct("doc", "th", "a") > F.struct("first.doc", "first.th", "first.a")
        whole = likely.join(known, ["g", "s"]).where(F.col("hit") | later).select(*SPAN)
        new = known.where("hit is null").select("g", "s", "first.doc", "first.th", "first.a", "first.n")
        runs = [batch, self.table(new, dealt=True)]
        found = self.store(every.where("gone").select(*SPAN).unionByName(whole).unionByName(self.in_part(new, met, of_near)))
        self.levels.append((runs, sum(self.run(r).count() for r in runs)))
        self.drop(name, near, facts)
        return texts, found

    def in_part(self, new: DataFrame, near: DataFrame, of_near: DataFrame) -> DataFrame:
        """Runs of windows of new entries that others which share g, but not all bytes, have too."""
        counts = new.groupBy("g").agg(F.count("*").alias("n_new")).join(of_near, "g", "left").select("g", (F.col("n_new") + F.coalesce("n_near", F.lit(0))).alias("of_g"))
        mixed = self.table(counts.where("of_g > 1"), dealt=True)
        kinds = self.spark.table(mixed)
        asked = [rows.join(kinds.select("g"), "g", "left_semi").withColumn("mine", F.lit(mine)) for rows, mine in ((new, True), (near, False))]
        by_doc = asked[0].unionByName(asked[1]).groupBy("doc", "th").agg(F.collect_list(F.struct("g", "a", "n", "mine")).alias("at"))
        wanted = self.table(by_doc, "doc")
        found = reduce(DataFrame.unionByName, [with_bytes(self.spark.table(wanted), self.spark.table(t), self.length) for t in self.texts])
        length, most = self.length, self.most
        hot = kinds.where(F.col("of_g") > most).select("g")  # of each more than so many entries, so it is 1/most of them at most
        none = hot.isEmpty()
        found = found if none else self.store(found)
        few = (found if none else found.join(hot, "g", "left_anti")).repartition(self.buckets, "g").sortWithinPartitions("g")
        spans = few.mapInArrow(lambda rows: compared(rows, length, most), "doc long, th long, a int, n int")
        spans = self.store(spans if none else spans.unionByName(hot_windows(found.join(hot, "g", "left_semi"), length)))
        self.drop(mixed, wanted)
        return spans

    def close(self) -> None:
        self.drop(*list(self.tables))
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def with_bytes(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """g, doc, th, a, n, mine and the bytes of entries, which wanted lists by document; both sides are bucketed by doc."""
    piece = F.transform("at", lambda x: F.struct(x["g"].alias("g"), x["a"].alias("a"), x["n"].alias("n"), x["mine"].alias("mine"), F.substring(F.col("text"), x["a"] + 1, x["n"] + (length - 1)).alias("bytes")))
    return texts.join(wanted, ["doc", "th"]).select("doc", "th", F.explode(piece).alias("x")).select("x.g", "doc", "th", "x.a", "x.n", "x.mine", "x.bytes")


def cleaned(docs: DataFrame, spans: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc, th, n_bytes, n_removed, n_spans and kept (binary) of docs (doc, th, text as binary): each text without the bytes of its runs of windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                rows = []
                for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                    kept, end, n, removed = [], 0, 0, 0
                    for a, b in sorted((x["a"], x["a"] + x["n"] + length - 1) for x in at or ()):
                        if a > end or not n:
                            kept.append(text[end:a])
                            n += 1
                            removed += b - a
                        else:
                            removed += max(0, b - end)
                        end = max(end, b)
                    kept.append(text[end:])
                    rows.append((len(text), removed, n, b"".join(kept)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), *[pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)]], ["doc", "th", "n_bytes", "n_removed", "n_spans", "kept"])

    lists = spans.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "n")).alias("at"))
    rows = docs.join(lists, ["doc", "th"], "left")
    return rows.mapInArrow(work, "doc long, th long, n_bytes long, n_removed long, n_spans long, kept binary")


def numbered(docs: DataFrame, unique: bool, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, th, text: doc orders documents and th, a hash of the text, those that share it; 0 where no two do (unique). A null id comes last."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.lit(0).cast("long").alias("th") if unique else F.xxhash64(text).alias("th"), text.alias("text"))


def batches_of(docs: DataFrame, id_col: str, text_col: str, least: int = BATCHES, most_bytes: int = BATCH_BYTES) -> list[DataFrame]:
    """docs in ranges of ids, of about as many documents each; null ids are in the last."""
    key = F.col(id_col)
    n = max(least, -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // most_bytes))
    cuts = sorted(set(docs.agg(F.percentile_approx(key.cast("long"), [k / n for k in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    if not cuts:
        return [docs]
    return [docs.where(key <= cuts[0]), *[docs.where((key > a) & (key <= b)) for a, b in zip(cuts, cuts[1:], strict=False)], docs.where((key > cuts[-1]) | key.isNull())]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least_batches: int = BATCHES, chunk: int = CHUNK, most_of_gram: int = MOST_OF_GRAM, digest: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept of every document: its text as UTF-8 without the bytes that a string of length bytes covers
    which starts earlier too, in a document of a smaller id or in this one. digest: kept_sha256 in place of kept.

    Null texts are empty; texts under length bytes stay whole, longer ones are read whole, in chunks. A null id comes after all others. Rows
    with equal id and text are one document and get equal results; others of one id are ordered by a hash of the text. An empty table
    gives no rows; other columns are not read. The result is written, since the family's tables go.
    """
    spark = docs.sparkSession
    unique = docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    family, results = SuffixFamily(spark, length=length, chunk=chunk, most_of_gram=most_of_gram), []
    out = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{family.name}_result"
    named = [F.when(F.col("doc") < LAST, F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256") if digest else F.col("kept")]
    try:
        for k, batch in enumerate(batches_of(docs, id_col, text_col, least_batches)):
            texts, spans = family.add(numbered(batch, unique, id_col=id_col, text_col=text_col))
            with configured(spark, MERGE_SCANS):
                cleaned(texts, spans, length=length).select(*named).write.parquet(f"{out}/{k}")
            results.append(f"{out}/{k}")
            spark._jvm.System.gc()  # what a batch has shuffled goes with its DataFrames, not at the end of all
    finally:
        family.close()
    return spark.read.parquet(*results)


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)

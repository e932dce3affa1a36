"""Tables that are published as versions: readers see one whole version, whatever a writer does or fails to do meanwhile.

Rows lie in folders, each written once and never changed. A version is a manifest that names the folder of each part of the table (a source, or
a bucket of keys). A writer writes new folders aside, then a manifest under a temporary name, and renames that to the next number: the one step that
publishes, which fails if another writer has taken the number. A writer that is killed before leaves nothing that a reader looks at.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "__part"


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


def part_of_source(source: Column) -> Column:
    """A part for each source; names may hold what a folder's can't."""
    return F.sha1(F.coalesce(source.cast("string"), F.lit("")).cast("binary"))


class Published:
    """A table at root with a fixed schema; part gives the part of a row. One row a part and version comes to the driver."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, part: Column) -> None:
        self.spark, self.root, self.part = spark, root.rstrip("/"), part
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def files(self):
        return self.path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, *folder: str) -> list[str]:
        at = self.path(*folder)
        return sorted(s.getPath().getName() for s in self.files().listStatus(at)) if self.files().exists(at) else []

    def latest(self) -> int:
        """The number of the last version; 0: nothing is published."""
        return max((int(n.removesuffix(".json")) for n in self.names("versions") if n.endswith(".json")), default=0)

    def parts(self, version: int) -> dict[str, str]:
        """The folder of each part of a version."""
        return json.loads(self.spark.read.text(str(self.path("versions", f"{version}.json")), wholetext=True).first()[0]) if version else {}

    def read(self, version: int | None = None, only: Iterable[str] | None = None) -> DataFrame:
        """The rows of a version, the last if none is named, or of some of its parts. What is published later changes nothing in this DataFrame."""
        parts = self.parts(self.latest() if version is None else version)
        folders = [f"{self.root}/{f}" for p, f in sorted(parts.items()) if only is None or p in set(only)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, order: Sequence[Column | str] = ()) -> dict[str, str]:
        """Writes rows aside, sorted within each part, and gives the folders of their parts. Nothing is published."""
        name = f"rows/{uuid.uuid4()}"
        marked = rows.select(*self.schema.names, self.part.alias(PART))
        marked.sortWithinPartitions(PART, *order).write.partitionBy(PART).parquet(f"{self.root}/{name}")
        return {n.removeprefix(f"{PART}="): f"{name}/{n}" for n in self.names(*name.split("/")) if n.startswith(PART)}

    def publish(self, parts: dict[str, str], base: int) -> int:
        """Publishes parts as the version after base; Conflict if there is one already."""
        fs, target, aside = self.files(), self.path("versions", f"{base + 1}.json"), self.path("versions", f".{uuid.uuid4()}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise Conflict(f"version {base + 1} of {self.root} is there already")
        return base + 1

    def replace(self, rows: DataFrame, order: Sequence[Column | str] = (), gone: Iterable[str] = ()) -> int:
        """Publishes rows in place of their parts; parts without a row stay as they are, unless gone names them."""
        base = self.latest()
        old = {p: f for p, f in self.parts(base).items() if p not in set(gone)}
        return self.publish(old | self.write(rows, order), base)

    def clean(self, keep: int = 2) -> list[str]:
        """Removes older versions than the last few, and folders that none of these name; gives the folders. For times without writers."""
        last = self.latest()
        kept = range(max(1, last - keep + 1), last + 1)
        used = {f.split("/")[1] for v in kept for f in self.parts(v).values()}
        for n in self.names("versions"):
            if not n.endswith(".json") or int(n.removesuffix(".json")) not in kept:
                self.files().delete(self.path("versions", n), False)
        unused = [n for n in self.names("rows") if n not in used]
        for n in unused:
            self.files().delete(self.path("rows", n), True)
        return unused


class PublishedByKey(Published):
    """A table of one row a key, in buckets of keys, so that an upsert reads and writes only the buckets that it touches."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, key: str, buckets: int = 64) -> None:
        super().__init__(spark, root, schema, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("string"))
        self.key = key

    def upsert(self, new: DataFrame) -> int:
        """Publishes new in place of the rows of its keys. new: one row a key; null is a key."""
        base = self.latest()
        parts = self.parts(base)
        touched = [r[0] for r in new.select(self.part).distinct().collect()]
        keys = new.select(F.col(self.key).alias("__key")).distinct()
        old = self.read(base, touched)
        kept = old.join(keys, F.col(self.key).eqNullSafe(F.col("__key")), "left_anti")
        return self.publish(parts | self.write(kept.unionByName(new.select(*self.schema.names)), [self.key]), base) if touched else base


def folder_of(part: str) -> str:
    """The part that part_of_source gives a source."""
    return hashlib.sha1(part.encode()).hexdigest()

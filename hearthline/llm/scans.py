"""Orders over a whole table and running sums along them, dealt out over partitions.

A table is range-partitioned by its order, sorted inside and cut off, so that a partition's rows and their order are fixed. What comes to
the driver is one row a partition: its sums, from which each partition gets what stands before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: The partition that a row of an ordered table lies in.
PART = "__part"


def ordered(df: DataFrame, *order: Column | str, columns: Sequence[Column | str] = ("*",)) -> DataFrame:
    """columns of df and PART, in that order from partition to partition and within each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*columns, F.spark_partition_id().alias(PART)))


def extended(df: DataFrame, **longs: str) -> T.StructType:
    """The schema of df without PART and with more columns, which are longs and never null."""
    return T.StructType([*[f for f in df.schema.fields if f.name != PART], *[T.StructField(name, T.LongType()) for name in longs]])


def running(df: DataFrame, **sums: str) -> DataFrame:
    """An ordered table with running sums, each row's own value included: name=column, where the column holds longs without nulls."""
    totals = {r[PART]: np.array(r[1:], dtype=np.int64) for r in df.groupBy(PART).agg(*[F.sum(c).alias(f"__{name}") for name, c in sums.items()]).collect()}
    before, at = {}, np.zeros(len(sums), dtype=np.int64)
    for part in sorted(totals):
        before[part], at = at, at + totals[part]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if carry is None:
                carry = before[batch.column(PART)[0].as_py()].copy()
            more = []
            for k, c in enumerate(sums.values()):
                values = np.cumsum(batch.column(c).to_numpy(zero_copy_only=False)) + carry[k]
                carry[k] = values[-1]
                more.append(pa.array(values))
            kept = [n for n in batch.schema.names if n != PART]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *more], [*kept, *sums])

    return df.mapInArrow(add, extended(df, **sums))

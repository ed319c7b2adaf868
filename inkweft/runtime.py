"""Session-level helpers: durable lineage cuts, size-checked broadcasts, Arrow row mappers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType, StructField

#: Rows and bytes up to which a side may be broadcast; a side beyond either is shuffled instead.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``; only where that is unset (tests on
    one machine) a temporary folder is taken.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; only where that is unset (tests on one machine) a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="inkweft-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, sort: str | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder: smaller than a checkpoint and read column by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(sort) if sort else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _measure(field: StructField) -> Column:
    """Bytes of a value, measured where its type has no fixed size."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, AtomicType):
        return F.lit(8)
    return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int | None = None) -> bool:
    """Whether ``df`` is within the bounds of rows and bytes.

    The rows are counted and their values measured; the scan stops one row beyond the bound.
    """
    size = BROADCAST_BYTES if size is None else size
    each = F.lit(16)
    for field in df.schema.fields:
        each = each + _measure(field)
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return n <= rows and total <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it, else for a sort-merge join."""
    return F.broadcast(df) if fits(df, rows) else df.hint("merge")


def once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each key.  Only the keys are shuffled, and the rows of keys that stand twice."""
    twice = small(durable(df.groupBy(key).count().where("count > 1").select(F.col(key).alias("_twice"))))
    same = F.col(key).eqNullSafe(F.col("_twice"))
    return df.join(twice, same, "left_anti").unionByName(df.join(twice, same, "left_semi").dropDuplicates([key]))


def broadcast_parts(df: DataFrame) -> list[DataFrame]:
    """``df`` in parts each of which may be broadcast: for joins on a condition that no key can serve."""
    n = df.count()
    k = max(1, -(-n // BROADCAST_ROWS))
    while k < n and not all(fits(df.where(F.pmod(F.xxhash64(*df.columns), F.lit(k)) == i)) for i in range(k)):
        k *= 2
    return [F.broadcast(df if k == 1 else df.where(F.pmod(F.xxhash64(*df.columns), F.lit(k)) == i)) for i in range(k)]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="inkweft-package-"), "inkweft.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def arrow_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            elif out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def col_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column if the frame has it, else a typed null."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)

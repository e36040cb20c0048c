"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
#: Of each thread, the tables that the open scopes of ``scratch`` have written, innermost last.
_local = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes



def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application.

    Workers unpickle functions by module name. A zip handed to ``addPyFile`` makes that work on a
    cluster whose executors do not see the driver's files, and also where the repository is only on
    the driver's ``sys.path``.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":  # the default; texts are long, and a batch is held on both sides
        spark.conf.set(BATCH_ROWS, "2000")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="biblens-"), "biblens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("biblens", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def partitions(spark: SparkSession) -> int:
    """The parallelism that the session asks of a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by ``key`` over as many tasks as the session has: a small file of many rows is read by few, and what is then done
    with each row would be done by those few."""
    spark = df.sparkSession
    return df.repartition(max(partitions(spark), spark.sparkContext.defaultParallelism), key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder is made on this machine if all executors are threads of this process;
    on a cluster their disks would not meet, so that is an error.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not told:
        if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="biblens-checkpoint-")
        sc.setCheckpointDir(told)
    return told


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` under the shared folder and read it again: cuts lineage, survives lost executors.

    The shuffle files behind it are not needed once it is written and are deleted then. The setting that
    does so is made once for a session, not around each write, so that queries at the same time do not
    undo each other's; frames that run again compute their shuffles again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if spark.conf.get(SHUFFLE_CLEANUP, "false") != "true":
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    df.write.option("compression", "zstd").parquet(path)
    if open_ := _scopes():
        open_[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted at the end, but for what is written by the function that this yields.

    Frames that read the deleted ones can not be run any more, so results are written with that function; they
    belong to the scope around this one, if any.
    """
    scopes, mine = _scopes(), []
    scopes.append(mine)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = write_table(df, name)
        mine.remove(path)
        if len(scopes) > 1:
            scopes[-2].append(path)
        return out

    try:
        yield keep
    finally:
        scopes.pop()
        for path in mine:
            drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of ``write_table`` that no frame still reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows in a slice of ``numbered``, about: a task sorts no more, however large the table.
SLICE = 250_000


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with whole numbers from 1 in ``order``, without one task for all rows: rows are dealt by range into slices, sorted
    once, and a slice needs only how many rows the slices before it have. Slices grow in number with the table, not in size."""
    slices = max(partitions(df.sparkSession), -(-df.count() // SLICE))
    dealt = df.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt, _ = write_table(dealt, "numbered")
    dealt = dealt.withColumns({"_slice": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    base = dealt.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return dealt.join(F.broadcast(base), "_slice").withColumn(name, F.col("_base") + F.col("_at") + 1).drop("_slice", "_base", "_at")

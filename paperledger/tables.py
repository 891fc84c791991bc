"""Tables in the shared checkpoint folder.

They cut the lineage of what is computed from them: any executor can read them again, and their real sizes take
the place of the planner's estimates. A table is deleted as soon as no DataFrame refers to its files any more,
which is looked up whenever another one is written and by ``release``; what is left then goes when the
application ends.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.session import ship

#: A weak reference to the files' relation in the JVM, and the path, of each table that is there.
_HELD: list[tuple[object, str]] = []
_FOLDERS: dict[tuple[str, str], str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Only a local session without one gets its own."""
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    context.setCheckpointDir(root)
    return context._jsc.sc().getCheckpointDir().get()


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = file_system(spark, path)
    return system.exists(at)


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path for a new table, in this application's folder, which goes when the application ends."""
    root, app = checkpoint_root(spark), spark.sparkContext.applicationId
    if (root, app) not in _FOLDERS:
        _FOLDERS[root, app] = f"{root}/tables-{uuid.uuid4().hex}"
        at, system = file_system(spark, _FOLDERS[root, app])
        system.mkdirs(at)
        system.deleteOnExit(at)
    return f"{_FOLDERS[root, app]}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at, system = file_system(spark, path)
    system.delete(at, True)


def _sweep(spark: SparkSession) -> None:
    for held in list(_HELD):
        if held[0].get() is None:
            _HELD.remove(held)
            delete(spark, held[1])


def own(df: DataFrame, path: str) -> DataFrame:
    """Has the files that df was read from deleted when no DataFrame refers to them any more."""
    spark = df.sparkSession
    relation = df._jdf.queryExecution().analyzed().collectLeaves().head().relation()
    _HELD.append((spark._jvm.java.lang.ref.WeakReference(relation), path))
    return df


def release(spark: SparkSession, seconds: float = 6.0) -> None:
    """Deletes the tables that no DataFrame refers to, now. Objects of Python hold objects of the JVM, and Spark
    lets go of what a query used a little after it, at times over two seconds, so while any table is left this looks
    again for that long; 0 looks once."""
    until = time.monotonic() + seconds
    while _HELD:
        gc.collect()
        spark._jvm.System.gc()
        _sweep(spark)
        if time.monotonic() >= until:
            break
        if _HELD:
            time.sleep(0.15)


class Scratch:
    """Writes tables and reads them back; ``drop`` deletes them at once instead of when they aren't used any more."""

    def __init__(self, spark: SparkSession) -> None:
        ship(spark)
        self.spark, self.paths = spark, {}
        _sweep(spark)

    def __call__(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark)
        df.write.parquet(path)
        out = own(self.spark.read.schema(df.schema).parquet(path), path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Deletes all tables but those to keep, which are deleted when nothing refers to them."""
        kept = {id(x) for x in keep}
        for key in list(self.paths):
            path, _ = self.paths.pop(key)
            if key not in kept:
                _HELD[:] = [h for h in _HELD if h[1] != path]
                delete(self.spark, path)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with more columns, each computed once for a row.

    Spark puts what a column is made of in place of its name in each filter above, as often as it occurs there; it
    doesn't look into what comes out of a generator, here of a list of one struct.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """The rows with their places from 1 on in the order that they are in.

    Each part numbers its own rows; of each part one number is added, so rows are neither collected nor sorted again.
    """
    scratch = Scratch(rows.sparkSession)
    one = scratch(rows.select("*", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    # A row for each part.
    sizes, before = one.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect(), []
    for row in sizes:
        before.append((row["_part"], before[-1][2] if before else 0, (before[-1][2] if before else 0) + row["n"]))
    offsets = rows.sparkSession.createDataFrame([x[:2] for x in before], "_part long, _before long")
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return one.join(offsets, part == F.col("_part")).select(*rows.columns, nth.alias(name))

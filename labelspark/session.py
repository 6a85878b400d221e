"""Session helpers: shared folders and the package for the workers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a written table that may be broadcast (about 100 bytes each).
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    A local temporary folder is used only when the setting is absent and the master is local,
    as in tests; a cluster without the setting is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="labelspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a parquet table in the shared folder (survives executor loss)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the tasks of a shuffle, for work that costs far more than a row's bytes tell.

    After a join the planner merges partitions by bytes, so a million short label texts would be matched by
    two tasks. A stream keeps the partitions of its source.
    """
    return df if df.isStreaming else df.repartition(many_tasks(df.sparkSession))


def many_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def by_rows(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if it has at most so many rows, else to be merged.

    Its files compress so well that their bytes say little of what the driver would have to hold.
    """
    return F.broadcast(written) if written.count() <= rows else written.hint("merge")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application)."""
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_labelspark_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="labelspark-pkg-")) / "labelspark_pkg"
    made = shutil.make_archive(str(target), "zip", root_dir=root, base_dir="labelspark")
    context.addPyFile(made)
    context._labelspark_shipped = True

"""Session helpers: settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS_KEY = "talkframe.blockRows"
DEFAULT_BLOCK_ROWS = 8192


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on (timestamps are compared in UTC) and make the package known to the workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per context, so a session may be started from any folder."""
    context = spark.sparkContext
    if getattr(context, "_talkframe_shipped", False):
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "talkframe.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    context._talkframe_shipped = True


def block_rows(df: DataFrame) -> int:
    """Rows per ordered block. No ordered operator keeps more than this many rows of one key together."""
    return int(df.sparkSession.conf.get(BLOCK_ROWS_KEY, str(DEFAULT_BLOCK_ROWS)))


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; local sessions fall back to a fresh one under /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path inside the shared folder, never reused between runs."""
    return f"{work_root(spark)}/talkframe/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later steps neither recompute nor lose it."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(rows: DataFrame, per_part: int = 8192) -> DataFrame:
    """``rows`` in no more parts than leave ``per_part`` rows to each, for iterative fits: every step is a job over all parts, and a part of few
    rows takes longer to start than to add up."""
    return rows.coalesce(max(1, -(-rows.count() // per_part)))


def side_by_side(rows: DataFrame, steps: Sequence[Callable[[], object]]) -> list:
    """Results of ``steps``, iterative fits over ``rows``, in their order.

    A fit over few rows is many short jobs that leave most cores idle, so such fits share the cluster: up to eight at once. Rows in more
    parts than there are cores fill it alone, and every fit keeps its own copy of them; they get fewer, from four parts a core on one at a time.
    """
    width = max(1, min(8, len(steps), 4 * rows.sparkSession.sparkContext.defaultParallelism // max(1, rows.rdd.getNumPartitions())))
    if width == 1:
        return [step() for step in steps]
    with ThreadPool(width) as pool:
        return pool.map(lambda step: step(), [inheritable_thread_target(rows.sparkSession)(step) for step in steps], chunksize=1)

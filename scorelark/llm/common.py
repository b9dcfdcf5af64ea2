"""What the operators share: input tables, and tables kept in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``. Where that is unset, a local session makes its own; a cluster has to name one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="scorelark-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/scorelark/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scorelark_path = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables that ``kept`` has written; nothing that is still to run may read them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for one in tables:
        at = jvm.org.apache.hadoop.fs.Path(one._scorelark_path)
        at.getFileSystem(conf).delete(at, True)


#: What this worker process holds from task to task.
_resident: dict[object, object] = {}


def resident(key: object, make: Callable[[], object]):
    """What ``make`` gives, made once in a worker process. Workers serve all operators in turn, so they hold one thing at a time."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def vacate() -> None:
    """Let go of what an earlier operator's tasks left in this worker process."""
    _resident.clear()


class Stretches:
    """Intervals by their start, with the furthest end up to each: whether any meets a stretch takes one search."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(accumulate((b for _, b in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start

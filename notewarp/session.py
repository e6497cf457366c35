"""Session helpers: reading tables, scale-aware settings, cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings for a cluster job; a caller's own settings win.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "notewarp", **conf: str) -> SparkSession:
    """A session with the settings this package expects; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**CLUSTER_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below `root`; columns and filters prune at the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one is made only for a local master that sets none."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    defined = context._jsc.sc().getCheckpointDir()
    if defined.isDefined():
        return defined.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="notewarp-")
    atexit.register(shutil.rmtree, made, True)
    context.setCheckpointDir(made)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Folders written by `cut` in this process, by the id of the DataFrame's path.
_written: list[str] = []


def cut_counted(df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
    """Write `df` as a table in the shared folder; it read back, and its number of rows (for which `where` holds).

    Lineage ends here and lost executors cost nothing that was written. The rows are counted by the write itself.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1) if where is None else F.when(where, 1)).alias("n")).write.parquet(path)
    _written.append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back, seen.get["n"]


def cut(df: DataFrame) -> DataFrame:
    """`df`, written to and read from the shared folder."""
    return cut_counted(df)[0]


def drop(*frames: DataFrame) -> None:
    """Delete the tables behind results of `cut` that nothing will read again."""
    for frame in frames:
        path = getattr(frame, "_cut_path", None)
        if path in _written:
            _written.remove(path)
            _delete(frame.sparkSession, path)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder, deleted with the tables of `cut`."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all tables that `cut` has written in this process; results not yet read are lost."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

"""Session settings and the shared work folder."""

from __future__ import annotations

import getpass
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are written for. Parallelism is left to the cluster.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when a later aggregation then needs its own
    # shuffle: one hot key must never pin a third of the rows to one task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows go to Python in batches of bounded size, however long their texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

_LOCAL_FOLDERS: dict[str, str] = {}
_CREATED: dict[str, list[str]] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where nothing is set
    (local tests) a temporary folder is chosen, once per session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spendwright-")
    return _LOCAL_FOLDERS[app]


def lasting_dir(spark: SparkSession) -> str:
    """The folder for what later sessions may read: the shared one, or one fixed folder of this machine in local mode."""
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext.master.startswith("local"):
        return work_dir(spark)
    return f"{tempfile.gettempdir()}/spendwright-{getpass.getuser()}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared work folder."""
    path = f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _CREATED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_intermediates(spark: SparkSession) -> int:
    """Delete the intermediate tables this session wrote; how many there were.

    Call it once the results that read them have been saved.
    """
    paths = _CREATED.pop(spark.sparkContext.applicationId, [])
    return sum(delete(spark, path) for path in paths)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a path below the shared work folder; whether there was one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of the shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path of the shared folder; none if it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    return [s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()]


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Give a finished folder its final name, unless another job has made that already; whether it was done."""
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    files = paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(paths[1].getParent())
    return not files.exists(paths[1]) and bool(files.rename(*paths))


def sized(df: DataFrame, label: str) -> DataFrame:
    """A small aggregate that is joined back to the rows it came from.

    Written down first, its true size is known when the join is planned, so
    Spark broadcasts it exactly when it is below the broadcast threshold and
    shuffles otherwise. Without that, the planner would assume the size of the
    rows and shuffle all of them by a key with few values.
    """
    return materialise(df, label)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on the executors that computed it, and
    whatever a plan reads from it several times is computed once.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}
_WRITTEN: dict[str, set[str]] = {}  # by application: folders that materialize() has written and nobody has dropped


def build_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries are tested with; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("measura")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir, or, where that is unset
    in a local session (as in tests), a folder of this process that goes when it ends."""
    set_to = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="measura-")
        atexit.register(shutil.rmtree, own, True)
        _OWN[app] = f"file://{own}"
    return _OWN[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back.

    Cuts lineage so that lost executors cost a re-read only, stops a Python pass from running once per branch of
    the plan, and gives the optimizer the true size of what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have ended: it does so when the driver's garbage is collected,
    which in a job that needs little of the driver's memory may otherwise come hours later."""
    spark.sparkContext._jvm.System.gc()


def drop_materialized(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what materialize() wrote for these frames, once nothing reads it any more."""
    base = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split(":", 1)[-1].lstrip("/").startswith(base.split(":", 1)[-1].lstrip("/")):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
                _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(next((w for w in _WRITTEN.get(spark.sparkContext.applicationId, ()) if w.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]), ""))


def drop_all_materialized(spark: SparkSession) -> int:
    """Delete every table that this session's operators have written for themselves, and say how many.

    Results that weren't used yet are lost with them: a long-lived session calls this between queries, once it has
    used or written their results.
    """
    written = _WRITTEN.pop(spark.sparkContext.applicationId, set())
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(written)

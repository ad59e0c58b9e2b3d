"""Session helpers shared by every module: tables, shared scratch space, code shipping."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratched: set[str] = set()


def get_spark(cores: str = "*", app: str = "stackwise", partitions: int = 8) -> SparkSession:
    """A local session for tests and bench; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: A table of fewer files than there are cores, and fewer bytes than this a core, is dealt to all cores.
SMALL_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A small table of a few files, which few tasks would read, dealt to as many tasks as there are cores; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 1 << 20 < size < cores * SMALL_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stackwise-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, in a folder of the application's own that goes when the application ends."""
    app = spark.sparkContext.applicationId
    top = f"{shared_dir(spark)}/stackwise/{app}"
    if top not in _scratched:
        path, fs = _path(spark, top)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _scratched.add(top)
    return f"{top}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``saved`` wrote for ``df``, which nothing reads any more."""
    path, fs = _path(df.sparkSession, df._saved_at)
    fs.delete(path, True)


#: Rows and bytes of an Arrow batch: texts are long, and a batch is held whole on both sides.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on every executor (once per application), and Arrow batches small unless the application's configuration sets them."""
    given = spark.sparkContext.getConf()
    for key, (default, small) in ARROW.items():
        if not given.contains(key) and spark.conf.get(key) == default:
            spark.conf.set(key, small)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        file = Path(tempfile.mkdtemp()) / "stackwise_code.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"stackwise/{p.relative_to(top)}")
        spark.sparkContext.addPyFile(str(file))
        _shipped.add(app)
    return spark

"""Session set-up, shared storage and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def build(cores: int | str = "*", app: str = "siltworks", **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for; on a cluster the
    submitter's configuration is used as it is."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in settings.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application: they need not share a disk or
    a search path with the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="siltworks-zip-"))
    atexit.register(shutil.rmtree, at, True)
    with zipfile.ZipFile(at / "siltworks.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"siltworks/{f.relative_to(root)}")
    sc.addPyFile(str(at / "siltworks.zip"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local master gets a temporary folder; a cluster without the setting is
    refused, since a machine's own folder would not be seen by other machines.
    """
    sc = spark.sparkContext
    at = sc.getConf().get(_KEY, None)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"{_KEY} must name a folder shared by all executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = d = tempfile.mkdtemp(prefix="siltworks-")
        atexit.register(shutil.rmtree, d, True)
    return "file://" + _local_dirs[sc.applicationId]


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltworks/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._siltworks_path = path  # type: ignore[attr-defined]
    return back


def sweep(spark: SparkSession) -> None:
    """Delete every table that this application has written by stored(); for the end of a run, since results
    are read from them until then."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame | None) -> None:
    """Delete a table written by stored() that nothing will read again."""
    path = getattr(df, "_siltworks_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan that has fewer partitions than there are cores (one small file, say), ahead
    of costly per-row work. Where the scan already has enough partitions nothing is moved."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)

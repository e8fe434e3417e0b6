"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings results depend on, or that keep plans adaptive. Sizes (shuffle partitions,
# split bytes, executor memory) belong to the cluster, not to the library.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Statements of several questions share the executors instead of waiting for one another.
    "spark.scheduler.mode": "FAIR",
    # HotSpot does not compile methods above this size; without the limit a long chain of
    # expressions fused into one method runs interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """For a session built elsewhere: ship the package and keep generated methods compilable."""
    ship_package(spark)
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > int(DEFAULTS[limit]):
        spark.conf.set(limit, DEFAULTS[limit])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "gridloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def is_local(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "").startswith("local")


def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder; a cluster without it is an error, because a
    driver-local folder would be invisible to the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"gridloom-{spark.sparkContext.applicationId}")
    os.makedirs(folder, exist_ok=True)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A folder name under the work root that nothing else uses."""
    path = f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables written inside this scope when it ends.

    Frames that the scope's functions returned read those tables: use them, or write them
    somewhere else, before the scope ends. Without a scope the tables stay.
    """
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and go on from the files.

    The files outlive lost executors, and everything downstream reads a column-pruned
    Parquet scan instead of recomputing the scan and the shuffles before it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

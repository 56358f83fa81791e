"""Reading tables, shared intermediate tables and routing of heavy keys."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c\xa0"
_own: list[str] = []


_shipped: set[int] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per context."""
    sc = spark.sparkContext
    if id(sc) in _shipped:
        return
    _shipped.add(id(sc))
    root = Path(__file__).resolve().parent
    if root.parent.suffix == ".zip":
        return
    folder = tempfile.mkdtemp(prefix="graphloom-")
    _own.append(folder)
    with zipfile.ZipFile(f"{folder}/graphloom_package.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*")):
            if f.suffix in (".py", ".gr"):
                z.write(f, f.relative_to(root.parent))
    sc.addPyFile(f"{folder}/graphloom_package.zip")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(c: Column | str) -> Column:
    """An id as it is compared: without outer white space, in lower case."""
    return F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and all runs in one process (local master), one of our own;
    on a cluster that would be another disk for each executor, so there it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        _own.append(found)
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, cut: int | None = None, by: list[str] | None = None) -> DataFrame:
    """df as a written table in the shared folder: lineage ends there and a lost executor costs nothing.
    `by` columns become folders, so that a filter on them reads no other rows. It goes with the session's other tables when the driver
    exits, or earlier through discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    _register(spark, path)
    (df.coalesce(cut) if cut else df).write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def materialize_with(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """materialize() and aggregates over the rows, observed while they are written, so that a loop needs no second job to see its end."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]))
    return out, seen.get


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote and no later plan reads."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone; the folder's owner cleans up
        pass


_registered: set[int] = set()
_paths: list[str] = []


def _register(spark: SparkSession, path: str) -> None:
    _paths.append(path)
    if id(spark.sparkContext) not in _registered:
        _registered.add(id(spark.sparkContext))
        atexit.register(lambda: [_delete(spark, p) for p in _paths])


@atexit.register
def _drop_own() -> None:
    for p in _own:
        shutil.rmtree(p, ignore_errors=True)


"""Session-level plumbing: shared scratch tables, package shipping, sizing."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parent
_scratch: dict[str, list[str]] = {}
_shipped: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster (``spark.checkpoint.dir``).

    Only where the session names none (local tests) is a folder of this machine made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="provena-scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found:  # name the store, for readers other than Spark's
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
        found = re.sub(r"^file:/+", "file:///", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the driver exits."""
    path = f"{scratch_dir(spark)}/provena/{tag}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = []
        atexit.register(_remove_all, spark, app)
    _scratch[app].append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back.

    A lost executor costs at most the tasks it ran, as every reader starts from shared files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # noqa: SLF001 - lets discard() find the files
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a frame of materialize() that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _remove(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store Spark reaches."""
    _remove(spark, path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, replacing a former one by a rename."""
    jvm = spark.sparkContext._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, options)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small text file's content; None if there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(target):
        return None
    return spark.read.text(path).first()["value"]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all(spark: SparkSession, app: str) -> None:
    for path in _scratch.pop(app, []):
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone at exit
            return


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers whose path lacks it."""
    parent = str(_ROOT.parent)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if parent in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="provena-ship-")) / "provena.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(_ROOT.parent)))
    spark.sparkContext.addPyFile(str(target))


#: rows and bytes of a table that may be broadcast
SMALL_ROWS, SMALL_BYTES = 200_000, 64 << 20


def is_small(df: DataFrame) -> bool:
    """Whether a table may be broadcast: its rows and characters are counted."""
    rows = df.limit(SMALL_ROWS + 1)
    size = [F.coalesce(F.length(F.col("`" + c.replace("`", "``") + "`").cast("string")), F.lit(0)) for c in df.columns]
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(size, F.lit(0))).alias("chars")).first()
    return found["n"] <= SMALL_ROWS and (found["chars"] or 0) <= SMALL_BYTES // 4


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small; else as it is, and joins shuffle both sides."""
    return F.broadcast(df) if is_small(df) else df


def parallelism(spark: SparkSession) -> int:
    """Tasks that can run at once."""
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

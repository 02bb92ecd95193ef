"""Shared working folders and atomic publication.

Everything that outlives one stage is written below the folder named by ``spark.checkpoint.dir``,
which all executors share. Only where that setting is absent and the master is local (tests, a laptop) a local folder
is made; a cluster without the setting is refused. An application's tables lie in one folder, ``stratafold/<its id>``;
those of a finished computation are deleted as soon as its result is written, the rest at the end of a local run.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder shared by driver and executors."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if (set_there := spark.sparkContext.getCheckpointDir()) is not None:
        return set_there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_folder is None:
        folder = tempfile.mkdtemp(prefix="stratafold-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folder = f"file://{folder}"
    return _own_folder


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the application's part of the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/stratafold/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    return _written(df, workspace(spark, purpose), options)


def _written(df: DataFrame, path: str, options: dict[str, str]) -> DataFrame:
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*written: DataFrame) -> None:
    """Delete what ``materialise`` or ``Scratch.keep`` wrote, once nothing reads it any more."""
    for df in written:
        discard(df.sparkSession, df.stored_at)


class Scratch:
    """The intermediate tables of one computation, deleted together once its result is written."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose, self.root = spark, purpose, workspace(spark, f"{purpose}-scratch")

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """``materialise`` below the scratch folder."""
        return _written(df, f"{self.root}/{name}-{uuid.uuid4().hex}", options)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` written to a folder that stays; the scratch folder is deleted."""
        out = materialise(df, self.purpose)
        self.clear()
        return out

    def clear(self) -> None:
        discard(self.spark, self.root)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    place, fs = _hadoop(spark, path)
    fs.delete(place, True)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def as_pattern(path: str) -> str:
    """A pattern that matches just ``path``: the file source of streams takes a plain path for a folder, a pattern for either."""
    plain = path.rstrip("/")
    escaped = "".join(f"\\{c}" if c in "{}[]*?,\\" else c for c in plain)
    return escaped if escaped != plain else f"{plain[:-1]}[{plain[-1]}]"


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _hadoop(spark, path)
    return fs.exists(place)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """One rename of a file or folder; fails if the target is there."""
    a, fs = _hadoop(spark, source)
    b, _ = _hadoop(spark, target)
    if fs.exists(b):
        raise FileExistsError(target)
    parent = b.getParent()
    if not fs.exists(parent):
        fs.mkdirs(parent)
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file through a temporary name and one rename, replacing an older one."""
    jvm = spark.sparkContext._jvm
    staged, fs = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    target, _ = _hadoop(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, target, overwrite)


def read_text(spark: SparkSession, path: str) -> str | None:
    place, fs = _hadoop(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, folders: dict[str, str], facts: dict) -> int:
    """Publish staged folders as the next version of ``root``.

    The staged folders move under ``root/v<N>/``; readers see them only once ``root/CURRENT``, replaced by a
    single rename, names that version. A failure before that rename leaves the earlier version in force.
    """
    current = read_text(spark, f"{root}/CURRENT")
    version = json.loads(current)["version"] + 1 if current else 1
    while exists(spark, f"{root}/v{version}"):
        version += 1
    for name, staged in folders.items():
        rename(spark, staged, f"{root}/v{version}/{name}")
    write_text(spark, f"{root}/CURRENT", json.dumps({"version": version, "folders": sorted(folders)} | facts))
    return version


def published(spark: SparkSession, root: str, name: str) -> str:
    """Path of a folder of the version in force."""
    current = read_text(spark, f"{root}/CURRENT")
    if current is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return f"{root}/v{json.loads(current)['version']}/{name}"


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``; runs no job."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(size, 1 << 60)


def broadcasts(df: DataFrame) -> bool:
    """Whether the session's size check would broadcast ``df``, a scan or a written table, by itself."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    number = text.rstrip("bkmg")
    return plan_bytes(df) <= int(number) * units[text[len(number) :] or "b"]


def spread(df: DataFrame, bytes_each: int, least: int | None = None, times: float = 1) -> int:
    """A partition count that keeps the partitions of ``times`` as much as ``df`` near ``bytes_each``.

    Meant for scans and written tables, whose size the optimizer knows; where it does not (it then says exabytes, and for
    joins a product), the session's number of shuffle partitions holds.
    """
    spark = df.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    if size >= 1 << 52:
        return usual
    return int(min(max(usual if least is None else least, -(-int(size * times) // bytes_each), 1), 100_000))

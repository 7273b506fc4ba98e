"""The folder that driver and executors share, and tables and files written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where a session names none, one is made and set, but
    only if driver and executors are one process: elsewhere a local folder is not shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vistaframe-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = file_system(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    try:
        at, files = file_system(spark, path)
        files.delete(at, True)
    except Exception:  # at the interpreter's end the session may be gone
        pass


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, ascending; none if it is not there."""
    at, files = file_system(spark, folder)
    return sorted(str(x.getPath().getName()) for x in files.listStatus(at)) if files.exists(at) else []


def rename_once(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file or folder unless the target is there: True if this call did it, else
    the source is removed. As atomic as the file system's rename without overwriting."""
    (at, files), (to, _) = file_system(spark, source), file_system(spark, target)
    files.mkdirs(to.getParent())
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(at, to, spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        return True
    except Exception:
        if not files.exists(to):
            raise
        files.delete(at, True)
        return False


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    at, files = file_system(spark, path)
    out = files.create(at, True)
    out.write(bytearray(data))
    out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


_paths: dict[int, tuple[DataFrame, str]] = {}
#: Bytes that a file of a table of known size holds, at the least.
FILE_BYTES = 1 << 24


def written(df: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: lineage ends
    there, columnar and compressed, and no executor's loss can take the rows away.
    ``size``: about how many bytes there are, if known; then no more files are made
    than that fills, or than there are cores. The folder goes when the interpreter
    ends, or by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if size is not None:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES)))
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = out, path
    return out


def discard(table: DataFrame) -> None:
    """Remove a table that ``written`` returned and nothing will read again."""
    _, path = _paths.pop(id(table))
    delete(table.sparkSession, path)

"""Files and folders through Spark's own file systems, so that any store that Spark reaches will do."""

from __future__ import annotations

import contextlib
import io
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


#: The folders that sessions keep their intermediate tables in, by the shared folder's name and the session's.
_roots: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir.

    It is in a folder of the session's own, which goes when the session's process ends. Where no shared folder is named
    there is one of our own, for a session in one process only (tests): a folder of one machine is none that a cluster
    shares.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    key = ((base or "/tmp/checkpoints").rstrip("/"), spark.sparkContext.applicationId)
    if key not in _roots:
        path = f"{key[0]}/tidelake-{key[1]}-{uuid.uuid4().hex[:8]}"
        fs, p = _fs(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(fs.makeQualified(p))
        _roots[key] = path
    return f"{_roots[key]}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a Parquet table in the scratch folder: computed once, however often it is read."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def each(action: Callable, items: Iterable, threads: int = 32) -> None:
    """The action on each item, many at once: calls of a file system mostly wait. The first failure is raised."""
    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(action, items))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    q = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"cannot move {source} to {target}")


def copy(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    fs2, q = _fs(spark, target)
    fs2.mkdirs(q.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs2, q, False, spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a folder, bytes) of what a folder holds; empty if there is none."""
    fs, p = _fs(spark, path)
    return [(s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modified in ms) of all Parquet files below a folder that readers see: none in folders named _..."""
    fs, p = _fs(spark, path)
    out = []
    if fs.exists(p):
        root = len(fs.makeQualified(p).toString())
        it = fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            found = s.getPath().toString()
            if found.endswith(".parquet") and "/_" not in found[root:]:
                out.append((found, s.getLen(), s.getModificationTime()))
    return out


def parquet_only(spark: SparkSession, found: list[str], threads: int = 32) -> list[str]:
    """Those of the files that begin and end as Parquet does."""

    def sound(path: str) -> bool:
        fs, p = _fs(spark, path)
        size = fs.getFileStatus(p).getLen()
        if size < 12:
            return False
        stream = fs.open(p)
        try:
            head = bytes(stream.readNBytes(4))
            stream.seek(size - 4)
            return head == bytes(stream.readNBytes(4)) == b"PAR1"
        finally:
            stream.close()

    with ThreadPoolExecutor(threads) as pool:
        return [f for f, ok in zip(found, pool.map(sound, found), strict=True) if ok]


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_pieces(spark: SparkSession, path: str, pieces: Iterable[bytes]) -> None:
    """Pieces as one file, written as they come."""
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        for piece in pieces:
            stream.write(bytearray(piece))
    finally:
        stream.close()


class Reading(io.RawIOBase):
    """A file to read from its beginning on; memory holds what is asked for at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        fs, p = _fs(spark, path)
        self._stream = fs.open(p)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self._stream.readNBytes(len(into))
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


@contextlib.contextmanager
def lock(spark: SparkSession, path: str, wait: float = 30.0, stale: float = 120.0):
    """Holds the file path, which only one can make at a time; one that is older than `stale` seconds was left behind.

    Threads of this process wait for each other before, as not every file system makes files atomically.
    """
    with _held:
        yield from _lock(spark, path, wait, stale)


_held = threading.RLock()


def _lock(spark: SparkSession, path: str, wait: float, stale: float):
    fs, p = _fs(spark, path)
    began = time.time()
    while True:
        try:
            fs.create(p, False).close()
            break
        except Exception:
            if not fs.exists(p):
                if time.time() - began > wait:
                    raise
            elif time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > stale:
                fs.delete(p, False)
            elif time.time() - began > wait:
                raise TimeoutError(f"{path} is held by another writer") from None
            time.sleep(0.05)
    try:
        yield
    finally:
        fs.delete(p, False)

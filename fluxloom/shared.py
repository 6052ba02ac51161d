"""Files and tables that every machine of the cluster sees, through the cluster's own file systems.

Intermediate tables lie below spark.checkpoint.dir.  They are deleted once they
are no longer read: drop() and scratch() delete at once, and what a lazy result
may still read goes when the program ends.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}
#: The innermost scratch() of each thread comes last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
_local: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own, which a single machine alone can use."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir names no folder that all machines of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="shared-")
    return _local[app]


def folder(spark: SparkSession, what: str) -> str:
    """A fresh path below root(), deleted at the end of the innermost scratch() or of the program."""
    path = f"{root(spark)}/{what}-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(_end)
    _held[path] = spark
    if scopes := _scopes.get():
        scopes[-1].append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path_ = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() has returned."""
    for t in tables:
        _delete(t.shared_path_)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those that the list then holds."""
    kept: list[DataFrame] = []
    outer, made = _scopes.get(), []
    _scopes.set((*outer, made))
    try:
        yield kept
    finally:
        _scopes.set(outer)
        stay = {t.shared_path_ for t in kept}
        for path in made:
            if path in stay:
                if outer:
                    outer[-1].append(path)
            elif path in _held:
                _delete(path)


def _delete(path: str) -> None:
    spark = _held.pop(path, None)
    if spark is not None:
        fs, at = _fs(spark, path)
        fs.delete(at, True)


def _end() -> None:
    for path in list(_held):
        try:
            _delete(path)
        except Exception:  # the session may be gone, and with it the way to the store
            return


# --- small files


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def exists(path: str) -> bool:
    fs, at = _fs(_spark(), path)
    return fs.exists(at)


def remove(path: str) -> None:
    """Deletes a file or a folder with all in it."""
    fs, at = _fs(_spark(), path)
    fs.delete(at, True)


def read_text(path: str) -> str:
    """The text of a small file; FileNotFoundError without one."""
    spark = _spark()
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(text: str, path: str) -> None:
    """A small file, in place only once it is whole."""
    spark = _spark()
    fs, at = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    part = hadoop.Path(f"{path}.part")
    stream = fs.create(part, True)  # with the folders above it
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(at), over)


def listed(pattern: str) -> list[str]:
    """Paths that match a glob pattern, in order."""
    fs, at = _fs(_spark(), pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])


def head(path: str, size: int = 1 << 16) -> str:
    """The beginning of a file, or of the first non-empty one in a folder; undecodable bytes are left out."""
    spark = _spark()
    fs, at = _fs(spark, path)
    files = [s for s in fs.globStatus(at) or [] if s.isFile()] or [s for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))]
    first = next((s.getPath() for s in sorted(files, key=lambda s: s.getPath().toString()) if s.getLen()), None)
    if first is None:
        return ""
    stream = fs.open(first)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size))).decode(errors="ignore")
    finally:
        stream.close()


def modified(path: str) -> float | None:
    """Seconds since the epoch at which a file last changed; None without one."""
    fs, at = _fs(_spark(), path)
    return fs.getFileStatus(at).getModificationTime() / 1000 if fs.exists(at) else None


def json_or(path: str, default=None):
    """A JSON file's value, or the default where it is missing or unreadable."""
    try:
        return json.loads(read_text(path))
    except (OSError, ValueError):
        return default


def json_if_there(path: str):
    """A JSON file's value, or None without one; a file that is no JSON raises."""
    try:
        text = read_text(path)
    except FileNotFoundError:
        return None
    try:
        return json.loads(text)
    except ValueError as e:
        raise ValueError(f"{path} is there but is no JSON: {e}") from e

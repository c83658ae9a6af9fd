"""Files that a table consists of: versions, and small files that only one writer can create."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession

KEPT_VERSIONS = 2  # the current one, and the one that running readers may still hold
COMPRESSION = "zstd"  # of stored tables


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _path(spark, path)
    return fs.exists(found)


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder has been committed; a dead job leaves none."""
    return exists(spark, f"{folder}/_SUCCESS")


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, sorted; nothing if there is none."""
    fs, found = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """A file, or the files right below a folder that Spark reads, with their sizes in bytes."""
    fs, found = _path(spark, path)
    seen = [(s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in fs.listStatus(found) if s.isFile()]
    return sorted((file, size) for name, file, size in seen if not name.startswith(("_", ".")))


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Committed versions below a folder, oldest first."""
    return [n for n in names(spark, folder) if n.startswith("v") and is_complete(spark, f"{folder}/{n}")]


def new_version() -> str:
    return f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def version_age(version: str) -> float:
    """Seconds since a version's name was made."""
    return time.time() - int(version[1:21]) / 1e9


def drop_old_versions(spark: SparkSession, folder: str, keep: int = KEPT_VERSIONS) -> None:
    for name in versions(spark, folder)[:-keep]:
        delete(spark, f"{folder}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    fs, found = _path(spark, path)
    fs.delete(found, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, found = _path(spark, path)
    stream = fs.open(found)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a small file with all its text at once; False if it is there already.

    Of several writers one succeeds. The text goes to a file beside it, which then gets the
    name: by a link on local disks, else by the file system's rename without overwriting.
    """
    fs, target = _path(spark, path)
    draft = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.draft"
    _, source = _path(spark, draft)
    fs.mkdirs(target.getParent())
    out = fs.create(source, True)
    out.write(text.encode())
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(source.toUri().getPath(), target.toUri().getPath())
        else:
            rename_new(spark, draft, path)
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(source, False)


def rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file unless the target exists."""
    from py4j.protocol import Py4JJavaError

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    kinds = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.NONE
    (_, source_path), (_, target_path) = _path(spark, source), _path(spark, target)
    files = hadoop.FileContext.getFileContext(target_path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(source_path, target_path, how)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            raise FileExistsError(target) from None
        raise

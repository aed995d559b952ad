"""Folder operations on whatever file system a path names, through Hadoop's client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return fs.exists(jpath)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the direct sub-folders."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory())


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly in a folder."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.isFile())


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Paths, relative to the folder, of all files in it and its sub-folders."""
    fs, jpath = _fs(spark, path)
    root = fs.makeQualified(jpath).toUri().getPath().rstrip("/") + "/"
    found, listing = [], fs.listFiles(jpath, True)
    while listing.hasNext():
        found.append(listing.next().getPath().toUri().getPath().removeprefix(root))
    return sorted(found)


def changed(spark: SparkSession, path: str) -> float:
    """When a file or folder last changed, in seconds."""
    fs, jpath = _fs(spark, path)
    return fs.getFileStatus(jpath).getModificationTime() / 1000


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _fs(spark, path)
    held = fs.open(jpath)
    try:
        return bytes(held.readAllBytes()).decode()
    finally:
        held.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file if there is none; whether it was this call that did.

    The name is there before the text, so a reader may find the file empty for a moment.
    """
    fs, jpath = _fs(spark, path)
    try:
        out = fs.create(jpath, False)
    except Exception as e:  # noqa: BLE001
        if fs.exists(jpath):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True

"""Small file-system helpers over the Hadoop API, so that any shared storage works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def is_dir(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).getFileStatus(_path(spark, path)).isDirectory()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a directory, sorted; empty when it does not exist."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)))


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of a file, or of every data file under a directory."""
    status = _fs(spark, path).getFileStatus(_path(spark, path))
    if not status.isDirectory():
        return [(status.getPath().toString(), status.getLen(), status.getModificationTime())]
    found = []
    for child in _fs(spark, path).listStatus(_path(spark, path)):
        if not child.getPath().getName().startswith(("_", ".")):
            found += data_files(spark, child.getPath().toString())
    return found


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small text file; fails when it is already there."""
    out = _fs(spark, path).create(_path(spark, path), False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def first_line(spark: SparkSession, path: str) -> str:
    """First line of a text file (a CSV header), without reading the rest."""
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        jvm = spark._jvm
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine() or ""
    finally:
        stream.close()

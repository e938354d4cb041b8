"""Small files and renames on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, own = at(spark, path)
    out = files.create(own, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """What a small file holds, or a folder of parts that Spark has written under its name, in their order; None if there is none."""
    files, own = at(spark, path)
    if not files.exists(own):
        return None
    if files.getFileStatus(own).isDirectory():
        return "".join(read_text(spark, f"{path}/{name}") or "" for name in names(spark, path) if not name.startswith(("_", ".")))
    source = files.open(own)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def replace(spark: SparkSession, path: str, target: str) -> None:
    """Renames a file over another, in one step."""
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files, own = at(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(own, at(spark, target)[1], how)


def remove(spark: SparkSession, path: str) -> None:
    files, own = at(spark, path)
    files.delete(own, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder; none if it isn't there."""
    files, own = at(spark, path)
    return [s.getPath().toString() for s in files.listStatus(own) if s.isDirectory()] if files.exists(own) else []


def exists(spark: SparkSession, path: str) -> bool:
    files, own = at(spark, path)
    return files.exists(own)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, own = at(spark, path)
    return files.exists(own) and files.getFileStatus(own).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, sorted; none if it isn't there."""
    files, own = at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(own)) if files.exists(own) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all that lies in a folder; of a pattern, what it matches."""
    files, own = at(spark, path)
    return sum(files.getContentSummary(s.getPath()).getLength() for s in files.globStatus(own) or [])

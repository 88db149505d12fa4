"""Small control files through Hadoop's file systems, so that a store may lie wherever Spark can write."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    _, fs, p = _at(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, None if it is not there."""
    jvm, fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file: written beside it first, then renamed over it, so that one of the two is always whole."""
    jvm, fs, p = _at(spark, path)
    _, _, temporary = _at(spark, path + ".tmp")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(temporary), fs.makeQualified(p), overwrite)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete the folder when the application ends."""
    _, fs, p = _at(spark, path)
    fs.deleteOnExit(p)


def names(spark: SparkSession, path: str) -> list[str]:
    _, fs, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    _, fs, p = _at(spark, path)
    fs.delete(p, True)

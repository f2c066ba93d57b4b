"""Commit points on the shared file system: a file that is created once, whole, or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this content, unless it is there; whether it was created.

    The content is written beside it first and gets its name in one step that fails if the
    name is taken (a hard link on a local disk, else a rename that does not overwrite), so of
    two writers one succeeds, and no reader sees half a file.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, system = _path(spark, path)
    system.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if system.getScheme() == "file":
            files, paths = jvm.java.nio.file.Files, jvm.java.nio.file.Paths
            files.createLink(paths.get(target.toUri().getPath(), _none(spark)), paths.get(draft.toUri().getPath(), _none(spark)))
        else:
            options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
        return True
    except Exception as error:
        if "AlreadyExists" not in str(error) and not system.exists(target):
            raise
        return False
    finally:
        system.delete(draft, False)


def _none(spark: SparkSession):
    return spark._sc._gateway.new_array(spark._jvm.java.lang.String, 0)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    target, system = _path(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder, in order; none if it is not there."""
    target, system = _path(spark, folder)
    if not system.exists(target):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(target))


def remove(spark: SparkSession, path: str) -> None:
    target, system = _path(spark, path)
    system.delete(target, True)

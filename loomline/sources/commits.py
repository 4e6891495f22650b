"""Numbered commits of a folder: what tables, indexes and cursors use to become visible as a whole, or not at all.

A writer puts its data under names of its own, then renames one small JSON file to the next number. The rename is atomic and
never replaces a file, so of two writers of one number one fails, and data of a writer that died is named by no commit.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer has made the commit of this number."""


def scratch(spark: SparkSession, kind: str = "scratch") -> str:
    """A fresh path in the shared folder of the session; a temporary one only in one process without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, where, store = _hadoop(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    _, where, store = _hadoop(spark, path)
    store.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _, where, store = _hadoop(spark, path)
    out = store.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    jvm, where, store = _hadoop(spark, path)
    f = store.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
    finally:
        f.close()


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Atomic, and an error if the target exists."""
    jvm, where, _ = _hadoop(spark, source)
    option = jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(option, 1)
    none[0] = option.NONE
    target_path = jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(where, target_path, none)


def commits(spark: SparkSession, path: str) -> dict[int, dict]:
    """All commits of a folder by number."""
    _, where, store = _hadoop(spark, path)
    if not store.exists(where):
        return {}
    names = [s.getPath().getName() for s in store.listStatus(where)]
    return {int(m[1]): json.loads(read_text(spark, f"{path}/{n}")) for n in sorted(names) if (m := re.fullmatch(r"(\d{8})\.json", n))}


def commit(spark: SparkSession, path: str, number: int, body: dict) -> None:
    """Make commit ``number``; raises CommitConflict if there is one."""
    from py4j.protocol import Py4JJavaError

    draft, target = f"{path}/.{uuid.uuid4().hex}", f"{path}/{number:08d}.json"
    write_text(spark, draft, json.dumps(body))
    try:
        rename(spark, draft, target)
    except Py4JJavaError as e:
        remove(spark, draft)
        if "FileAlreadyExists" in str(e.java_exception):
            raise CommitConflict(target) from e
        raise

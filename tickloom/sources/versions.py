"""Tables in versions: a folder for each version and a manifest that names the folders that count.

A writer fills a folder of its own and then puts a new manifest in the place of the old one by a single rename, so a
reader sees the old version or the new one, whole, and never a folder that is being written.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def _plain(spark: SparkSession, path: str):
    """A file system of its own without checksum files, which a rename would move after the file itself."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.newInstance(where.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    fs.setVerifyChecksum(False)
    fs.setWriteChecksum(False)
    return where, fs


def read_manifest(spark: SparkSession, root: str) -> dict:
    """The manifest, or an empty one."""
    where, fs = _plain(spark, f"{root}/{MANIFEST}")
    try:
        if not fs.exists(where):
            return {}
        stream = fs.open(where)
        try:
            return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
    finally:
        fs.close()


def swap_manifest(spark: SparkSession, root: str, content: dict) -> None:
    """One rename over the old manifest. Hadoop's own for local paths deletes the old file first, so there the system's rename is taken."""
    jvm = spark._jvm
    new, fs = _plain(spark, f"{root}/.{MANIFEST}-{uuid.uuid4().hex}")
    try:
        stream = fs.create(new, True)
        stream.write(json.dumps(content, sort_keys=True).encode())
        stream.close()
        source, target = fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}"))
    finally:
        fs.close()
    if target.toUri().getScheme() == "file":
        os.replace(source.toUri().getPath(), target.toUri().getPath())
        return
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(source, target, how)


def write_version(df: DataFrame, root: str, name: str = "") -> str:
    """A new folder under ``root``; its name isn't in the manifest yet."""
    folder = f"data/{name}{'-' if name else ''}{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return folder


def unused(spark: SparkSession, root: str) -> list[str]:
    """Folders of versions that the manifest doesn't name: they may go once no reader of an older manifest is left."""
    where, fs = _fs(spark, f"{root}/data")
    named = json.dumps(read_manifest(spark, root))
    found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(f"data/{name}" for name in found if name not in named)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; a session on one machine may name none and gets a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{root}/{name}-{uuid.uuid4().hex}"

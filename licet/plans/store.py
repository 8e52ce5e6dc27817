"""Where encoded columns are kept, and what they were made from."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs in one process."""
    if uri := spark.conf.get("spark.checkpoint.dir", None):
        return uri.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "own" not in _own:
        _own["own"] = tempfile.mkdtemp(prefix="licet-columns-")
        atexit.register(shutil.rmtree, _own["own"], True)
    return f"file://{_own['own']}"


def folder(spark: SparkSession) -> str:
    """URI of a new folder of our own; it is deleted when the driver exits."""
    uri = f"{root(spark)}/column-{uuid.uuid4().hex}"
    if uri.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, unquote(urlparse(uri).path), True)
    return uri


def dropped(spark: SparkSession, uris: list[str]) -> None:
    """Deletes what was written on the way to a column and is not read any more."""
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def identity(df: DataFrame) -> str:
    """A digest of the input files with their sizes and times, of the plan over them and of its schema:
    facts about other files, a rewritten file or another expression are not valid here."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    h = hashlib.sha256(f"{df.semanticHash()}|{df.schema.simpleString()}|{df._jdf.queryExecution().analyzed().canonicalized().toString()}".encode())
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        h.update(f"|{f} {status.getLen()} {status.getModificationTime()}".encode())
    return h.hexdigest()

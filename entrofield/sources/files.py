"""Files of any store that pyarrow opens, for readers and writers in Python workers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a URI; a plain path is local."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark resolves it to, so that Python workers reach the same store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def shared_dir(spark: SparkSession, name: str) -> str:
    """URI of a new folder below spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary folder stands in for it in local mode only: on a cluster every
    executor would have its own. Results are read from these folders later on, so they stay until release().
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {master})")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="entrofield-")
            atexit.register(shutil.rmtree, _own[app].removeprefix("file://"), ignore_errors=True)
        base = _own[app]
    made = f"{qualified(spark, base).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(made)
    return made


def release(spark: SparkSession) -> int:
    """Deletes the folders that shared_dir() has named in this application, with Spark's own file system; their number. DataFrames that read from them can't be used any more."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for uri in made:
        p = spark._jvm.org.apache.hadoop.fs.Path(uri)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(made)

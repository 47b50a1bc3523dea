"""Shared-folder helpers: everything that outlives a task goes where all executors can read it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests on one machine) a temporary folder
    is made and remembered in the session.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("larkspan.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='larkspan-')}"
        spark.conf.set("larkspan.shared.dir", root)
    return root.rstrip("/")


def workdir(spark: SparkSession, name: str) -> str:
    """URI of a new folder under the shared root; made by whoever writes first."""
    return f"{shared_root(spark)}/larkspan/{name}-{uuid.uuid4().hex[:12]}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for bytes that Spark's writers can't write."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


_WRITTEN: list[str] = []


def remove_intermediates() -> None:
    """Delete what materialize() has written; results that were not saved yet can't be read after that."""
    while _WRITTEN:
        fs, top = open_fs(_WRITTEN.pop())
        try:
            fs.delete_dir(top)
        except FileNotFoundError:
            pass


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The folder is kept while the driver lives, since results are lazy, and goes
    with remove_intermediates(), at the latest when the driver exits.
    """
    spark = df.sparkSession
    path = path or workdir(spark, name)
    if not _WRITTEN:
        atexit.register(remove_intermediates)
    _WRITTEN.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until df has no such column (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus

"""Session helpers shared by every operator: code shipping, shared scratch space, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


#: Rows that travel to Python and back at a time: whole texts are among them, and both sides hold a batch or two.
ARROW_ROWS, ARROW_DEFAULT = 1000, 10_000


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors, once per application, and bound Arrow batches unless the session has set them."""
    sc = spark.sparkContext
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) == ARROW_DEFAULT:
        spark.conf.set(setting, ARROW_ROWS)
    if sc.applicationId not in _shipped:
        archive = os.path.join(tempfile.mkdtemp(), f"{_PACKAGE.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(_PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(_PACKAGE.parent))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); only a local session may do without one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    """(path, its file system) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Cuts the lineage with files that outlive any executor; they go when the
    application ends, or when ``free`` is told.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path, compression="zstd")
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that no plan reads any more."""
    for df in frames:
        where, files = _path(df.sparkSession, df.scratch_path)
        files.delete(where, True)


#: Bytes of rows, as ``row_bytes`` counts them, that a side of a join may have to be broadcast.
BROADCAST_BYTES = 16 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: fixed columns by their type, strings, binaries and arrays by what they hold, 16 for the row."""
    parts = [F.lit(16)]
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16)
        elif isinstance(kind, (ArrayType, MapType)):
            parts.append(F.greatest(F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0)), F.lit(0)) * 16 + 16)
        else:
            parts.append(F.lit(8))
    return reduce(lambda a, b: a + b, parts)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when ``df``, which should be materialised, was measured to have at most ``max_bytes``; else leave the join to shuffle."""
    size = df.agg(F.coalesce(F.sum(row_bytes(df).cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= max_bytes else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan as it is, or, where it has so few parts that half of the cores would idle through costly work, its rows dealt anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 2 * parts <= cores else df

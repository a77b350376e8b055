"""What the operators share: reading tables, and cutting lineage on shared storage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as the cluster names it. A local session alone may do without, and gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The written table survives the loss of any executor, is evaluated once, and has
    sizes that adaptive execution can plan with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Nothing refers to the shuffles of earlier jobs any more: let the driver drop their files.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` has written, once all that was made of them is written too."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(key: str, text: str) -> tuple[Column, Column]:
    """Two columns, never null, that tell rows apart by id and text; a row without an id equals none that has one."""
    own = F.col(key).cast("long")
    body = F.col(text)
    return F.coalesce(own, F.lit(-1)), F.when(own.isNull(), F.xxhash64(body, F.lit("no id"))).otherwise(F.xxhash64(body))


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose ``column`` of strings or bytes has about ``limit`` bytes each, or one longer value."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)

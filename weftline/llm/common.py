"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: About how many bytes of text a Python worker turns into objects at once, and how many words it remembers.
BLOCK_BYTES, MEMO = 1 << 20, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer input splits than the cluster has cores is dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a local
    master (a test) takes a temporary folder of this machine; any other is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` inside a higher-order function with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def replaced(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """``schema`` with ``fields`` at its end; columns of the same names (in any case) go."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + list(fields))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def blocks(batches: Iterator[pa.RecordBatch], position: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches``, each of about ``most`` bytes of the strings in column ``position``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(position)), 0).to_numpy(zero_copy_only=False)
        begun = np.concatenate(([0], np.cumsum(sizes)[:-1])) // most
        cuts = [0, *(np.flatnonzero(np.diff(begun)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)

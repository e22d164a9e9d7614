"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): ord(b) for a, b in zip(UPPER, LOWER)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it; only a local session without that
    setting (tests) gets a temporary folder, which is then set for the session.
    On a cluster, where a folder of the driver's own would be shared with nobody,
    its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: what comes later reads files that outlive any executor,
    and the work before it isn't done twice.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(keep: Iterable[str] | None, outputs: Iterable[str]) -> list[str]:
    """The columns to carry through; one named like an output is left out."""
    taken = set(outputs)
    return [c for c in dict.fromkeys(keep or []) if c not in taken]


def crc32_mod(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(crc32_mod(column, modulus) == F.lit(remainder), F.lit(False))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def arrow_schema(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

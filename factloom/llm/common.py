"""What the operators share: tables, the shared folder, written intermediate tables, the held-out rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs in one process (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends in files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_fields(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` and the fields of the text ``more``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def plan_bytes(df: DataFrame) -> int:
    """Estimated input bytes of a plan that scans files, from Catalyst's statistics; sizes partitions only."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a plan without statistics
        size = 1 << 62
    return size if size < 1 << 50 else df.rdd.getNumPartitions() * (16 << 20)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def chosen(have: Column | int, want: int, *key: str) -> Column:
    """Whether a row is among about ``want`` of ``have``, by a hash of ``key`` to 53 bits: the same rows on any cluster, at any size."""
    place = F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in key], F.lit(17)), 11)
    share = (F.lit(want) / have) if isinstance(have, Column) else F.lit(want / max(1, have))
    return place < share * float(1 << 53)


def bounded_sample(df: DataFrame, key: str, have: int, want: int) -> DataFrame:
    """About ``want`` of ``have`` rows."""
    return df if have <= want else df.filter(chosen(have, want, key))

"""Scans over files: strict JSON with a status for each file, manifests of items, trees with reasons and a digest that needs no order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from factloom.functions import text as T
from factloom.operators import safety as S


@F.pandas_udf(StructType([StructField("problem", StringType()), StructField("canonical", StringType())]))
def _strict(content: pd.Series) -> pd.DataFrame:
    def read(body: bytes | None) -> tuple[str | None, str | None]:
        try:
            return T.strict_object(body.decode("utf-8")) if body is not None else ("too_large", None)
        except UnicodeDecodeError:
            return "not_utf8", None

    return pd.DataFrame([read(b) for b in content], columns=["problem", "canonical"])


def strict_files(spark: SparkSession, path: str, most: int = 4 << 20) -> DataFrame:
    """path, bytes, digest, problem (null: none), canonical of every file below ``path``: one strict JSON object each.

    Spark lists and deals out the files, wherever they are; files over ``most`` bytes are not read (``too_large``), and neither a
    repeated key nor a number that is none is let through.
    """
    return strict_contents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), most)


def strict_contents(files: DataFrame, most: int = 4 << 20) -> DataFrame:
    """The same of files that lie in a table (path, length, content): many small ones cost neither a listing nor an opening each."""
    whole = F.when(F.col("length") <= most, F.col("content"))
    found = files.select("path", F.col("length").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2(whole, 256)).alias("digest"), _strict(whole).alias("j"))
    return found.select("path", "bytes", "digest", "j.problem", "j.canonical")


# The fields of a manifest and of its items.
MANIFEST, ITEM = ("batch_id", "items"), ("item_id", "source", "digest")


def manifest_items(files: DataFrame) -> DataFrame:
    """path, batch_id, position, item_id, source, digest, problem of the items of strict manifests; a manifest that is none gives one row with its problem.

    An item's id is its batch's alone, its source is a relative path, its digest a sha256; other fields than these are refused.
    """
    shape = "struct<batch_id:string,items:array<struct<item_id:string,source:string,digest:string>>>"
    keys = lambda text, names: F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(n) for n in sorted(names)])
    rows = files.withColumn("m", F.from_json("canonical", shape)).withColumn("raw", F.from_json(F.get_json_object("canonical", "$.items"), "array<string>"))
    whole = F.coalesce(F.col("problem"), F.when(~F.coalesce(keys(F.col("canonical"), MANIFEST), F.lit(False)), "fields"), F.when(F.coalesce(F.col("m.batch_id"), F.lit("")) == "", "batch_id"), F.when(F.coalesce(F.size("m.items"), F.lit(0)) < 1, "items"))
    rows = rows.withColumn("whole", whole)
    bad = rows.filter("whole is not null").select("path", F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("int").alias("position"), *[F.lit(None).cast("string").alias(c) for c in ITEM], F.col("whole").alias("problem"))
    each = rows.filter("whole is null").select("path", "m.batch_id", F.posexplode(F.arrays_zip(F.col("m.items").alias("item"), F.col("raw").alias("raw"))).alias("position", "x"))
    times = each.groupBy("path", F.col("x.item.item_id").alias("again")).agg(F.count("*").alias("times"))
    each = each.join(times, (each["path"] == times["path"]) & F.col("x.item.item_id").eqNullSafe(F.col("again"))).drop(times["path"])
    item = F.col("x.item")
    problem = F.when(~F.coalesce(keys(F.col("x.raw"), ITEM), F.lit(False)), "item_fields").when(F.coalesce(item["item_id"], F.lit("")) == "", "item_id").when(F.col("times") > 1, "item_repeated").when(~F.coalesce(item["source"].rlike(r"^(?!/)(?!.*(^|/)\.\.(/|$))[^\\\x00]+\z"), F.lit(False)), "source").when(~F.coalesce(item["digest"].rlike(r"^sha256:[0-9a-f]{64}\z"), F.lit(False)), "digest")
    return bad.unionByName(each.select("path", "batch_id", "position", "x.item.item_id", "x.item.source", "x.item.digest", problem.alias("problem")))


def tree_scan(files: DataFrame, path: str, content: str, folder: Column) -> DataFrame:
    """folder, files, bytes, flagged, reasons, digest of each folder: what its texts give away, and a digest of all its paths and contents.

    A file's entry is the digest of its path and its content's digest; a folder's digest binds the number, the bytes and the sums of its
    entries (four parts of 64 bits), so tasks add up their own files and no task sees a folder whole. The same file in
    another place is another entry; null contents are empty.
    """
    body = F.coalesce(F.col(content), F.lit(""))
    entry = F.sha2(F.concat(F.col(path), F.lit("\n"), F.sha2(body.cast("binary"), 256)).cast("binary"), 256)
    rows = files.select(folder.alias("folder"), F.octet_length(body).alias("bytes"), entry.alias("entry"), S.flags(body).alias("reasons"))
    part = lambda k: F.sum(F.conv(F.substring("entry", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")).alias(f"s{k}")
    sums = rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"), F.count_if(F.col("reasons") != "").alias("flagged"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("reasons", ","))))), ",").alias("reasons"), *[part(k) for k in range(4)])
    told = F.concat_ws(":", "files", "bytes", *[F.col(f"s{k}").cast("string") for k in range(4)])
    return sums.select("folder", "files", "bytes", "flagged", F.trim(F.col("reasons"), F.lit(",")).alias("reasons"), F.concat(F.lit("sha256:"), F.sha2(told.cast("binary"), 256)).alias("digest"))

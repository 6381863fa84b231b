"""Helpers the operators share: tables in the shared folder, hashes of ids, joins back to documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, return.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; where it is unset,
    a new temporary one in local mode (tests) and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quaymark-")
    return _own[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again. This cuts the
    lineage: what was computed outlives the executors that computed it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_crc(name: str) -> Column:
    """crc32 of the id as text (of the empty text for a null id)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` named by ``kept(id_col, text_sha)``, one for each name, with
    all columns of ``docs``. ``text_sha`` is sha2 of the raw text (null: empty), so null
    or repeated ids stay apart unless the rows are copies of each other."""
    named = kept.select(F.col(id_col).alias("__keep_id"), F.col("text_sha").alias("__keep_sha")).distinct()
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    cols = docs.columns
    out = docs.withColumn("__sha", sha).join(
        named, F.col(id_col).eqNullSafe(F.col("__keep_id")) & (F.col("__sha") == F.col("__keep_sha")), "left_semi"
    )
    if not docs.select(id_col, sha.alias("__sha")).groupBy(id_col, "__sha").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, "__sha"])
    return out.select(*cols)

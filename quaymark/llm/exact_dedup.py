"""Exact dedup by deterministic block naming.

A text (white space deleted) is cut into blocks of a fixed number of characters. The
distinct blocks of the whole corpus are sorted and numbered; a block's number is its
name, so two blocks share a name exactly if they are equal. Adjacent names of a document
are then named in pairs the same way, level by level, until each document has one name.
Two documents are equal exactly if they have the same number of blocks and the same name.

Whole texts are shuffled once, as distinct blocks. Occurrences travel as 64-bit sort
keys; that no two different blocks share a key is proved by counting before names are
given, and if two do, all keys are taken anew from another seed. So no identity rests on
the luck of a hash. Each level is keyed by document and pair, so neither a very long
document nor a large group of copies meets in one task.

Cases: null text is the empty text; empty texts are equal to each other. Null or repeated
ids are separate rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, keep_rows, materialize, read_table

BLOCK = 4096


def _key(block: Column, seed: int, bits: int) -> Column:
    key = F.xxhash64(block, F.lit(seed))
    return key if bits >= 64 else F.pmod(key, F.lit(1 << bits))


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, key_bits: int = 64) -> DataFrame:
    """One row per input row: ``row_id``, id, ``length`` (code points of the original),
    ``text_sha256`` (of the normalised text), ``raw_sha`` (of the original), ``n_blocks``
    and ``name``. ``key_bits`` is for tests, which force keys to clash."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    text = docs.select(F.col(id_col).alias("id"), raw.alias("raw"), F.regexp_replace(raw, WHITE + "+", "").alias("norm"))
    blocks = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block), F.lit(0))
    )
    text = text.withColumn("blocks", blocks)
    bits, seed = key_bits, 0
    while True:
        rows = materialize(
            text.select(
                F.monotonically_increasing_id().alias("row_id"), "id", F.char_length("raw").cast("long").alias("length"),
                F.sha2("norm", 256).alias("text_sha256"), F.sha2("raw", 256).alias("raw_sha"),
                F.size("blocks").alias("n_blocks"),
                F.transform("blocks", lambda b: _key(b, seed, bits)).alias("keys"),
            ),
            "blocks",
        )
        distinct = text.select(F.explode("blocks").alias("block")).select(_key(F.col("block"), seed, bits).alias("key"), "block").distinct()
        # each task sorts its blocks and numbers them; with the task's own range that is a name
        named = distinct.sortWithinPartitions("key", "block").select("key", F.monotonically_increasing_id().alias("name"))
        names = materialize(named.groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("n")), "names")
        if names.filter("n > 1").isEmpty():
            break
        seed, bits = seed + 1, min(64, bits * 2)  # two blocks share a key: all take other keys
    level = rows.select("row_id", "n_blocks", F.posexplode("keys").alias("pos", "key")).join(names.select("key", "name"), "key")
    level = materialize(level.select("row_id", F.col("n_blocks").alias("left"), "pos", "name"), "level")
    done = []
    while True:
        done.append(level.filter("left = 1").select("row_id", "name"))
        more = level.filter("left > 1")
        if more.isEmpty():
            break
        even = F.col("pos") % 2 == 0
        pairs = more.groupBy("row_id", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            F.floor((F.max("left") + 1) / 2).cast("int").alias("left"),
        )
        pairs = materialize(pairs, "pairs")
        named = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id())
        level = materialize(pairs.join(named, ["a", "b"]).select("row_id", "left", "pos", "name"), "level")
    final = done[0]
    for part in done[1:]:
        final = final.unionByName(part)
    return rows.drop("keys").join(final, "row_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, key_bits: int = 64) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``, ``raw_sha``. Of equal texts the one with the most code points stays,
    then the smallest id (null last), then any one of rows that agree in both."""
    named = materialize(name_documents(docs, id_col, text_col, block, key_bits), "named")
    best = F.struct((-F.col("length")).alias("l"), F.col("id").isNull().alias("u"), F.col("id").alias("i"), F.col("row_id").alias("r"))
    # written, so that Spark can split a hot group in the join
    groups = materialize(named.groupBy("n_blocks", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        F.col("id").alias(id_col), F.col("best.i").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("best.r")).alias("kept"), "text_sha256", "raw_sha",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of equal texts stays."""
    kept = exact_dedup(docs).filter("kept").select("doc_id", F.col("raw_sha").alias("text_sha"))
    return keep_rows(docs, kept)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST)
"""

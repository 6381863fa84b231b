"""Reading and writing: tick files, the Parquet lake, provider answers, feeds, archives."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.times import decimal_seconds_ns, local_to_utc

TICK_CSV = "timestamp DECIMAL(30,9), price DOUBLE, volume DOUBLE, type STRING, order_type STRING, misc STRING, trade_id STRING"
ENVELOPE = (
    "source STRING, symbol STRING, channel STRING, messageType STRING, localSequence BIGINT, sequenceKind STRING, providerSequence BIGINT, sessionId STRING, receivedTimeNs BIGINT, "
    "providerTimeNs BIGINT, providerPrecisionDigits SMALLINT, latencyMs DOUBLE, clockSkewDetected BOOLEAN, checksumVerified BOOLEAN, gapReason STRING, payloadJson STRING"
)
EVENT_JSON = "strategy STRING, family STRING, side STRING, costMultiplier DOUBLE, h1Aligned BOOLEAN, entryTimeMs BIGINT, labelEndTimeMs BIGINT, y INT, censored BOOLEAN, status STRING, netR DOUBLE"
BARS_JSON = "symbol STRING, source STRING, timeframe INT, bars ARRAY<STRUCT<time: TIMESTAMP, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: DOUBLE, closed: BOOLEAN>>"


def read_tick_csv(spark: SparkSession, path: str, instrument: str) -> DataFrame:
    """Trades of one instrument from CSV with a fixed schema; empty fields are null. The
    sequence orders rows as the files do (file, then place in it)."""
    raw = spark.read.schema(TICK_CSV).option("nullValue", "").option("header", False).csv(path)
    ns = decimal_seconds_ns(F.col("timestamp"))
    return raw.select(
        F.lit(instrument).alias("instrument"), ns.alias("ns"), F.floor(ns / 1_000_000).cast("long").alias("ms"), F.to_date(F.timestamp_seconds(F.floor(ns / 1_000_000_000))).alias("date"),
        F.monotonically_increasing_id().alias("sequence"), "price", "volume", "type", "order_type", "misc", "trade_id",
    )


def write_lake(ticks: DataFrame, path: str, provider: str = "archive") -> None:
    """Hive-partitioned Parquet by provider, instrument and UTC date. Only the partitions
    that are written are replaced, so a repeated run gives the same lake. Rows are dealt out
    by day and hour, so that a busy day is not one file of one task."""
    hour = F.expr("ns div 3600000000000L")
    rows = ticks.withColumn("provider", F.lit(provider)).repartition("instrument", "date", hour)
    rows.sortWithinPartitions("instrument", "date", "ns", "sequence").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("provider", "instrument", "date").parquet(path)


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per file of a lake: bytes and SHA-256, computed where the file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_manifests(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, change): missing, unknown or modified files."""
    both = expected.select("path", F.col("sha256").alias("old")).join(actual.select("path", F.col("sha256").alias("new")), "path", "full")
    change = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "unknown").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_JSON).json(path)


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """Live capture as JSON lines, in the order of each session."""
    return spark.read.schema(ENVELOPE).json(path)


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """Bars of datasets in JSON (an object, or an array of them)."""
    rows = spark.read.schema(BARS_JSON).option("multiLine", True).json(path)
    return rows.select("symbol", "source", "timeframe", F.inline("bars"))


CHART = (
    "STRUCT<chart: STRUCT<result: ARRAY<STRUCT<meta: STRUCT<symbol: STRING, instrumentType: STRING, dataGranularity: STRING>, timestamp: ARRAY<BIGINT>, "
    "indicators: STRUCT<quote: ARRAY<STRUCT<open: ARRAY<DOUBLE>, high: ARRAY<DOUBLE>, low: ARRAY<DOUBLE>, close: ARRAY<DOUBLE>, volume: ARRAY<DOUBLE>>>>>>>>"
)


def chart_bars(answers: DataFrame, minutes: int = 15, column: str = "json") -> DataFrame:
    """Bars of column-oriented chart answers: arrays are zipped to rows; rows that are
    null, unaligned or inconsistent are left out and counted in ``omitted``."""
    parsed = answers.withColumn("a", F.from_json(column, CHART)).withColumn("r", F.element_at("a.chart.result", 1))
    q = F.element_at(F.col("r.indicators.quote"), 1)
    rows = parsed.withColumn("row", F.explode(F.arrays_zip(
        F.col("r.timestamp").alias("t"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"), q["volume"].alias("volume"))))
    rows = rows.select(F.col("r.meta.symbol").alias("symbol"), "row.*")
    ok = (
        (F.col("t") % (minutes * 60) == 0) & (F.col("open") > 0) & (F.col("low") > 0) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    )
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    omitted = rows.groupBy("symbol").agg(F.count_if(~F.col("ok")).alias("omitted"))
    return rows.filter("ok").drop("ok").join(F.broadcast(omitted), "symbol")  # one row a symbol


SERIES = "STRUCT<meta: STRUCT<symbol: STRING, interval: STRING, exchange_timezone: STRING>, values: ARRAY<STRUCT<datetime: STRING, open: STRING, high: STRING, low: STRING, close: STRING, volume: STRING>>>"


def series_bars(answers: DataFrame, interval: str = "15min", column: str = "json") -> DataFrame:
    """Bars of row-oriented answers with local times; times the zone's clock skipped or
    showed twice are left out."""
    parsed = answers.withColumn("a", F.from_json(column, SERIES)).filter(F.col("a.meta.interval") == interval)
    rows = parsed.select(F.col("a.meta.symbol").alias("symbol"), F.col("a.meta.exchange_timezone").alias("zone"), F.explode("a.values").alias("v"))
    utc = local_to_utc(F.try_to_timestamp("v.datetime"), F.col("zone"))
    return rows.select("symbol", utc.alias("time"), *[F.expr(f"try_cast(v.{c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close", "volume")]).filter("time IS NOT NULL AND open > 0")


def in_sessions(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars inside [start, end) of a session. Sessions are matched through the days they
    touch, an equi-join with a check, not a range join."""
    days = sessions.withColumn("day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    return bars.withColumn("day", F.to_date("time")).join(days, ["symbol", "day"]).filter((F.col("time") >= F.col("start")) & (F.col("time") < F.col("end"))).drop("day", "start", "end")


def news_items(feeds: DataFrame, now, newest: int = 80, days: int = 30, column: str = "xml") -> DataFrame:
    """Items of RSS or Atom texts: no document types, age at most ``days``, one for each
    URL, the newest ``newest`` of each feed."""
    from pyspark.sql import Window

    safe = feeds.filter(~F.col(column).rlike("(?i)<!DOCTYPE"))
    item = F.explode(F.regexp_extract_all(column, F.lit(r"(?is)(<(?:item|entry)\b.*?</(?:item|entry)>)"), F.lit(1)))
    rows = safe.select("feed", item.alias("x"))
    text = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?is)<{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1), "<[^>]*>", " "))
    link = F.coalesce(F.nullif(text("link"), F.lit("")), F.nullif(F.regexp_extract("x", r"""(?is)<link\b[^>]*href=["']([^"']+)""", 1), F.lit("")))
    when = F.coalesce(F.try_to_timestamp(F.nullif(F.substring(text("pubDate"), 6, 20), F.lit("")), F.lit("dd MMM yyyy HH:mm:ss")), F.try_to_timestamp(F.nullif(text("published"), F.lit(""))))
    rows = rows.select("feed", text("title").alias("title"), link.alias("url"), when.alias("published")).filter("title <> '' AND url IS NOT NULL AND published IS NOT NULL")
    rows = rows.filter((F.col("published") <= F.lit(now)) & (F.col("published") >= F.lit(now) - F.expr(f"INTERVAL {days} DAY")))
    one = rows.groupBy("feed", "url").agg(F.max(F.struct("published", "title")).alias("r")).select("feed", "url", "r.*")
    return one.withColumn("n", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("published"), "url"))).filter(F.col("n") <= newest).drop("n")


class _Part(InputPartition):
    def __init__(self, path: str, member: str):
        self.path, self.member = path, member


class ArchiveReader(DataSourceReader):
    """One partition for each CSV member of each archive; a member is read line by line."""

    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.suffix = options.get("suffix", ".csv")

    def partitions(self):
        return [_Part(p, m) for p in self.paths for m in sorted(zipfile.ZipFile(p).namelist()) if m.endswith(self.suffix)]

    def read(self, part):
        with zipfile.ZipFile(part.path) as z, z.open(part.member) as f:
            for k, line in enumerate(f):
                yield part.member, k, line.decode("utf-8").rstrip("\r\n")


class ArchiveLines(DataSource):
    """``spark.read.format("archive_lines").option("paths", "a.zip,b.zip")``: (member, line, text)."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "member STRING, line BIGINT, text STRING"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

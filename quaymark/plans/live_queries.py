"""Queries of live state: the forming bar as a fold, and as a keyed stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources.tables import shared_folder
from ..streaming import forming as W
from ..streaming import live as L
from .queries import HOUR, query, table

#: The events' trades seen by a feed of hourly bars that delivers some messages late.
LATE_STEP, SILENCE = 600_000_000_000, 6 * HOUR


def feed(spark, sf_dir: str) -> DataFrame:
    t = B.ticks_from_events(table(spark, sf_dir, "events")).filter(B.valid_tick())
    return W.updates_of(t, 60, F.col("sequence") % 5 * LATE_STEP)


FORMING = f"""WITH RECURSIVE t AS (SELECT event_type AS instrument, epoch_us(ts) * 1000 AS ns, event_id AS sequence, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events WHERE value > 0),
m AS (SELECT instrument, ns + sequence % 5 * {LATE_STEP} AS at_ns, sequence, ns - ns % {HOUR} AS bucket, first(price) OVER w AS open, max(price) OVER w AS high, min(price) OVER w AS low, price AS close,
  sum(v) OVER w AS volume, count(*) OVER w AS trades FROM t WINDOW w AS (PARTITION BY instrument, ns - ns % {HOUR} ORDER BY ns, sequence ROWS UNBOUNDED PRECEDING)),
n AS (SELECT instrument, at_ns, sequence, struct_pack(bucket := bucket, open := open, high := high, low := low, close := close, volume := volume, trades := trades) AS b,
  row_number() OVER (PARTITION BY instrument ORDER BY at_ns, sequence) AS n FROM m),
f AS (
  SELECT instrument, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS at_ns, CAST(0 AS BIGINT) AS sequence, CAST(0 AS BIGINT) AS closed, CAST(0 AS BIGINT) AS before, CAST(NULL AS STRUCT(bucket BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, trades BIGINT)) AS was,
    CAST(NULL AS STRUCT(bucket BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, trades BIGINT)) AS cur, false AS cut, false AS silent, false AS ends, false AS over, CAST(NULL AS STRUCT(bucket BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, trades BIGINT)) AS b, false AS ok FROM (SELECT DISTINCT instrument FROM n)
  UNION ALL
  SELECT instrument, n, at_ns, sequence, CASE WHEN over THEN b.bucket WHEN ends THEN was.bucket ELSE closed END, before, was, CASE WHEN NOT ok THEN was WHEN b.bucket + {HOUR} <= at_ns THEN NULL ELSE b END, gap AND NOT ok, silent, ends, over, b, ok FROM (
    SELECT *, ok AND b.bucket + {HOUR} <= at_ns AND b.bucket > CASE WHEN ends THEN was.bucket ELSE closed END AS over FROM (
      SELECT *, coalesce(ok AND b.bucket > was.bucket AND NOT gap AND was.bucket + {HOUR} <= at_ns AND was.bucket > closed, false) AS ends FROM (
        SELECT *, b.bucket > closed AND (was IS NULL OR b.bucket >= was.bucket) AND NOT coalesce(b.bucket = was.bucket AND NOT gap AND (b.volume < was.volume OR b.trades < was.trades OR (b.volume = was.volume AND b.trades = was.trades)), false) AS ok FROM (
          SELECT n.instrument, n.n, n.at_ns, n.sequence, f.closed, f.at_ns AS before, f.cur AS was, n.b, f.cur IS NOT NULL AND NOT f.cut AND n.at_ns > f.at_ns + {SILENCE} AS silent,
            f.cut OR (f.cur IS NOT NULL AND n.at_ns > f.at_ns + {SILENCE}) AS gap FROM f JOIN n ON n.instrument = f.instrument AND n.n = f.n + 1))))),
x AS (SELECT instrument, before + {SILENCE} AS at_ns, CAST(NULL AS BIGINT) AS sequence, 'interrupted' AS kind, was AS b FROM f WHERE silent
  UNION ALL SELECT instrument, at_ns, sequence, 'closed', was FROM f WHERE ends UNION ALL SELECT instrument, at_ns, sequence, 'closed', b FROM f WHERE over
  UNION ALL SELECT instrument, at_ns, sequence, 'forming', b FROM f WHERE ok AND b.bucket + {HOUR} > at_ns
  UNION ALL SELECT instrument, at_ns + {SILENCE}, NULL, 'interrupted', cur FROM f WHERE (instrument, n) IN (SELECT (instrument, max(n)) FROM f GROUP BY instrument) AND cur IS NOT NULL AND NOT cut AND at_ns + {SILENCE} < (SELECT max(at_ns) FROM m))
SELECT instrument, at_ns, sequence, kind, b.bucket AS bucket, b.open AS open, b.high AS high, b.low AS low, b.close AS close, b.volume AS volume, b.trades AS trades FROM x"""


@query("r03_forming_bars", FORMING)
def forming_bars(spark, sf_dir):
    return W.fold_bars(feed(spark, sf_dir), 60, SILENCE)


@query("r07_stream_forming_bars", FORMING)
def stream_forming_bars(spark, sf_dir):
    """The same by keyed state. Messages are files of a stream, several to a trigger."""
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    messages = feed(spark, sf_dir)
    messages.repartitionByRange(4, "at_ns").write.parquet(f"{folder}/messages")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/messages")
    with W.keyed_state(spark):
        return L.run_to_table(W.stream_bars(stream, 60, SILENCE, late="0 seconds"), folder)

"""Bars, indicators, rules, labels, statistics and streams against independent arithmetic."""

import inspect
import math
import random
import shutil
import zipfile
from collections import Counter
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quaymark.functions import texts, times
from quaymark.operators import bars as B
from quaymark.operators import features as V
from quaymark.operators import metrics as M
from quaymark.operators import recursive as R
from quaymark.operators import rolling as G
from quaymark.operators import rules as K
from quaymark.operators import resample as H
from quaymark.operators import stats as S
from quaymark.operators import trades as T
from quaymark.plans import queries as Q
from quaymark.sources import imports as I
from quaymark.streaming import live as L

MIN = B.MINUTE


def ticks(spark, rows):
    return spark.createDataFrame(rows, "instrument string, ns long, sequence long, price double, volume double").withColumn("date", F.to_date(F.timestamp_seconds(F.expr("ns div 1000000000L"))))


def wave(n=300, seed=7, step=15):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 0.6, n)) + 4 * np.sin(np.arange(n) / 9)
    open_ = np.append(close[0], close[:-1]) + rng.normal(0, 0.1, n)
    high, low = np.maximum(open_, close) + rng.random(n), np.minimum(open_, close) - rng.random(n)
    return pd.DataFrame({"instrument": "x", "bucket": np.arange(n, dtype=np.int64) * step * MIN, "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 100, n).astype(float), "trades": 1})


# -- bars ----------------------------------------------------------------------------------


def test_four_trades_make_two_bars_and_the_last_bucket_is_open(spark):
    w = 15 * MIN
    t = ticks(spark, [("b", 1, 0, 100.0, 0.2), ("b", 5, 1, 101.0, 0.3), ("b", w + 1, 2, 102.0, 0.4), ("b", 2 * w, 3, 103.0, 1.0)])
    got = B.ohlc(t, 15).orderBy("bucket").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], round(r["volume"], 6)) for r in got] == [(100, 101, 100, 101, 0.5), (102, 102, 102, 102, 0.4)]
    assert B.ohlc(t, 15, completed_only=False).count() == 3


def test_invalid_ticks_do_not_count(spark):
    t = ticks(spark, [("b", 1, 0, -1.0, 1.0), ("b", 2, 1, float("nan"), 1.0), ("b", 3, 2, 5.0, -1.0), ("b", 4, 3, None, 1.0), ("b", 5, 4, 7.0, 0.0)])
    assert B.ohlc(t, 15, False).first()["trades"] == 1
    with pytest.raises(ValueError):
        B.ohlc(t, 7)


def test_nanoseconds_never_round_up_a_bucket(spark):
    rows = spark.createDataFrame([(Decimal("1791935999.999999999"),), (Decimal("1791936000.000000000"),)], "t decimal(30,9)")
    got = [r["b"] for r in rows.select(B.bucket(times.decimal_seconds_ns(F.col("t")), 15).alias("b")).collect()]
    assert got == [1791935100000000000, 1791936000000000000]


def test_coarser_needs_every_slot_and_keeps_null_volume(spark):
    rows = [("x", k * 15 * MIN, 1.0 + k, 2.0 + k, 0.5, 1.5 + k, None if k == 5 else 1.0, 1) for k in range(10) if k != 9]
    b = spark.createDataFrame(rows, "instrument string, bucket long, open double, high double, low double, close double, volume double, trades long")
    got = {r["bucket"]: r for r in B.coarser(b, 60, 15).collect()}
    assert set(got) == {0, 60 * MIN} and got[0]["volume"] == 4.0 and got[60 * MIN]["volume"] is None


def test_quality_counts_gaps(spark):
    b = spark.createDataFrame([("x", k * MIN, 1.0, 2.0, 0.5, 1.5, 1.0, 1) for k in (0, 1, 4, 4)] + [("x", 5 * MIN, 1.0, 0.9, 0.5, 1.5, 1.0, 1)], "instrument string, bucket long, open double, high double, low double, close double, volume double, trades long")
    r = B.quality(b, 1).first()
    assert (r["bars"], r["invalid"], r["duplicates"], r["gaps"], r["missing"], r["status"]) == (5, 1, 1, 1, 2, "invalid")


# -- indicators ------------------------------------------------------------------------------


def test_recursive_values_do_not_change_with_the_future_and_restart_in_the_window():
    b = wave(260)
    full, cut = R.kernel(b), R.kernel(b.iloc[:220])
    for c in ("ema21", "rsi", "supertrend", "sar", "adx", "kama", "stc", "nvi", "prev_ema21"):
        assert np.allclose(full[c][:220], cut[c], equal_nan=True), c
    last = R.kernel(b.iloc[60:220])  # exactly one window
    for c in R.OUT:
        assert np.allclose(full[c].iloc[219], last[c].iloc[159], equal_nan=True, rtol=1e-9), c


def test_a_later_bar_without_volume_does_not_reach_back():
    b = wave(120)
    before = R.kernel(b)
    b.loc[110, "volume"] = np.nan
    after = R.kernel(b)
    for name in ("force", "nvi", "vpt", "adl", "adl_high"):
        assert after[name][:110].equals(before[name][:110]) and after[name][110:].isna().all()


@pytest.mark.parametrize("block", [100, 170, 2048])
def test_recursive_values_do_not_depend_on_blocks(spark, block):
    b = wave(400)
    want = R.kernel(b).sort_values("bucket").reset_index(drop=True)
    got = R.with_recursive(spark.createDataFrame(b), ["rsi", "sar", "prev_ema21"], block).toPandas().sort_values("bucket").reset_index(drop=True)
    assert list(got.columns) == ["instrument", "bucket", "rsi", "sar", "prev_ema21"]
    assert (got["bucket"] == want["bucket"]).all()
    for c in got.columns[2:]:
        assert np.allclose(got[c].astype(float), want[c], equal_nan=True, rtol=1e-12), c


def test_plain_formulas():
    b = wave(160)
    k = R.kernel(b)
    c, h, lo, o = (b[x].to_numpy() for x in ("close", "high", "low", "open"))
    v = c[0]
    for x in c[1:]:
        v = v + (x - v) * 2 / 22
    assert k["ema21"].iloc[-1] == pytest.approx(v)
    gains, losses = np.maximum(np.diff(c), 0), np.maximum(-np.diff(c), 0)
    g, x = gains[:14].mean(), losses[:14].mean()
    for a, d in zip(gains[14:], losses[14:], strict=True):
        g, x = (g * 13 + a) / 14, (x * 13 + d) / 14
    assert k["rsi"].iloc[-1] == pytest.approx(100 - 100 / (1 + g / x))
    assert k["tema"].iloc[-1] == pytest.approx(_tema(c))
    assert k["ema21"].iloc[:59].isna().all()
    assert set(k["sar_way"].dropna()) <= {1.0, -1.0}
    del h, lo, o


def _tema(c):
    e = pd.Series(c).ewm(span=21, adjust=False, min_periods=21).mean()
    e2 = e.ewm(span=21, adjust=False, min_periods=21).mean()
    e3 = e2.ewm(span=21, adjust=False, min_periods=21).mean()
    return (3 * e - 3 * e2 + e3).iloc[-1]


def test_rules_mirror(spark):
    """What buys on bars sells on the bars reflected at a price."""
    b = wave(330)
    m = b.assign(open=200 - b["open"], close=200 - b["close"], high=200 - b["low"], low=200 - b["high"])
    schema = "instrument string, bucket long, open double, high double, low double, close double, volume double, trades long"
    symmetric = [r for r in K.RULES if r.id in {"ema-cross", "macd", "donchian55", "breakout", "inside-bar", "liquidity-sweep", "supertrend", "aroon", "cci-recovery", "stochastic", "fractal-breakout", "nr7-breakout", "engulfing-reclaim", "keltner-reentry", "hma-reclaim", "vortex"}]
    sides = []
    for f in (b, m):
        ctx = K.context(spark.createDataFrame(f, schema), 15)
        rows = ctx.select("bucket", *[K.side(r).alias(r.id) for r in symmetric]).toPandas().sort_values("bucket")
        sides.append(rows.drop(columns="bucket").to_numpy())
    assert np.abs(sides[0]).sum() > 20
    assert (sides[0] == -sides[1]).all()


def test_catalogue_is_complete():
    assert len(K.RULES) == 66 and len({r.id for r in K.RULES}) == 66 and len(K.RESEARCH) == 6
    by_id = {r.id: r for r in K.RULES}
    assert all(id in by_id for ids in (*K.MEMBERS.values(), K.VOLUME_RULES, K.WARMUP) for id in ids)
    assert {f: sum(r.family == f for r in K.RULES) for f in K.MEMBERS} == {f: len(ids) for f, ids in K.MEMBERS.items()}
    assert (by_id["squeeze"].family, by_id["ichimoku"].warmup, by_id["mfi-recovery"].volume, by_id["macd"].family) == ("volatility", 78, True, "trend")


def test_readiness_names_the_first_reason(spark):
    f = wave(150, step=60)
    f = f[f["bucket"] != 70 * 60 * MIN].reset_index(drop=True)  # a gap after 70 bars
    f.loc[139, "volume"] = 0.0
    got = V.readiness(spark.createDataFrame(f), 60).toPandas().set_index(["bucket", "warmup", "volume"])["reason"]
    at = lambda k, w, v: got.loc[(int(f["bucket"][k]), w, v)]
    assert at(58, 60, False) == "insufficient-history" and at(59, 60, True) is None
    assert at(70, 60, False) == "non-contiguous-history" and at(128, 60, False) == "non-contiguous-history" and at(129, 60, False) is None
    assert at(139, 60, True) == "real-volume-required" and at(139, 60, False) is None and at(148, 160, False) == "insufficient-history"


def test_feature_vectors_of_plans(spark):
    market = spark.createDataFrame([("x", 0, *[float(k + 1) for k in range(19)])], "instrument string, bucket long, " + ", ".join(f"{n} double" for n in V.MARKET))
    plan = spark.createDataFrame([("x", 0, "ichimoku", "multi-timeframe", -1, 1.5, 100.0, 104.0, 94.0, 2.0)], "instrument string, bucket long, rule string, family string, way int, net_rr double, entry double, stop double, target double, atr double")
    x = V.trade_features(plan, market, 360).first()["features"]  # entry at 06:00 on a Thursday
    assert len(x) == 116 and x[:19] == [float(k + 1) for k in range(19)] and x[19:24] == [-1.0, 1.5, 2.0, 3.0, 16.0]
    assert x[24:34] == [float(f == "multi-timeframe") for f in K.FAMILIES] and x[34:46] == [-x[k] for k in V.ALIGNED]
    week = 2 * math.pi * 4.25 / 7
    assert np.allclose(x[46:50], [1.0, 0.0, math.sin(week), math.cos(week)]) and x[50:] == [float(r.id == "ichimoku") for r in K.RULES]


# -- labels and selection --------------------------------------------------------------------


def plan_frame(spark, way, stop, target):
    s = spark.createDataFrame([("x", 0, 100.0, 1e6, way, "r", stop, target)], "instrument string, bucket long, entry double, atr double, way int, rule string, stop double, target double")
    return T.plans(s, (0.0,))


def bar_frame(spark, rows):
    return spark.createDataFrame([("x", k * 15 * MIN, *r) for k, r in enumerate(rows)], "instrument string, bucket long, open double, high double, low double, close double")


@pytest.mark.parametrize(
    ("rows", "status", "exit"),
    [
        ([(100, 100, 100, 100), (100, 106, 94, 100)], "stop", 95.0),  # both in one bar: the stop counts
        ([(100, 100, 100, 100), (90, 91, 89, 90)], "stop", 90.0),  # a gap fills at the open
        ([(100, 100, 100, 100), (110, 112, 109, 111)], "target", 105.0),  # the target at its level
        ([(100, 100, 100, 100)] + [(100, 101, 99, 100.5)] * 16, "expired", 100.5),
        ([(100, 100, 100, 100)] + [(100, 101, 99, 100.5)] * 5, "censored", None),
    ],
)
def test_barriers(spark, rows, status, exit):
    b = bar_frame(spark, [tuple(float(x) for x in r) for r in rows])
    p = plan_frame(spark, 1, 95.0, 105.0)
    r = T.label(p, b, 15).first()
    assert r["status"] == status and r["exit"] == exit
    assert r["y"] == {"target": 1, "stop": 0, "expired": 0}.get(status)
    assert T.label_join(p, b, 15).first()["status"] == status if len(rows) > 1 and status != "censored" else True


def test_selection_split_and_walk_forward(spark):
    rows = [("x", "r", 1.0, k * 15 * MIN, (k + 2) * 15 * MIN, 0.1 * (-1) ** k) for k in range(900)]
    t = spark.createDataFrame(rows, "instrument string, rule string, cost double, entry_ns long, label_end_ns long, net_r double")
    assert T.non_overlapping(t, ["rule"]).count() == 300
    assert T.non_overlapping(t, ["rule"], strict=False).count() == 450
    parts = {r["part"]: r["n"] for r in T.purged_split(t, 15).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 448, "validation": 207, "test": 209, "purged": 36}
    assert T.walk_forward(t, 15).filter("part = 'test'").select("fold").distinct().count() == 3


def test_metrics_vectors(spark):
    t = spark.createDataFrame([("a", k, x) for k, x in enumerate([2.0, -1.0, -2.0, 0.5])], "k string, entry_ns long, net_r double")
    m = M.trade_metrics(t, "k").first()
    assert (m["expectancy"], m["drawdown"], m["profit_factor"]) == (-0.125, 3.0, 2.5 / 3)
    p = [r["p_holm"] for r in M.holm(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i int, p double")).orderBy("i").collect()]
    assert p == pytest.approx([0.03, 0.06, 0.06])
    r = {x["bin"]: x for x in M.reliability(spark.createDataFrame([(1, 0.1), (0, 0.199), (1, 1.0)], "y int, probability double")).collect()}
    assert (r[1]["n"], r[1]["rate"], r[9]["n"], r[0]["n"], r[0]["rate"]) == (2, 0.5, 1, 0, None) and len(r) == 10
    ones = spark.createDataFrame([("a", k, 1.0) for k in range(40)], "k string, entry_ns long, net_r double")
    b = S.block_bootstrap(ones, ["k"], reps=999).first()
    assert (b["low"], b["high"], b["mean"]) == (1.0, 1.0, 1.0)


def test_gate_rounds_half_up(spark):
    got = [r["g"] for r in spark.createDataFrame([(0.6004,), (0.6005,), (0.6,)], "p double").select(M.confident(F.col("p")).alias("g")).collect()]
    assert got == [False, True, False]


def test_models_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    for scores in (np.hstack([x, np.ones((300, 1))]) @ S.fit_softmax(x, y, 3), S.discriminant_scores(S.fit_discriminant(x, y, 3), x), S.network_scores(S.fit_network(x, y, 3), x)):
        assert (scores.argmax(axis=1) == y).mean() > 0.75
    a, b = S.fit_platt(np.array([-2.0, -1, 1, 2] * 20), np.array([0, 0, 1, 1, 0, 1, 0, 1] * 10))
    assert a > 0 and abs(b) < 1


def test_tree_scores_follow_missing_and_categories(spark):
    tree = {"split_feature": 0, "threshold": 1.0, "missing_type": "Zero", "default_left": False, "left_child": {"leaf_value": 1.0}, "right_child": {"split_feature": 1, "threshold": "2||4", "decision_type": "==", "left_child": {"leaf_value": 2.0}, "right_child": {"leaf_value": 3.0}}}
    rows = spark.createDataFrame([(0.0, 2.0), (0.5, 9.0), (None, 4.0), (2.0, None)], "a double, b double")
    assert [r["s"] for r in rows.select(S.tree_scores(tree, ["a", "b"]).alias("s")).collect()] == [2.0, 1.0, 2.0, 3.0]


# -- functions and sources -----------------------------------------------------------------------


def test_times(spark):
    ns, digits = times.rfc3339_ns(F.col("t"))
    rows = spark.createDataFrame([("2024-01-01T00:00:00.123456789Z",), ("2024-01-01T01:00:00+01:00",), ("nope",)], "t string").select(ns.alias("n"), digits.alias("d")).collect()
    assert [(r["n"], r["d"]) for r in rows] == [(1704067200123456789, 9), (1704067200000000000, 0), (None, None)]
    local = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",), ("2024-06-01 09:30:00",)], "t string").select(times.local_to_utc(F.to_timestamp("t"), "America/New_York").cast("string").alias("u")).collect()
    assert [r["u"] for r in local] == [None, None, "2024-06-01 13:30:00"]


def test_texts(spark):
    row = spark.createDataFrame([("<p>A &amp; B<script>x</script></p>", "HTTPS://Ex.com/a?utm_source=z&b=1#f", "Hello,  World!", "api_key=abc", "0.00120")], "h string, u string, t string, s string, l string")
    r = row.select(texts.html_to_text(F.col("h")).alias("h"), texts.clean_url(F.col("u")).alias("u"), texts.title_key(F.col("t")).alias("t"), texts.redact(F.col("s")).alias("s"), texts.lexeme_digits(F.col("l")).alias("l")).first()
    assert tuple(r) == ("A & B", "https://ex.com/a?b=1", "hello world", "api_key=***", "120")


def test_lake_round_trip_and_tampering(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text("1704067200.000000001,100.0,1.0,b,l,,1\n1704153600.5,101.0,2.0,s,m,,2\n")
    t = I.read_tick_csv(spark, str(csv), "X")
    I.write_lake(t, str(tmp_path / "lake"))
    back = I.read_lake(spark, str(tmp_path / "lake"))
    assert back.count() == 2 and back.filter("misc IS NULL").count() == 2
    before = I.manifest(spark, str(tmp_path / "lake"))
    first = spark.createDataFrame(before.collect(), before.schema)  # as it was
    assert first.count() == 2
    I.write_lake(t.filter("price > 100").withColumn("price", F.lit(5.0)), str(tmp_path / "lake"))
    changes = [r["change"] for r in I.compare_manifests(first, I.manifest(spark, str(tmp_path / "lake"))).collect()]
    assert set(changes) <= {"missing", "unknown", "modified"} and changes


def test_archive_source(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "a\nb\n")
        z.writestr("two.txt", "c\n")
    spark.dataSource.register(I.ArchiveLines)
    got = spark.read.format("archive_lines").option("paths", str(tmp_path / "a.zip")).load().collect()
    assert [(r["member"], r["line"], r["text"]) for r in got] == [("one.csv", 0, "a"), ("one.csv", 1, "b")]


def test_provider_answers(spark):
    chart = '{"chart":{"result":[{"meta":{"symbol":"S"},"timestamp":[900,1800,1801],"indicators":{"quote":[{"open":[1,2,3],"high":[2,null,4],"low":[1,1,1],"close":[1.5,2,3],"volume":[1,1,1]}]}}]}}'
    rows = I.chart_bars(spark.createDataFrame([(chart,)], "json string")).collect()
    assert [(r["t"], r["omitted"]) for r in rows] == [(900, 2)]
    series = '{"meta":{"symbol":"S","interval":"15min","exchange_timezone":"America/New_York"},"values":[{"datetime":"2024-06-03 09:30:00","open":"1","high":"2","low":"1","close":"1.5","volume":"7"},{"datetime":"2024-03-10 02:30:00","open":"1","high":"2","low":"1","close":"1","volume":"1"}]}'
    assert [str(r["time"]) for r in I.series_bars(spark.createDataFrame([(series,)], "json string")).collect()] == ["2024-06-03 13:30:00"]
    feed = "<rss><item><title>T &lt;b&gt;</title><link>http://a/1</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item><item><title>Old</title><link>http://a/2</link><pubDate>Sun, 01 Jan 2023 00:00:00 GMT</pubDate></item></rss>"
    import datetime

    got = I.news_items(spark.createDataFrame([("f", feed), ("bad", "<!DOCTYPE x>" + feed)], "feed string, xml string"), datetime.datetime(2024, 1, 2)).collect()
    assert [(r["feed"], r["url"]) for r in got] == [("f", "http://a/1")]


# -- streams -------------------------------------------------------------------------------------


def test_book_checksum_and_resets():
    b = L.Book()
    assert b.apply("update", [("bid", "1.0", "1")]) == "no-snapshot"
    assert b.apply("snapshot", [("bid", "0.05", "1.5"), ("ask", "0.06", "2")]) is None
    import zlib

    assert b.checksum() == zlib.crc32(b"6" + b"2" + b"5" + b"15")
    assert b.apply("update", [("bid", "0.07", "1")]) == "crossed" and not b.ready
    assert b.apply("snapshot", [("bid", "0.05", "1")], checksum=1) == "checksum"


def test_streams_equal_batches(spark, tmp_path):
    rows = [("x", k, (k * 37) % 101, k * 1_000_000_000 - (5_000_000_000 if k % 10 == 3 else 0), 1.0 + k % 7) for k in range(60)]
    t = spark.createDataFrame(rows, "instrument string, sequence long, trade_id long, ns long, price double")
    src = str(tmp_path / "in")
    for part in range(3):
        t.filter((F.col("sequence") >= 20 * part) & (F.col("sequence") < 20 * part + 20)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(t.schema).parquet(src)
    got = L.run_to_table(L.stream_ordered_trades(stream), str(tmp_path)).orderBy("sequence").collect()
    want = L.ordered_trades(t).orderBy("sequence").collect()
    assert [r["sequence"] for r in got] == [r["sequence"] for r in want] and got


@pytest.mark.parametrize("layout", ["files", "folder"])
def test_stream_bars_do_not_depend_on_files(spark, tmp_path, layout):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    parts = str(tmp_path / "events.parquet")
    events.withColumn("f", F.pmod(F.xxhash64("event_id"), F.lit(5))).repartition(5, "f").drop("f").write.parquet(parts)
    if layout == "files":
        for k, f in enumerate(sorted((tmp_path / "events.parquet").glob("part-*.parquet"))):
            f.rename(tmp_path / f"events-{k}.parquet")
        shutil.rmtree(parts)
    got = entry.queries()["r01_stream_ohlc"](spark, str(tmp_path))
    cols = ["instrument", "bucket", "open", "high", "low", "close", "volume", "trades"]
    t = B.ticks_from_events(events)
    newest = t.agg(F.max("ns")).first()[0] // 1_000_000 * 1_000_000
    order = F.struct("ns", "sequence")
    want = t.groupBy("instrument", (F.col("ns") - F.col("ns") % (60 * MIN)).alias("bucket")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trades")).filter(F.col("bucket") + 60 * MIN <= newest)
    rows = lambda d: sorted(tuple(r) for r in d.select(*cols).collect())
    assert rows(got) == rows(want) and rows(want)


def test_followed_signals(spark):
    s = spark.createDataFrame([("a", "x", 0, 100, "BUY", 9.0, 11.0), ("b", "x", 0, 50, "BUY", 1.0, 99.0), ("c", "x", 0, 10_000, "SELL", 99.0, 1.0)], "id string, symbol string, reference_ns long, horizon_ns long, side string, stop double, target double")
    q = spark.createDataFrame([("x", 10, 0, 10.0), ("x", 60, 1, 11.5), ("x", 70, 2, 8.0)], "symbol string, ns long, sequence long, price double")
    got = {r["id"]: (r["status"], r["at_ns"]) for r in L.follow_signals(s, q).collect()}
    assert got == {"a": ("target", 60), "b": ("expired", 50), "c": ("watching", None)}


def test_registered_resampling_runs_as_often_as_its_operators(monkeypatch):
    seen = {}
    monkeypatch.setattr(Q, "bracket_trades", lambda spark, sf_dir: None)
    for name in ("block_bootstrap", "moving_blocks", "path_risk"):
        home = H if name == "moving_blocks" else S

        def record(*a, _name=name, _of=inspect.signature(getattr(home, name)), **b):
            call = _of.bind(*a, **b)
            call.apply_defaults()
            seen[_name] = call.arguments.get("reps", call.arguments.get("paths"))

        monkeypatch.setattr(home, name, record)
    for name in ("m02_block_bootstrap", "m03_moving_blocks", "m05_path_risk"):
        entry.queries()[name](None, "")
    assert seen == {"block_bootstrap": 4999, "moving_blocks": 400, "path_risk": 800}


def test_classifier_race_uses_every_component(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(0, 1, 40)] + [float(4 * (k % 3 == c)) for c in range(3)], k % 3) for k in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["model"]: r["accuracy"] for r in entry.queries()["m11_classifier_race"](spark, str(tmp_path)).collect()}
    assert len(got) == 5 and min(got.values()) > 0.9


def test_quantiles_of_ranges_are_those_of_sorted_values(spark):
    rng = random.Random(8)
    rows = [("a", rng.randrange(40) / 4) for _ in range(501)] + [("b", rng.random()) for _ in range(20)] + [("c", 5.0), ("d", None), ("a", None)]
    out = M.quantiles(spark.createDataFrame(rows, "k string, v double"), "v", (0.05, 0.5, 0.95), "k")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "percentile" not in plan and "__part" in plan  # no task holds a key
    got = {r["k"]: r for r in out.collect()}
    for k in "abc":
        x = sorted(v for key, v in rows if key == k and v is not None)
        assert got[k]["n"] == len(x)
        for p in (5, 50, 95):
            at = (len(x) - 1) * p / 100
            low, high = x[math.floor(at)], x[math.ceil(at)]
            assert got[k][f"lower_{p}"] == low and got[k][f"nearest_{p}"] == x[max(math.ceil(len(x) * (p / 100)) - 1, 0)] and got[k][f"linear_{p}"] == pytest.approx(low + (high - low) * (at % 1), abs=1e-12)
    none = M.quantiles(spark.createDataFrame([(1.0,), (2.0,)], "v double").limit(0), "v").collect()
    assert len(none) == 1 and none[0]["n"] == 0 and none[0]["linear_50"] is None


@pytest.mark.parametrize("ids", [list(range(100)), [5] * 50 + [None] * 7 + list(range(40)), [None] * 9 + [1], [3], [1, 2]])
def test_segments_are_cut_by_place(spark, ids):
    rows = [(v, k % 10 / 10, k % 2) for k, v in enumerate(ids)]
    out = M.segments(spark.createDataFrame(rows, "id long, probability double, y int"), "id")
    assert len(set(ids)) < len(ids) or "Window" not in out._jdf.queryExecution().analyzed().toString()  # no task holds all rows
    n = len(ids)
    want = Counter(sum(r >= n * i // 3 for i in (1, 2)) for r in range(n))
    assert {r["segment"]: r["n"] for r in out.collect()} == want


# -- the entry -----------------------------------------------------------------------------------


def test_plans_of_trade_features_stay_small(spark):
    # the rules of all signals would be put into every use of a plan's columns, and fill the driver
    plan = entry.queries()["v116_trade_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "Join" in plan and "Generate" not in plan and "Window" not in plan


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["a01_ohlc_60m", "i10_stochastic", "i07_rsi", "j05_barrier_labels", "a17_quantiles", "d16_title_key", "r01_stream_ohlc", "q11_history_merge", "r13_followed_signals", "a07_follow_status_counts", "i08_macd", "i09_supertrend", "i11_adx", "i15_parabolic_sar", "i23_kama", "i49_tema_zlema", "i54_force", "i56_volume_indices", "p08_readiness", "v19_market_features", "i36_patterns", "r03_forming_bars", "q01_non_overlapping", "q02_window_trades", "q05_selection_split", "q04_purged_split", "p14_forbidden_fields", "p15_journal_faults", "d20_number_lexemes"])
def test_queries_match_their_sql(spark, name):
    import duckdb
    import os

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)
    mine = sorted([str([plain(v) for v in r]) for r in got.select(*cols).collect()])
    theirs = sorted([str([plain(v) for v in r]) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()])
    assert mine == theirs


# -- answers that must follow plain loops -----------------------------------------------------


def plain_bars(n=80, gap=60):
    rng, price, out = random.Random(4), 100.0, []
    for k in range(n):
        move = rng.uniform(-1, 1)
        open_, close = price, price + move
        step = k + (3 if k >= gap else 0)  # three bars are missing
        out.append(("x", step * 3_600_000_000_000, open_, max(open_, close) + rng.random(), min(open_, close) - rng.random(), close, rng.uniform(1, 9)))
        price = close
    return out


def test_rolling_indicators_match_plain_loops(spark):
    rows, hour = plain_bars(), 3_600_000_000_000
    bars = spark.createDataFrame(rows, "instrument string, bucket long, open double, high double, low double, close double, volume double")
    bars = bars.withColumn("step_ok", F.expr(f"bucket - lag(bucket) OVER (PARTITION BY instrument ORDER BY bucket) = {hour}"))
    wanted = ["mfi", "fractal_high", "failed_high", "retest_low", "nr7", "sma20", "efficiency"]
    got = {r["bucket"]: r for r in G.rolling(bars).select("bucket", *wanted).collect()}
    for k in range(40, len(rows)):
        r, t = got[rows[k][1]], [(x[3] + x[4] + x[5]) / 3 for x in rows]
        joined = lambda n: all(rows[i][1] - rows[i - 1][1] == hour for i in range(k - n + 2, k + 1))  # noqa: B023, E731
        up = sum(t[i] * rows[i][6] for i in range(k - 13, k + 1) if t[i] > t[i - 1])
        down = sum(t[i] * rows[i][6] for i in range(k - 13, k + 1) if t[i] < t[i - 1])
        assert r["mfi"] == pytest.approx(100 * up / (up + down))
        five = [rows[i][3] for i in range(k - 5, k)]
        pivot = five[2] if joined(6) and all(five[2] > h for i, h in enumerate(five) if i != 2) else None
        assert r["fractal_high"] == pivot
        assert r["failed_high"] == (max(rows[i][3] for i in range(k - 21, k - 1)) if joined(22) else None)
        assert r["retest_low"] == (min(rows[i][4] for i in range(k - 22, k - 2)) if joined(23) else None)
        span = lambda i: rows[i][3] - rows[i][4]
        assert bool(r["nr7"]) == (joined(7) and all(span(k) < span(i) for i in range(k - 6, k)))
        assert r["sma20"] == pytest.approx(sum(rows[i][5] for i in range(k - 19, k + 1)) / 20)
        path = sum(abs(rows[i][5] - rows[i - 1][5]) for i in range(k - 9, k + 1))
        assert r["efficiency"] == pytest.approx(abs(rows[k][5] - rows[k - 10][5]) / path)


def test_opening_range_is_not_known_before_the_first_hour_ends(spark):
    hour = 3_600_000_000_000
    bars = spark.createDataFrame([("x", k * hour, 1.0, 10.0 + k, 1.0 + k, 2.0) for k in range(48)], "instrument string, bucket long, open double, high double, low double, close double")
    got = {r["bucket"] // hour: (r["opening_high"], r["previous_day_high"]) for r in B.daily_levels(bars, 60).collect()}
    assert {k: v[0] for k, v in got.items() if v[0] is not None} == {1: 10.0, 2: 10.0, 3: 10.0, 25: 34.0, 26: 34.0, 27: 34.0}
    assert got[30][1] == 33.0 and got[3][1] is None


def test_week_cycle_moves_within_the_day(spark):
    ms = 3 * 86_400_000 + 6 * 3_600_000 + 30 * 60_000 + 59_999  # a Sunday, 06:30
    c = times.cycles(F.col("ms"))
    r = spark.createDataFrame([(ms,)], "ms long").select(*[x.alias(f"c{k}") for k, x in enumerate(c)]).first()
    day, week = 2 * math.pi * 6.5 / 24, 2 * math.pi * (6 / 24 + 30 / 1440) / 7
    assert list(r) == pytest.approx([math.sin(day), math.cos(day), math.sin(week), math.cos(week)])


def test_news_keeps_the_newest_of_each_url_or_title(spark):
    rng = random.Random(9)
    items = [(k, f"https://n.example/{rng.randrange(25)}", f"Title {rng.randrange(25)}!", rng.randrange(40)) for k in range(120)] + [(500, "not a url", "t", 99)]
    urls, titles, want = set(), set(), set()
    for i, u, t, _ in sorted((x for x in items if x[0] < 500), key=lambda x: (-x[3], x[0])):
        if u not in urls and t not in titles:
            urls.add(u)
            titles.add(t)
            want.add(i)
    got = texts.dedupe_news(spark.createDataFrame(items, "id long, url string, title string, published long"))
    assert {r["id"] for r in got.collect()} == want and got.columns == ["id", "url", "title", "published"]
    assert texts.dedupe_news(spark.createDataFrame([], "id long, url string, title string, published long")).count() == 0


def test_quotes_of_streams_are_stale_sooner(spark):
    rows = [("a", 70.0, "websocket"), ("b", 70.0, "rest"), ("c", 120.0, "import"), ("d", 29.0, "websocket")]
    q = spark.createDataFrame([(s, int((200 - age) * 1e9), 1.0, 1.1, t) for s, age, t in rows], "symbol string, ns long, bid double, ask double, transport string")
    assert {r["symbol"]: r["state"] for r in L.market_health(q, F.lit(200 * 10**9)).collect()} == {"a": "stale", "b": "snapshot", "c": "stale", "d": "live"}

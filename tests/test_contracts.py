"""Forbidden fields by their paths, journals by their arithmetic, numbers by their characters."""

import json
from collections import Counter

import __spark_entry__ as entry
import duckdb
from pyspark.sql import functions as F

from quaymark.operators import contracts as C


def test_forbidden_fields_of_any_depth(spark):
    rows = [
        (1, '{"a": {"b": [{"token": 1}, [{"entry": {"bars": []}}]]}, "positions": null}'), (2, '{"a": "token", "b": ["entry"]}'), (3, "[1, 2]"), (4, "7"), (5, "no json"), (6, None), (7, '{"token ": 1, "Token": 2}'), (8, "{}"),
    ]
    t = spark.createDataFrame(rows, "id int, json string")
    got = {(r["id"], r["path"]) for r in C.forbidden_fields(t, "id").collect()}
    assert got == {(1, "$.a.b[0].token"), (1, "$.a.b[1][0].entry"), (1, "$.a.b[1][0].entry.bars"), (1, "$.positions"), (5, None), (6, None)}
    assert C.forbidden_fields(t.limit(0), "id").count() == 0


def test_numbers_keep_their_characters(spark):
    rows = ['{"p":0.10,"q":[1e-8,-5,"1.50","a\\"2\\""],"n":-0.0}', '{"a":"x-1","b":100}', '{"e":2E+3}', "[]", '"unclosed 1', None]
    got = [r["j"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string").orderBy("k").select(C.quoted_numbers(F.col("v")).alias("j")).collect()]
    assert json.loads(got[0]) == {"p": "0.10", "q": ["1e-8", "-5", "1.50", 'a"2"'], "n": "-0.0"}
    assert json.loads(got[1]) == {"a": "x-1", "b": "100"} and json.loads(got[2]) == {"e": "2E+3"} and got[3] == "[]" and got[5] is None


def test_plain_decimals(spark):
    cases = {"0010.500": "10.5", "1e-8": "0.00000001", "1.25e1": "12.5", "12e3": "12000", "0": "0", "000": "0", "5.0": "5", "1.5E+0": "1.5", "-1": None, "1e51": None, "": None, "x": None, "0.0e2": "0"}
    t = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["p"] for r in t.select("v", C.plain_decimal(F.col("v")).alias("p")).collect()} == cases


def test_journal_faults_in_order(spark):
    entry, stop, bps = 100.0, 98.0, 2.0
    exit_stop = stop * (1 - bps / 10000)
    risk = entry - exit_stop + (entry + exit_stop) * bps / 10000
    pnl = (103.0 - entry - (entry + 103.0) * bps / 10000) * 2
    good = {"side": "BUY", "status": "closed", "entry": entry, "stop": stop, "target": 104.0, "quantity": 2.0, "net_risk": risk, "fee_bps": bps, "slippage_bps": bps, "opened_ns": 5, "closed_ns": 6, "exit": 103.0, "pnl": pnl}
    cases = [
        ({}, None), ({"status": "open", "exit": None, "pnl": None, "closed_ns": None}, None), ({"side": "LONG"}, "position"), ({"side": None}, "position"), ({"quantity": 0.0}, "position"), ({"entry": float("nan")}, "position"), ({"stop": 101.0}, "levels"),
        ({"target": 99.0}, "levels"), ({"quantity": 11.0}, "notional"), ({"quantity": 6.0}, "exposure"), ({"net_risk": risk * (1 + 1e-6)}, "risk"), ({"net_risk": risk * (1 + 1e-10)}, None), ({"closed_ns": 4}, "closing"), ({"pnl": None}, "closing"), ({"pnl": pnl + 1e-6}, "result"),
    ]
    rows = [(k, *{**good, **change}.values()) for k, (change, _) in enumerate(cases)]
    t = spark.createDataFrame(rows, "id int, side string, status string, entry double, stop double, target double, quantity double, net_risk double, fee_bps double, slippage_bps double, opened_ns long, closed_ns long, exit double, pnl double")
    got = [r["fault"] for r in C.journal_faults(t, F.lit(1000.0)).orderBy("id").collect()]
    assert got == [fault for _, fault in cases]


def test_journal_query_has_the_limits_of_its_sql(spark, tmp_path):
    # 59523.81 x 42 is 250.000002 of the 250 allowed; sound, tampered and closed orders beside it
    rows = [(k, 1, q, price, flag, status) for k in range(5) for q, price in ((42.0, 59523.81), (25.0, 100000.0), (3.0, 2000.0)) for flag in "NR" for status in "FO"]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = Counter(con.execute(entry.oracle_sql()["p15_journal_faults"]).fetchall())
    assert Counter(map(tuple, entry.queries()["p15_journal_faults"](spark, str(tmp_path)).collect())) == want
    assert sum(n for r, n in want.items() if r[2] == "notional") == 16


def test_reports_are_read_once(spark):
    t = spark.createDataFrame([(1, '{"a": {"token": 1}}'), (2, "no json"), (3, "null"), (4, '[[{"b": [1, {"entry": 2}]}], {"b": {"c": "x"}}, 5]'), (5, '{"a": [{"b": {"bars": 1}}, {"b": 2}]}')], "id int, json string")
    found = C.forbidden_fields(t, "id")
    assert "parse_json" not in found._jdf.queryExecution().analyzed().toString()
    assert {(r["id"], r["path"]) for r in found.collect()} == {(1, "$.a.token"), (2, None), (4, "$[0][0].b[1].entry"), (5, "$.a[0].b.bars")}

"""Checks of what is published or imported: forbidden fields, journals, exact numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .trades import round_trip_fee

#: Fields that no published report holds (fixed values).
FORBIDDEN = "examples bars entryTimeMs labelEndTimeMs entry stopPrice targetPrice positions token password apiKey".split()
#: Relative difference up to which recomputed amounts agree (fixed value).
TOLERANCE = 1e-8


def forbidden_fields(reports: DataFrame, key: str, column: str = "json", names: list[str] | None = None) -> DataFrame:
    """(key, path): every forbidden field of any depth, by its place. Reports have no common
    schema, so they are walked as variants, all reports one level a round; text that is no JSON
    has the path ``null``."""
    names = FORBIDDEN if names is None else names

    def kept(rows: DataFrame) -> DataFrame:
        """Written once a level: the fields found and what has fields of its own."""
        more = F.coalesce(F.substring(F.schema_of_variant("v"), 1, 5).isin("OBJEC", "ARRAY"), F.lit(False))
        return written(rows.withColumn("more", more).filter("hit OR more").withColumn("v", F.expr("CASE WHEN more THEN v END")), "fields")

    read = reports.select(F.col(key).alias("k"), F.try_parse_json(column).alias("v"))
    level = kept(read.select("k", F.when(F.col("v").isNotNull(), F.lit("$")).alias("path"), "v", F.col("v").isNull().alias("hit")))
    found = []
    while True:
        found.append(level.filter("hit").select("k", "path"))
        inner = level.filter("more")
        if inner.isEmpty():
            break
        inner.createOrReplaceTempView("__variants")
        each = reports.sparkSession.sql("SELECT k, path, e.pos, e.key AS name, e.value AS v FROM __variants, LATERAL variant_explode(v) e")
        place = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), "name"))
        level = kept(each.select("k", place.alias("path"), "v", F.coalesce(F.col("name").isin(*names), F.lit(False)).alias("hit")))
    return reduce(DataFrame.unionByName, found).select(F.col("k").alias(key), "path")


def differs(a: Column, b: Column) -> Column:
    return F.abs(a - b) > TOLERANCE * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def journal_faults(positions: DataFrame, capital: Column, most_risk: float = 0.01, tolerance: float = TOLERANCE) -> DataFrame:
    """``positions`` (id, side, status, entry, stop, target, quantity, net_risk, fee_bps,
    slippage_bps, opened_ns, closed_ns, exit, pnl) with the first ``fault`` of each, null for
    sound ones: amounts that are not positive, levels on the wrong side, a notional over the
    capital, an open risk over its share, a risk or a result that does not follow from the
    prices and costs, a closing before the opening. The notional and the open risk may pass their
    limits by ``tolerance`` of the capital."""
    way = F.when(F.col("side") == "BUY", 1).when(F.col("side") == "SELL", -1)
    fine = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    positive = reduce(lambda a, b: a & b, [fine(c) for c in ("entry", "stop", "target", "quantity", "net_risk")])
    slack = tolerance * F.greatest(F.lit(1.0), capital)
    exit_stop = F.col("stop") * (1 - way * F.col("slippage_bps") / 10000)
    risk = way * (F.col("entry") - exit_stop) + round_trip_fee(F.col("entry"), exit_stop, F.col("fee_bps"))
    result = (way * (F.col("exit") - F.col("entry")) - round_trip_fee(F.col("entry"), F.col("exit"), F.col("fee_bps"))) * F.col("quantity")
    closed = F.col("status") == "closed"
    fault = (
        F.when(way.isNull() | ~F.coalesce(F.col("status").isin("open", "closed"), F.lit(False)) | ~positive, "position")
        .when((way * (F.col("entry") - F.col("stop")) <= 0) | (way * (F.col("target") - F.col("entry")) <= 0), "levels")
        .when(F.col("entry") * F.col("quantity") > capital + slack, "notional")
        .when(F.col("net_risk") * F.col("quantity") > capital * most_risk + slack, "exposure")
        .when((risk <= 0) | differs(F.col("net_risk"), risk), "risk")
        .when(closed & ~F.coalesce(fine("exit") & F.col("pnl").isNotNull() & (F.col("closed_ns") >= F.col("opened_ns")), F.lit(False)), "closing")
        .when(closed & differs(F.col("pnl"), result), "result")
    )
    return positions.withColumn("fault", fault)


_TOKENS = r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|[-"]'


def quoted_numbers(json: Column) -> Column:
    """JSON with every number as a string of its own characters (strings stay as they are), so
    that parsing keeps the zeros a checksum is made of."""
    tokens = F.regexp_extract_all(json, F.lit(_TOKENS), F.lit(0))
    number = lambda t: t.rlike(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$")
    return F.array_join(F.transform(tokens, lambda t: F.when(number(t), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)), "")


def plain_decimal(lexeme: Column) -> Column:
    """A number's characters without exponent, leading zeros and trailing zeros of its fraction;
    null for anything else or an exponent beyond 50."""
    shape = r"^(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d{1,3}))?$"
    part = lambda k: F.regexp_extract(lexeme, shape, k)
    digits, move = F.concat(part(1), part(2)), F.coalesce(F.when(part(3) != "", part(3).cast("int")), F.lit(0))
    point, size = F.length(part(1)) + move, F.length(F.concat(part(1), part(2)))
    whole = F.when(point <= 0, F.lit("0")).when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size))).otherwise(F.substring(digits, F.lit(1), point))
    rest = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).when(point >= size, F.lit("")).otherwise(F.substring(digits, point + 1, size))
    whole, rest = F.regexp_replace(whole, r"^0+(?=\d)", ""), F.regexp_replace(rest, "0+$", "")
    return F.when(lexeme.rlike(shape) & (F.abs(move) <= 50), F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise("")))

"""SQL for the recursive indicators, written apart from their numpy form.

Each bar's window ``x`` is a list of structs (o, h, l, c, v), oldest first. A recursion is a
fold over a list whose first element is the seed and whose others carry the inputs; ``s`` is
the state so far, ``e`` the next element. What a step computes first (``let``) is written into
the expressions that use it.
"""

from __future__ import annotations

import re


def inlined(lets: dict[str, str], out: dict[str, str]) -> dict[str, str]:
    """``out`` with the names of ``lets`` replaced by their expressions, later ones first."""
    for name, sql in reversed(lets.items()):
        lets = {k: re.sub(rf"\b{name}\b", f"({sql})", v) if k != name else v for k, v in lets.items()}
        out = {k: re.sub(rf"(?<![.\w]){name}\b(?!\s*:)", f"({sql})", v) for k, v in out.items()}
    return out


def packed(fields: dict[str, str]) -> str:
    return "struct_pack(" + ", ".join(f"{k} := CAST({v} AS DOUBLE)" for k, v in fields.items()) + ")"


def fold(seed: dict[str, str], start: int, inputs: dict[str, str], lets: dict[str, str], step: dict[str, str]) -> str:
    """The last state of a fold: ``seed`` holds at bar ``start`` of the window, ``inputs`` are
    read at each bar ``i`` after it (``x[i]``), ``step`` gives the next state."""
    none = {k: "0" for k in step}
    first = packed({**{k: "0" for k in inputs}, **none, **seed})
    rest = packed({**inputs, **none})
    new = inlined(dict(lets), step)
    body = packed({**{k: "0" for k in inputs}, **new})
    return f"list_reduce(list_prepend({first}, list_transform(range({start + 1}, len(x) + 1), lambda i: {rest})), lambda s, e: {body})"


def mean(of: str, was: str, n: int) -> str:
    return f"{was} + ({of} - {was}) * {2 / (n + 1)!r}"


TR = "CASE WHEN {i} = 1 THEN greatest(x[1].h - x[1].l, abs(x[1].h - x[1].o), abs(x[1].l - x[1].o)) ELSE greatest(x[{i}].h - x[{i}].l, abs(x[{i}].h - x[{i} - 1].c), abs(x[{i}].l - x[{i} - 1].c)) END"
C = {"c": "x[i].c"}
RANGES = f"list_transform(range(1, len(x) + 1), lambda i: {TR.format(i='i')})"


def true_range_mean(n: int) -> str:
    return fold({"a": f"list_avg({RANGES}[1:{n}])"}, n, {"r": TR.format(i="i")}, {}, {"a": f"(s.a * {n - 1} + e.r) / {n}"})


def moved(name: str) -> str:
    """Directional movement at bar i: of highs (plus) or of lows (minus)."""
    up, down = "(x[i].h - x[i - 1].h)", "(x[i - 1].l - x[i].l)"
    a, b = (up, down) if name == "plus" else (down, up)
    return f"CASE WHEN {a} > {b} AND {a} > 0 THEN {a} ELSE 0 END"


def early(what: str) -> str:
    """Mean over bars 2 to 15."""
    return f"list_avg(list_transform(range(2, 16), lambda i: {what}))"


DX = "CASE WHEN {t} > 0 AND 100 * {p} / {t} + 100 * {m} / {t} > 0 THEN 100 * abs(100 * {p} / {t} - 100 * {m} / {t}) / (100 * {p} / {t} + 100 * {m} / {t}) ELSE 0 END"
MEDIAN = "list_transform(x[i - 9:i], lambda r: (r.h + r.l) / 2)"
PLACE = f"CASE WHEN list_max({MEDIAN}) > list_min({MEDIAN}) THEN ((x[i].h + x[i].l) / 2 - list_min({MEDIAN})) / (list_max({MEDIAN}) - list_min({MEDIAN})) - 0.5 ELSE 0 END"
PATH = "list_sum(list_transform(range(i - 9, i + 1), lambda j: abs(x[j].c - x[j - 1].c)))"
HIGH5, LOW5 = "list_max(list_transform(x[i - 4:i], lambda r: r.h))", "list_min(list_transform(x[i - 4:i], lambda r: r.l))"
_smi = {"p": f"x[i].c - ({HIGH5} + {LOW5}) / 2", "q": f"{HIGH5} - {LOW5}"}
_at5 = {k: v.replace("x[i - 4:i]", "x[1:5]").replace("x[i]", "x[5]") for k, v in _smi.items()}
FLOW = "CASE WHEN x[i].h > x[i].l THEN ((x[i].c - x[i].l) - (x[i].h - x[i].c)) / (x[i].h - x[i].l) * x[i].v ELSE 0 END"
GROWTH = "(x[i].c - x[i - 1].c) / x[i - 1].c"
TRADED = "list_min(list_transform(x, lambda r: coalesce(r.v, 0))) > 0"

#: Digits of columns whose values, products over the window, go beyond 1e15 (all others: 6).
ROUND = {"nvi": -6, "nvi_signal": -6}

#: indicator -> (folds by name, output columns over the folds' states).
FOLDS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "i08_macd": ({"s": fold({"f": "x[1].c", "w": "x[1].c"}, 1, C, {"nf": mean("e.c", "s.f", 12), "nw": mean("e.c", "s.w", 26)}, {"f": "nf", "w": "nw", "g": mean("(nf - nw)", "s.g", 9)})}, {"macd": "s.f - s.w", "macd_signal": "s.g"}),
    "i24_ppo": ({"s": fold({"f": "x[1].c", "w": "x[1].c"}, 1, C, {"nf": mean("e.c", "s.f", 12), "nw": mean("e.c", "s.w", 26)}, {"f": "nf", "w": "nw", "g": mean("(100 * (nf - nw) / nw)", "s.g", 9)})}, {"ppo": "100 * (s.f - s.w) / s.w", "ppo_signal": "s.g"}),
    "i18_trix": (
        {"s": fold({k: "x[1].c" for k in "abd"}, 1, C, {"na": mean("e.c", "s.a", 15), "nb": mean("na", "s.b", 15), "nd": mean("nb", "s.d", 15)}, {"a": "na", "b": "nb", "d": "nd", "t": "100 * (nd / s.d - 1)", "g": mean("(100 * (nd / s.d - 1))", "s.g", 9)})},
        {"trix": "s.t", "trix_signal": "s.g"}),
    "i19_tsi": (
        {"s": fold({}, 1, {"y": "x[i].c - x[i - 1].c"}, {"na": mean("e.y", "s.a", 25), "nb": mean("na", "s.b", 13), "nk": mean("abs(e.y)", "s.k", 25), "nm": mean("nk", "s.m", 13), "nt": "CASE WHEN nm > 0 THEN 100 * nb / nm ELSE 0 END"},
                   {"a": "na", "b": "nb", "k": "nk", "m": "nm", "t": "nt", "g": mean("nt", "s.g", 7)})},
        {"tsi": "s.t", "tsi_signal": "s.g"}),
    "i20_dema": ({"s": fold({"a": "x[1].c", "b": "x[1].c"}, 1, C, {"na": mean("e.c", "s.a", 21)}, {"a": "na", "b": mean("na", "s.b", 21)})}, {"dema": "2 * s.a - s.b"}),
    "i28_elder_ray": ({"s": fold({"a": "x[1].c"}, 1, C, {}, {"a": mean("e.c", "s.a", 13)})}, {"bulls": "x[len(x)].h - s.a", "bears": "x[len(x)].l - s.a"}),
    "i21_chandelier": ({"s": true_range_mean(22)}, {"chandelier_long": "list_max(list_transform(x[len(x) - 21:], lambda r: r.h)) - 3 * s.a", "chandelier_short": "list_min(list_transform(x[len(x) - 21:], lambda r: r.l)) + 3 * s.a"}),
    "i09_supertrend": (
        {"s": fold(
            {"a": f"list_avg({RANGES}[1:10])", "u": f"(x[10].h + x[10].l) / 2 + 3 * list_avg({RANGES}[1:10])", "w": f"(x[10].h + x[10].l) / 2 - 3 * list_avg({RANGES}[1:10])", "d": "-1"}, 10,
            {"r": TR.format(i="i"), "mid": "(x[i].h + x[i].l) / 2", "c": "x[i].c", "before": "x[i - 1].c"},
            {"na": "(s.a * 9 + e.r) / 10", "up": "e.mid + 3 * na", "dn": "e.mid - 3 * na", "nu": "CASE WHEN up < s.u OR e.before > s.u THEN up ELSE s.u END", "nw": "CASE WHEN dn > s.w OR e.before < s.w THEN dn ELSE s.w END"},
            {"a": "na", "u": "nu", "w": "nw", "d": "CASE WHEN s.d < 0 THEN CASE WHEN e.c > nu THEN 1 ELSE -1 END ELSE CASE WHEN e.c < nw THEN -1 ELSE 1 END END"})},
        {"supertrend": "CASE WHEN s.d = 1 THEN s.w ELSE s.u END", "supertrend_way": "s.d"}),
    "i11_adx": (
        {"s": fold(
            {"p": early(moved("plus")), "m": early(moved("minus")), "t": early(TR.format(i="i")), "n": "1", "q": DX.format(p=early(moved("plus")), m=early(moved("minus")), t=early(TR.format(i="i")))}, 15,
            {"plus": moved("plus"), "minus": moved("minus"), "r": TR.format(i="i")},
            {"np": "(s.p * 13 + e.plus) / 14", "nm": "(s.m * 13 + e.minus) / 14", "nt": "(s.t * 13 + e.r) / 14", "dx": DX.format(p="np", m="nm", t="nt")},
            {"p": "np", "m": "nm", "t": "nt", "n": "s.n + 1", "q": "s.q + dx", "adx": "CASE WHEN s.n + 1 < 14 THEN 0 WHEN s.n + 1 = 14 THEN (s.q + dx) / 14 ELSE (s.adx * 13 + dx) / 14 END"})},
        {"adx": "s.adx", "di_plus": "CASE WHEN s.t > 0 THEN 100 * s.p / s.t ELSE 0 END", "di_minus": "CASE WHEN s.t > 0 THEN 100 * s.m / s.t ELSE 0 END"}),
    "i15_parabolic_sar": (
        {"s": fold(
            {"z": "CASE WHEN x[2].c > x[1].c THEN least(x[1].l, x[2].l) ELSE greatest(x[1].h, x[2].h) END", "k": "CASE WHEN x[2].c > x[1].c THEN greatest(x[1].h, x[2].h) ELSE least(x[1].l, x[2].l) END", "v": "0.02", "d": "CASE WHEN x[2].c > x[1].c THEN 1 ELSE -1 END"}, 2,
            {"h": "x[i].h", "l": "x[i].l", "h1": "greatest(x[i - 1].h, x[i - 2].h)", "l1": "least(x[i - 1].l, x[i - 2].l)"},
            {"z1": "s.z + s.v * (s.k - s.z)", "z2": "CASE WHEN s.d > 0 THEN least(z1, e.l1) ELSE greatest(z1, e.h1) END", "turn": "CASE WHEN s.d > 0 THEN e.l < z2 ELSE e.h > z2 END", "far": "NOT turn AND CASE WHEN s.d > 0 THEN e.h > s.k ELSE e.l < s.k END"},
            {"z": "CASE WHEN turn THEN CASE WHEN s.d > 0 THEN greatest(s.k, e.h) ELSE least(s.k, e.l) END ELSE z2 END", "d": "CASE WHEN turn THEN -s.d ELSE s.d END",
             "k": "CASE WHEN turn THEN CASE WHEN s.d > 0 THEN e.l ELSE e.h END WHEN far THEN CASE WHEN s.d > 0 THEN e.h ELSE e.l END ELSE s.k END", "v": "CASE WHEN turn THEN 0.02 WHEN far THEN least(0.2, s.v + 0.02) ELSE s.v END"})},
        {"sar": "s.z", "sar_way": "s.d"}),
    "i16_fisher": (
        {"s": fold({}, 9, {"place": PLACE}, {"raw": "0.66 * e.place + 0.67 * s.y", "ny": "CASE WHEN raw > 0.99 THEN 0.999 WHEN raw < -0.99 THEN -0.999 ELSE raw END"}, {"y": "ny", "f": "0.5 * ln((1 + ny) / (1 - ny)) + 0.5 * s.f"})},
        {"fisher": "s.f"}),
    "i23_kama": (
        {"s": fold({"a": "list_avg(list_transform(x[1:10], lambda r: r.c))"}, 10, {"c": "x[i].c", "er": f"CASE WHEN {PATH} > 0 THEN abs(x[i].c - x[i - 10].c) / {PATH} ELSE 0 END"}, {}, {"a": f"s.a + pow(e.er * ({2 / 3!r} - {2 / 31!r}) + {2 / 31!r}, 2) * (e.c - s.a)"})},
        {"kama": "s.a"}),
    "i26_smi": (
        {"s": fold({"p1": _at5["p"], "p2": _at5["p"], "q1": _at5["q"], "q2": _at5["q"], "g": f"CASE WHEN {_at5['q']} > 0 THEN 200 * ({_at5['p']}) / ({_at5['q']}) ELSE 0 END"}, 5, _smi,
                   {"n1": mean("e.p", "s.p1", 3), "n2": mean("n1", "s.p2", 3), "m1": mean("e.q", "s.q1", 3), "m2": mean("m1", "s.q2", 3), "now": "CASE WHEN m2 > 0 THEN 200 * n2 / m2 ELSE 0 END"},
                   {"p1": "n1", "p2": "n2", "q1": "m1", "q2": "m2", "g": mean("now", "s.g", 3)})},
        {"smi": "CASE WHEN s.q2 > 0 THEN 200 * s.p2 / s.q2 ELSE 0 END", "smi_signal": "s.g"}),
    "i49_tema_zlema": (
        {"s": fold({"a": "x[1].c"}, 1, {"c": "x[i].c", "n": "i"}, {"na": mean("e.c", "s.a", 21), "nb": f"CASE WHEN e.n <= 21 THEN na ELSE {mean('na', 's.b', 21)} END"}, {"a": "na", "b": "nb", "d": f"CASE WHEN e.n <= 41 THEN nb ELSE {mean('nb', 's.d', 21)} END"}),
         "z": fold({"a": "2 * x[11].c - x[1].c"}, 11, {"y": "2 * x[i].c - x[i - 10].c"}, {}, {"a": mean("e.y", "s.a", 21)})},
        {"tema": "CASE WHEN len(x) >= 61 THEN 3 * s.a - 3 * s.b + s.d END", "zlema": "z.a"}),
    "i54_force": ({"s": fold({"a": "(x[2].c - x[1].c) * x[2].v"}, 2, {"y": "(x[i].c - x[i - 1].c) * x[i].v"}, {}, {"a": mean("e.y", "s.a", 13)})}, {"force": f"CASE WHEN {TRADED} THEN s.a END"}),
    "i56_volume_indices": (
        {"s": fold({"n": "1000", "y": "CASE WHEN x[1].h > x[1].l THEN ((x[1].c - x[1].l) - (x[1].h - x[1].c)) / (x[1].h - x[1].l) * x[1].v ELSE 0 END"}, 1, {"gr": GROWTH, "less": "CASE WHEN x[i].v < x[i - 1].v THEN 1 ELSE 0 END", "vol": "x[i].v", "flow": FLOW}, {},
                   {"n": "s.n * (1 + e.less * e.gr)", "p": "s.p + e.vol * e.gr", "y": "s.y + e.flow"})},
        {"nvi": f"CASE WHEN {TRADED} THEN s.n END", "vpt": f"CASE WHEN {TRADED} THEN s.p END", "adl": f"CASE WHEN {TRADED} THEN s.y END"}),
    "i57_volume_signals": (
        {"s": fold({"n": "1000", "m": "1000"}, 1, {"gr": GROWTH, "less": "CASE WHEN x[i].v < x[i - 1].v THEN 1 ELSE 0 END", "vol": "x[i].v"}, {"nn": "s.n * (1 + e.less * e.gr)", "np": "s.p + e.vol * e.gr"},
                   {"n": "nn", "m": mean("nn", "s.m", 21), "p": "np", "q": mean("np", "s.q", 21)}),
         "l": f"list_transform(range(1, len(x) + 1), lambda i: {FLOW})"},
        {"nvi_signal": f"CASE WHEN {TRADED} THEN s.m END", "vpt_signal": f"CASE WHEN {TRADED} THEN s.q END",
         **{f"adl_{side}": f"CASE WHEN {TRADED} THEN list_{how}(list_transform(range(len(x) - 20, len(x)), lambda j: list_sum(l[1:j]))) END" for side, how in (("high", "max"), ("low", "min"))}}),
}


def recursive_sql(name: str, bars: str, columns: list[str], window: int = 160, minimum: int = 60) -> str:
    """SQL of an indicator's columns and their ``prev_`` values: the same over the window
    without its last bar. ``bars`` is the text that defines ``bars``."""
    folds, out = FOLDS[name]
    shown = ", ".join(f"max(round({c}, {ROUND.get(c, 6)})) FILTER (WHERE k = 0) AS {c}, max(round({c}, {ROUND.get(c, 6)})) FILTER (WHERE k = 1) AS prev_{c}" for c in columns)
    return f"""{bars}, w AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bucket) AS bar,
 list(struct_pack(o := open, h := high, l := low, c := close, v := volume)) OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS x FROM bars),
u AS (SELECT instrument, bucket, 0 AS k, x FROM w WHERE bar >= {minimum} UNION ALL SELECT instrument, bucket, 1, x[:len(x) - 1] FROM w WHERE bar >= {minimum}),
f AS (SELECT instrument, bucket, k, x, {', '.join(f'{sql} AS {n}' for n, sql in folds.items())} FROM u),
o AS (SELECT instrument, bucket, k, {', '.join(f'{out[c]} AS {c}' for c in columns)} FROM f)
SELECT instrument, bucket, {shown} FROM o GROUP BY 1, 2 HAVING max({columns[0]}) FILTER (WHERE k = 0) IS NOT NULL"""


def market_features_sql(steps: str, hour: int) -> str:
    """The 19 features of a bar: plain frames, folds over the window, and the direction of the
    last four hours that had ended."""
    emas = fold({f"e{n}": "x[1].c" for n in (9, 12, 21, 26, 50)}, 1, C, {f"n{n}": mean("e.c", f"s.e{n}", n) for n in (12, 26)},
                {**{f"e{n}": mean("e.c", f"s.e{n}", n) for n in (9, 21, 50)}, "e12": "n12", "e26": "n26", "g": mean("(n12 - n26)", "s.g", 9)})
    moves = lambda sign: f"list_avg(list_transform(range(2, 16), lambda i: greatest({sign} * (x[i].c - x[i - 1].c), 0)))"
    rsi = fold({"g": moves("1"), "l": moves("-1")}, 15, {"y": "x[i].c - x[i - 1].c"}, {}, {"g": "(s.g * 13 + greatest(e.y, 0)) / 14", "l": "(s.l * 13 + greatest(-e.y, 0)) / 14"})
    of20 = "PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
    frame = lambda n, k=0: f"OVER (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN {n - 1 + k} PRECEDING AND {f'{k} PRECEDING' if k else 'CURRENT ROW'})"
    return f"""{steps}, p AS (SELECT *, row_number() OVER o AS bar, close - lag(close) OVER o AS d, lag(close, 1) OVER o AS c1, lag(close, 4) OVER o AS c4, lag(close, 12) OVER o AS c12, lag(close, 10) OVER o AS c10,
 greatest(high - low, abs(high - coalesce(lag(close) OVER o, open)), abs(low - coalesce(lag(close) OVER o, open))) AS tr, list(struct_pack(o := open, h := high, l := low, c := close, v := volume)) {frame(160)} AS x FROM bars WINDOW o AS (PARTITION BY instrument ORDER BY bucket)),
q AS (SELECT *, avg(close) OVER ({of20}) AS m, stddev_pop(close) OVER ({of20}) AS sd, regr_slope(close, bar) OVER ({of20}) AS slope, regr_r2(close, bar) OVER ({of20}) AS fit, var_pop(close) OVER ({of20}) AS spread,
 CASE WHEN min(volume) {frame(21)} > 0 AND count(volume) {frame(21)} > 0 THEN volume / avg(volume) {frame(20, 1)} END AS vr,
 coalesce(abs(close - c10) / nullif(sum(abs(d)) {frame(10)}, 0), 0) AS er, 100 * log10(sum(tr) {frame(14)} / nullif(max(high) {frame(14)} - min(low) {frame(14)}, 0)) / log10(14) AS chop FROM p),
f AS (SELECT *, {emas} AS a, {rsi} AS r, {true_range_mean(14)} AS t FROM q WHERE bar >= 60),
h AS (SELECT instrument, bucket - bucket % {4 * hour} AS start, arg_max(close, bucket) AS close FROM bars b GROUP BY instrument, b.bucket - b.bucket % {4 * hour} HAVING count(*) = 4),
l AS (SELECT *, list(close) OVER (PARTITION BY instrument ORDER BY start ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS y FROM h),
k AS (SELECT instrument, start + {4 * hour} AS known, list_reduce(y, lambda v, c: v + (c - v) * 0.2) AS fast, list_reduce(y, lambda v, c: v + (c - v) * {2 / 22!r}) AS slow, list_reduce(y[:len(y) - 1], lambda v, c: v + (c - v) * 0.2) AS before FROM l WHERE len(y) >= 21),
z AS (SELECT f.*, CASE WHEN k.fast > k.slow AND k.fast > k.before THEN 1.0 WHEN k.fast < k.slow AND k.fast < k.before THEN -1.0 ELSE 0.0 END AS way, k.known IS NOT NULL AS told FROM f ASOF LEFT JOIN k ON f.instrument = k.instrument AND f.bucket + {hour} >= k.known)
SELECT instrument, bucket, round((close - c1) / t.a, 6) + 0.0 AS return1_atr, round((close - c4) / t.a, 6) + 0.0 AS return4_atr, round((close - c12) / t.a, 6) + 0.0 AS return12_atr, round((a.e9 - a.e21) / t.a, 6) + 0.0 AS ema_fast_atr, round((a.e21 - a.e50) / t.a, 6) + 0.0 AS ema_slow_atr,
round((CASE WHEN r.l = 0 THEN CASE WHEN r.g = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + r.g / r.l) END - 50) / 50, 6) + 0.0 AS rsi_centered, round((a.e12 - a.e26 - a.g) / t.a, 6) + 0.0 AS macd_histogram_atr, round(t.a / close, 6) + 0.0 AS atr_fraction,
round((close - m) / greatest(2 * sd, t.a * 0.1), 6) + 0.0 AS band_position, round(coalesce(ln(1 + vr) - ln(2), 0), 6) + 0.0 AS log_volume_ratio, CASE WHEN vr IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS volume_available, way::DOUBLE AS higher_direction, told::INT::DOUBLE AS higher_available,
round(er, 6) + 0.0 AS efficiency, round(coalesce(chop / 100, 0), 6) + 0.0 AS choppiness, round(slope / t.a, 6) + 0.0 AS regression_slope_atr, round(CASE WHEN spread * 20 <= 1e-20 THEN 0 ELSE fit END, 6) + 0.0 AS regression_r2, round((close - open) / t.a, 6) + 0.0 AS candle_body_atr,
round(CASE WHEN high > low THEN (2 * close - high - low) / (high - low) ELSE 0 END, 6) + 0.0 AS close_location FROM z WHERE t.a > 0"""

"""Chat formatting by quotation linking.

A message's lines are parsed into its own text and quoted passages: ``>`` marks, as many
as the passage is deep, with or without spaces; neighbouring lines of one depth are one
passage. Passages one level deep are what the message answers; deeper ones were quoted by
that message in turn. Own text and passages are normalised (white space squeezed, letters
lower-cased) and hashed twice: by lines, and by sentences of the lines joined, which do not
depend on where lines break, so a passage that was wrapped anew is found too.

A hash quoted at some level is joined to messages of the conversation that hold it one level
less deep (own text: level 0): each quoted hash stands for the latest earlier message that
does. Deeper levels are asked for own text as well, which counts only where nothing is found
at the right level. The message that most quoted hashes come from is the parent (ties: the
latest). Hashes have 64 bits and are compared within a conversation; texts are not compared.

The conversation is then rebuilt in reply order: a thread starts at a message without a
parent, and threads stand in the order of their starts, messages of a thread in turn
order, so each message follows what it answers. Texts carry no quotations any more.

Only hashes that are quoted somewhere enter the join, and it makes one row for each
quoted hash, however often a line is repeated: the latest message before a turn is looked
up in buckets of turns, what earlier buckets hold being carried from bucket to bucket.
Numbers within a conversation are sums over buckets of turns, so a very long conversation is
many tasks. Thread roots are found by pointer doubling over the replies only.

Cases: null or empty texts are messages without text and quotations; a quotation that no
earlier message holds stays out of the text and links nothing; null roles read ``user``;
null turns come last in their conversation and null conversations are one conversation;
repeated rows (same conversation and turn) keep separate rows in a stable order. Other
columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, read_table

BUCKET = 1024
_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
_SPACE = re.compile(r"\s+")
#: A sentence ends at these marks before white space, or at an empty line.
_END = re.compile(r"(?<=[.!?\u2026\u3002\uff01\uff1f])[\"'\u201d\u2019)\]]*\s+|\n[ \t]*\n")
#: "On ..., X wrote:" lines announce a quotation and go with it.
_LEAD = re.compile(r".{0,200}\b(wrote|writes|said)[ \t]*:[ \t]*$")


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text without quotations, and the quoted lines with their levels."""
    own: list[str] = []
    quoted: list[tuple[int, str]] = []
    for line in (text or "").split("\n"):
        m = _MARKS.fullmatch(line)
        if m:
            if own and not (quoted and quoted[-1][0] < 0) and _LEAD.match(own[-1]):
                own.pop()
            quoted.append((m[1].count(">"), m[2].strip()))
        else:
            own.append(line)
    return "\n".join(own).strip(), quoted


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a normalised line; 0 for an empty one."""
    line = _SPACE.sub(" ", line).strip().lower()
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63) if line else 0


def pieces(text: str) -> set[int]:
    """Hashes of the lines and of the sentences of a text."""
    found = {line_hash(x) for x in text.split("\n")}
    found.update(line_hash(x) for x in _END.split(text))
    found.discard(0)
    return found


def quotations(quoted: list[tuple[int, str]]) -> dict[int, set[int]]:
    """The hashes quoted at each level; neighbouring lines of a level are one passage."""
    out: dict[int, set[int]] = {}
    for level, lines in itertools.groupby(quoted, key=lambda q: q[0]):
        out.setdefault(level, set()).update(pieces("\n".join(x for _, x in lines)))
    return out


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``own`` text, ``held`` and ``asked`` hashes with their levels, and counts."""

    def rows(frames):
        for f in frames:
            own, held, asked, levels = [], [], [], []
            for text in f["text"]:
                mine, quoted = parse(text)
                passages = quotations(quoted)
                own.append(mine)
                held.append([{"level": k, "hash": h} for k, x in sorted({**passages, 0: pieces(mine)}.items()) for h in sorted(x)])
                # at the level the parent has it; deeper passages also as own text, which is second best
                ask = {(k - 1, h, 1) for k, x in passages.items() for h in x} | {(0, h, 0) for k, x in passages.items() if k > 1 for h in x}
                asked.append([{"level": k, "hash": h, "exact": e} for k, h, e in sorted(ask)])
                levels.append(max((level for level, _ in quoted), default=0))
            yield f[["conv_id", "turn", "role", "row"]].assign(own=own, held=held, asked=asked, quote_levels=levels)

    kinds = dict(messages.dtypes)
    return messages.mapInPandas(rows, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, row long, own string, held array<struct<level:int,hash:long>>, asked array<struct<level:int,hash:long,exact:int>>, quote_levels int")


def parents(messages: DataFrame) -> DataFrame:
    """(row, parent): for each message that quotes an earlier one, that one."""
    key = ["conv_id", "level", "hash"]
    timed = messages.filter("turn IS NOT NULL").withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    quotes = timed.select("conv_id", "turn", "row", "bucket", F.explode("asked").alias("x")).select("conv_id", "turn", "row", "bucket", "x.level", "x.hash", "x.exact", F.lit(0).alias("own"))
    quotes = materialize(quotes, "quoted")
    names = quotes.select(*[F.col(c).alias(f"a_{c}") for c in key]).distinct()
    held = timed.select("conv_id", "turn", "row", "bucket", F.explode("held").alias("x")).select("conv_id", "turn", "row", "bucket", "x.level", "x.hash", F.lit(None).cast("int").alias("exact"), F.lit(1).alias("own"))
    held = held.join(names, F.col("conv_id").eqNullSafe(F.col("a_conv_id")) & (F.col("level") == F.col("a_level")) & (F.col("hash") == F.col("a_hash")), "left_semi")
    both = materialize(quotes.unionByName(held), "dealt")
    mine = F.when(F.col("own") == 1, F.struct("turn", "row"))
    # a quotation sorts before what its own turn holds, so what precedes it is earlier
    past = Window.partitionBy(*key, "bucket").orderBy("turn", "own", "row").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last(mine, ignorenulls=True).over(past)).filter("own = 0")
    buckets = both.groupBy(*key, "bucket").agg(F.max(mine).alias("newest"))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = buckets.select(*[F.col(c).alias(f"b_{c}") for c in [*key, "bucket"]], F.last("newest", ignorenulls=True).over(before).alias("far"))
    far = materialize(far.filter("far IS NOT NULL"), "far")
    on = F.col("conv_id").eqNullSafe(F.col("b_conv_id"))
    for c in ("level", "hash", "bucket"):
        on = on & (F.col(c) == F.col(f"b_{c}"))
    found = near.join(far, on, "left").withColumn("source", F.coalesce("near", "far")).filter("source IS NOT NULL")
    found = found.groupBy("row", F.col("source.turn").alias("p_turn"), F.col("source.row").alias("parent")).agg(F.max("exact").alias("exact"), F.count_distinct("hash").alias("shared"))
    return found.groupBy("row").agg(F.max(F.struct("exact", "shared", "p_turn", "parent")).alias("best")).select("row", F.col("best.parent").alias("parent"))


def roots(links: DataFrame) -> DataFrame:
    """(row, root, depth) of each row with a parent, by doubling pointers."""
    at = materialize(links.select("row", F.col("parent").alias("root"), F.lit(1).alias("depth")), "roots")
    while True:
        far = at.select(F.col("row").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = at.join(far, "root", "left")
        if step.filter("next IS NOT NULL").isEmpty():
            return at
        at = materialize(step.select("row", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "roots")


def numbered(rows: DataFrame, group: list[str], order: list[str], bucket, name: str, amount=None) -> DataFrame:
    """``name``: the sum of ``amount`` (1 each) over the rows of the group that come
    before in ``order``; ``bucket`` cuts the order into pieces that are summed first."""
    amount = F.lit(1) if amount is None else amount
    rows = rows.withColumn("__bucket", bucket).withColumn("__amount", amount)
    sums = rows.groupBy(*group, "__bucket").agg(F.sum("__amount").alias("__sum"))
    before = Window.partitionBy(*group).orderBy(F.col("__bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__bucket").alias("__b"), "__base"), "sums")
    on = F.col("__bucket").eqNullSafe(F.col("__b"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*[F.col(o).asc_nulls_last() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__in", F.coalesce(F.sum("__amount").over(inside), F.lit(0))).join(sums, on)
    return out.withColumn(name, (F.col("__base") + F.col("__in")).cast("long")).drop("__bucket", "__amount", "__b", "__base", "__in", *[f"__{g}" for g in group])


def link_quotations(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, ``parent_turn``, ``root_turn``, ``depth``
    (0: starts a thread), ``position`` in reply order, ``quote_levels``, ``text`` (own)
    and ``formatted`` (with the role's header)."""
    source = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), "text")
    messages = materialize(parsed(source.withColumn("row", F.monotonically_increasing_id())), "messages")
    links = materialize(parents(messages), "links")
    turns = messages.select(F.col("row").alias("r"), F.col("turn").alias("t"))
    if links.isEmpty():
        all_rows = messages.withColumn("root", F.col("row")).withColumn("depth", F.lit(0)).withColumn("parent_turn", F.lit(None).cast("long")).withColumn("root_turn", F.col("turn"))
    else:
        far = roots(links).join(links, "row")
        far = far.join(turns.select(F.col("r").alias("parent"), F.col("t").alias("parent_turn")), "parent")
        far = far.join(turns.select(F.col("r").alias("root"), F.col("t").alias("root_turn")), "root").select("row", "root", "depth", "parent_turn", "root_turn")
        linked = messages.join(far, "row", "left")
        all_rows = linked.withColumn("root_turn", F.when(F.col("root").isNull(), F.col("turn")).otherwise(F.col("root_turn")))
        all_rows = all_rows.withColumn("root", F.coalesce("root", "row")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    all_rows = materialize(all_rows.select("conv_id", "turn", "role", "row", "own", "quote_levels", "root", "depth", "parent_turn", "root_turn"), "threads")
    threads = all_rows.groupBy("conv_id", "root", "root_turn").agg(F.count("*").alias("size"))
    threads = numbered(threads, ["conv_id"], ["root_turn", "root"], F.floor(F.col("root_turn") / BUCKET), "start", F.col("size"))
    threads = materialize(threads.select(F.col("root").alias("t_root"), "start"), "starts")
    inside = numbered(all_rows, ["root"], ["turn", "row"], F.floor(F.col("turn") / BUCKET), "inside")
    out = inside.join(threads, F.col("root") == F.col("t_root"))
    return out.select(
        "conv_id", "turn", "role", "parent_turn", "root_turn", "depth", (F.col("start") + F.col("inside")).alias("position"), "quote_levels",
        F.col("own").alias("text"), F.concat(F.lit("<|"), "role", F.lit("|>\n"), "own", F.lit("\n<|end|>\n")).alias("formatted"),
    )


def conversation_texts(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, chat): each conversation as one formatted text. For
    conversations that fit in a task; ``link_quotations`` has them as rows."""
    joined = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.array_sort(F.collect_list(F.struct("position", "formatted"))).alias("m"))
    return joined.select("conv_id", "messages", F.array_join(F.col("m.formatted"), "").alias("chat"))


def op10_quotation_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(read_table(spark, sf_dir, "conversations"))


#: Holds where no message quotes another, as in the given tables: then every message is its
#: own thread and keeps its turn's place. Quotations are tested against brute force.
ORACLE = r"""
SELECT conv_id, turn, coalesce(role, 'user') AS role, CAST(NULL AS BIGINT) AS parent_turn, turn AS root_turn,
       0 AS depth, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, 0 AS quote_levels,
       regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS text,
       '<|' || coalesce(role, 'user') || '|>' || chr(10)
         || regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') || chr(10) || '<|end|>' || chr(10) AS formatted
FROM conversations
"""

"""Texts of feeds and pages: entities, tags, URLs, titles, number lexemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.sources.tables import written

#: Entities and what they stand for (fixed values); ampersands come last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
TRACKING = r"(?i)(^|&)(utm_[^=&]*|fbclid|gclid)=[^&]*"


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and styles go, tags become spaces, entities are decoded,
    white space is squeezed."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", " "), r"(?is)<style\b.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, text in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(text))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title_key(title: Column) -> Column:
    """Letters and digits only, lower-cased: equal for titles that differ in punctuation."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def clean_url(url: Column) -> Column:
    """Without tracking parameters and fragment; scheme and host lower-cased; null unless http(s)."""
    url = F.regexp_replace(F.trim(url), r"#.*$", "")
    base, query = F.regexp_extract(url, r"^([^?]*)", 1), F.regexp_extract(url, r"\?(.*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), r"^&", "")
    head = F.lower(F.regexp_extract(base, r"^([A-Za-z]+://[^/]*)", 1))
    rest = F.regexp_extract(base, r"^[A-Za-z]+://[^/]*(.*)$", 1)
    return F.when(url.rlike(r"(?i)^https?://[^/]"), F.concat(head, rest, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def redact(text: Column) -> Column:
    """Values of keys that name a secret become ``***``."""
    return F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password)[\"']?\s*[=:]\s*[\"']?)[^\"'\s&,]+", "$1***")


def lexeme_digits(lexeme: Column) -> Column:
    """Digits of a decimal without point and leading zeros, as book checksums take them."""
    return F.trim(F.regexp_replace(F.replace(lexeme, F.lit("."), F.lit("")), "^0+", ""))


def relevance(title: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a title matches."""
    return F.array_compact(F.array(*[F.when(title.rlike(p), F.lit(k)) for k, p in patterns.items()]))


def dedupe_news(items: DataFrame, url: str = "url", title: str = "title", published: str = "published", id: str = "id") -> DataFrame:
    """Items from the newest back (ties: the smaller ``id``), without those whose clean URL or
    title key an item that stays has. In each round the first item of both its URL and its
    title stays and takes its copies with it, until none is left; a few rounds do, since
    only a chain of items that share now a URL, now a title needs more. Maxima are taken
    before the shuffle, so a title that many items share is no hot task. Items without a
    clean URL go; ``published`` and ``id`` are not null."""
    cols = items.columns
    left = items.withColumns({"__u": clean_url(F.col(url)), "__t": title_key(F.col(title))}).filter("__u IS NOT NULL")
    left = written(left.withColumn("__t", F.coalesce("__t", F.lit(""))), "news")
    best = F.max(F.struct(F.col(published).alias("p"), (-F.col(id)).alias("i")))
    kept = []
    while not left.isEmpty():
        by_url = written(left.groupBy("__u").agg(best.alias("__bu")), "urls")
        by_title = written(left.groupBy("__t").agg(best.alias("__bt")), "titles")
        mine = F.struct(F.col(published).alias("p"), (-F.col(id)).alias("i"))
        now = left.join(by_url, "__u").join(by_title, "__t").filter((mine == F.col("__bu")) & (mine == F.col("__bt"))).drop("__bu", "__bt")
        kept.append(written(now.dropDuplicates(["__u"]), "kept"))
        rest = left.join(kept[-1].select("__u"), "__u", "left_anti").join(kept[-1].select("__t"), "__t", "left_anti")
        left = written(rest, "news")
    out = kept[0] if kept else left
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.select(*cols)

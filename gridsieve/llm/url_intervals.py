"""URL filters from dated lists: validity intervals and an as-of join, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
# Days, as numbers since 1970.
FIRST_DAY, DAYS = 19_000, 400
# Hosts are salted so far that one host's captures spread over several tasks.
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and a final dot; else null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)
    return F.nullif(F.lower(F.rtrim(host, F.lit("."))), F.lit(""))


def suffixes_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."),
    )


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to, action) from dated entries (domain, day, action).

    An entry holds from its day until the next entry of its domain; ``valid_to`` is exclusive
    and null for the last.  Of entries on one day the strictest stays: block before allow.
    Entries with a null are left out.  A domain's entries are few (one a day at most after the
    first grouping), so its window is bounded by the days of the lists.
    """
    daily = (
        entries.select(F.lower("domain").alias("domain"), F.col("day").cast("int"), "action")
        .where("domain is not null and day is not null and action in ('block', 'allow')")
        .groupBy("domain", "day").agg(F.max("action").alias("action"))
    )
    following = F.lead("day").over(Window.partitionBy("domain").orderBy("day"))
    return daily.select("domain", F.col("day").alias("valid_from"), following.alias("valid_to"), "action")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Columns of ``captures`` (url, fetch_day and others) and host, domain, action, kept.

    Every capture is judged by the entries active on its day: of its host and parent domains
    the longest listed one decides; without any the capture is kept.  A null url or day, or a
    url without a host, matches nothing and is kept.

    Distinct (host, day) pairs are judged once, so a host that holds a third of all captures
    meets the lists in as many rows as it has days; verdicts come back by a join on the pair
    and a salt, to which each pair is copied.
    """
    captures = captures.drop("host", "domain", "action", "kept")
    named = captures.withColumn("host", host_of(F.col("url")))
    pairs = named.where("host is not null and fetch_day is not null").select("host", "fetch_day").distinct()
    spread = pairs.select("host", "fetch_day", F.explode(suffixes_of(F.col("host"))).alias("domain"))
    active = spread.join(validity_intervals(entries), "domain").where(
        "valid_from <= fetch_day and (valid_to is null or fetch_day < valid_to)"
    )
    verdicts = (
        active.groupBy("host", "fetch_day")
        .agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "action")).alias("v"))
        .select("host", "fetch_day", "v.domain", "v.action")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("url", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    joined = salted.join(verdicts, ["host", "fetch_day", "_salt"], "left").drop("_salt")
    return joined.select(
        *captures.columns, "host", "domain", "action",
        (F.coalesce("action", F.lit("allow")) == "allow").alias("kept"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetch_day): the day follows from the page's number."""
    return pages.select("page_id", "url", (F.pmod(F.col("page_id") * 37, F.lit(DAYS)) + FIRST_DAY).cast("int").alias("fetch_day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries of the hosts and parent domains that the pages name.

    A domain is blocked from a day that follows from its length and first page, allowed again
    60 days later if its length is even, and blocked for good 200 days later if that page's
    number is a multiple of three.
    """
    seen = (
        pages.select("page_id", F.explode(suffixes_of(host_of(F.col("url")))).alias("domain"))
        .groupBy("domain").agg(F.min("page_id").alias("p"))
        .where("length(domain) % 3 = 1")
    )
    start = (F.pmod(F.col("p") * 11 + F.length("domain") * 7, F.lit(DAYS)) + FIRST_DAY).cast("int")
    events = F.array(
        F.struct(start.alias("day"), F.lit("block").alias("action")),
        F.struct(F.when(F.length("domain") % 2 == 0, start + 60).alias("day"), F.lit("allow").alias("action")),
        F.struct(F.when(F.col("p") % 3 == 0, start + 200).alias("day"), F.lit("block").alias("action")),
    )
    return seen.select("domain", F.explode(events).alias("e")).select("domain", "e.day", "e.action").where("day is not null")


def url_filter(pages: DataFrame) -> DataFrame:
    """page_id, host, domain, action and kept of every page, by lists made from the pages."""
    judged = filter_captures(captures_of(pages), entries_of(pages))
    return judged.select("page_id", "host", "domain", "action", "kept")


URL_SQL = rf"""
WITH c AS (
  SELECT page_id, CAST(((page_id * 37) % {DAYS}) + {FIRST_DAY} AS INT) AS day,
    nullif(lower(rtrim(regexp_extract(coalesce(url, ''), '{HOST}', 1), '.')), '') AS host FROM pages),
parts AS (SELECT *, string_split(host, '.') AS ps FROM c WHERE host IS NOT NULL),
suf AS (
  SELECT page_id, day, host, array_to_string(list_slice(ps, k, len(ps)), '.') AS domain
  FROM (SELECT *, unnest(range(1, greatest(len(ps) - 1, 1) + 1)) AS k FROM parts)),
seen AS (
  SELECT domain, min(page_id) AS p, length(domain) AS n FROM suf GROUP BY domain HAVING length(domain) % 3 = 1),
st AS (SELECT *, CAST(((p * 11 + n * 7) % {DAYS}) + {FIRST_DAY} AS INT) AS s FROM seen),
ev AS (
  SELECT domain, s AS day, 'block' AS action FROM st
  UNION ALL SELECT domain, s + 60, 'allow' FROM st WHERE n % 2 = 0
  UNION ALL SELECT domain, s + 200, 'block' FROM st WHERE p % 3 = 0),
daily AS (SELECT domain, day, max(action) AS action FROM ev GROUP BY domain, day),
iv AS (SELECT *, lead(day) OVER (PARTITION BY domain ORDER BY day) AS until FROM daily),
act AS (
  SELECT suf.page_id, iv.domain, iv.action,
         row_number() OVER (PARTITION BY suf.page_id ORDER BY length(iv.domain) DESC) AS r
  FROM suf JOIN iv ON suf.domain = iv.domain AND iv.day <= suf.day AND (until IS NULL OR suf.day < until))
SELECT c.page_id, c.host, a.domain, a.action, coalesce(a.action, 'allow') = 'allow' AS kept
FROM c LEFT JOIN (SELECT * FROM act WHERE r = 1) a ON c.page_id = a.page_id"""

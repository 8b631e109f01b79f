"""URL filters: temporal list join.

A list is a table of dated entries (kind, pattern, action, since): kind ``host``
matches that host, ``domain`` the host and all below it, ``prefix`` a host and
the leading segments of its path.  Entries of one (kind, pattern) become
validity intervals: an entry holds from its date until the next one's; action
``remove`` ends it.  An as-of join evaluates each capture at its fetch time
against the interval of each of its keys that holds then.  Of those, the most
specific decides: longest prefix, then host, then longest domain.

Keys are joined by equality and the interval is a further condition of the same
join, so a hot host needs no window over its captures: its rows are split by AQE,
or meet a broadcast list whose size was checked.

Defined results: a null url or one without a host has no key; a null fetch time
meets no interval; both give action ``none``.  Entries with a null field are
ignored.  Of entries of one key and date the greatest action (in text order)
holds.  Repeated captures each give a row.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Intervals up to which the list is broadcast (about 100 bytes each).
BROADCAST_INTERVALS = 100_000
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url):
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, action, since, until): until is null while an entry still holds; removals are left out."""
    rows = entries.select("kind", "pattern", "action", "since").dropna()
    rows = rows.groupBy("kind", "pattern", "since").agg(F.max("action").alias("action"))
    later = Window.partitionBy("kind", "pattern").orderBy("since")
    return rows.withColumn("until", F.lead("since").over(later)).where("action <> 'remove'")


def capture_keys(url):
    """Column of array<struct<kind, pattern, rank>>: all keys of a url, of which a greater rank is more specific."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), (F.size(labels) - i).alias("rank")),
    )
    segments = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    prefixes = F.when(
        F.size(segments) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(segments)),
            lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("pattern"), (i + 100_000).alias("rank")),
        ),
    ).otherwise(F.array().cast("array<struct<kind:string,pattern:string,rank:int>>"))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"), F.lit(10_000).alias("rank")))
    return F.when(host.isNotNull(), F.concat(domains, own, prefixes))


def evaluate(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per capture: id, url, fetch time, action, matched_kind, matched, since."""
    intervals = validity_intervals(entries)
    few = intervals.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched"))
    # equal captures get equal answers: they are asked once
    asked = rows.where("url is not null and fetched is not null").select("url", "fetched").distinct()
    keyed = asked.select("url", "fetched", F.explode(capture_keys(F.col("url"))).alias("k")).select("url", "fetched", F.col("k.kind").alias("kind"), F.col("k.pattern").alias("pattern"), F.col("k.rank").alias("rank"))
    listed = F.broadcast(intervals) if few else intervals
    active = keyed.join(listed, ["kind", "pattern"]).where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = active.groupBy("url", "fetched").agg(F.max(F.struct("rank", "kind", "pattern", "action", "since")).alias("b"))
    done = rows.join(best, ["url", "fetched"], "left")
    return done.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        F.col("fetched").alias(time_col),
        F.coalesce("b.action", F.lit("none")).alias("action"),
        F.col("b.kind").alias("matched_kind"),
        F.col("b.pattern").alias("matched"),
        F.col("b.since").alias("since"),
    )


def _mod(col, salt: str, n: int):
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), col).cast("binary")), 1, 8), 16, 10).cast("long") % n


def fetch_time(id_col):
    """The fetch day that the query gives a page, which has none: day 0 to 364 from its id."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.coalesce(F.pmod(id_col * 7919, F.lit(365)), F.lit(0)).cast("int"))


def entries_from_pages(pages: DataFrame) -> DataFrame:
    """The dated list that the query uses: entries for some hosts of the pages, by a hash of the host."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    v, d = _mod(F.col("host"), "kind:", 6), _mod(F.col("host"), "day:", 200)
    entry = lambda kind, pattern, action, since: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), since.alias("since"))
    host = F.col("host")
    parent = F.regexp_replace(host, r"^[^.]*\.", "")
    made = (
        F.when(v == 0, F.array(entry("host", host, "block", day(d)), entry("host", host, "remove", day(d + 60)), entry("host", host, "block", day(d + 150))))
        .when(v == 1, F.array(entry("domain", parent, "block", day(d + 100)), entry("host", host, "allow", day(d + 120))))
        .when(v == 2, F.array(entry("host", host, "allow", day(d))))
        .when(v == 3, F.array(entry("prefix", F.concat(host, F.lit("/en")), "block", day(d)), entry("prefix", F.concat(host, F.lit("/en")), "remove", day(d + 90))))
        .when(v == 4, F.array(entry("domain", host, "block", day(d))))
    )
    return hosts.select(F.explode(made).alias("e")).select("e.*")


def page_report(pages: DataFrame) -> DataFrame:
    """Every page as a capture, evaluated against the list of its fetch day."""
    found = evaluate(pages.select("page_id", "url", fetch_time(F.col("page_id")).alias("fetched")), entries_from_pages(pages))
    return found.select("page_id", F.col("fetched").cast("string").alias("fetched"), "action", "matched_kind", "matched", F.col("since").cast("string").alias("since"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(coalesce(((page_id * 7919) % 365 + 365) % 365, 0) AS INTEGER) AS DATE) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '\.+$', ''), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM pages),
h AS (
  SELECT host, regexp_replace(host, '^[^.]*\.', '') AS parent,
         CAST('0x' || substr(md5('kind:' || host), 1, 8) AS BIGINT) % 6 AS v, CAST('0x' || substr(md5('day:' || host), 1, 8) AS BIGINT) % 200 AS d
  FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
e AS (
  SELECT 'host' AS kind, host AS pattern, 'block' AS action, d AS n FROM h WHERE v = 0
  UNION ALL SELECT 'host', host, 'remove', d + 60 FROM h WHERE v = 0
  UNION ALL SELECT 'host', host, 'block', d + 150 FROM h WHERE v = 0
  UNION ALL SELECT 'domain', parent, 'block', d + 100 FROM h WHERE v = 1
  UNION ALL SELECT 'host', host, 'allow', d + 120 FROM h WHERE v = 1
  UNION ALL SELECT 'host', host, 'allow', d FROM h WHERE v = 2
  UNION ALL SELECT 'prefix', host || '/en', 'block', d FROM h WHERE v = 3
  UNION ALL SELECT 'prefix', host || '/en', 'remove', d + 90 FROM h WHERE v = 3
  UNION ALL SELECT 'domain', host, 'block', d FROM h WHERE v = 4),
g AS (SELECT kind, pattern, CAST(DATE '2024-01-01' + CAST(n AS INTEGER) AS DATE) AS since, max(action) AS action FROM e GROUP BY 1, 2, 3),
i AS (SELECT *, lead(since) OVER (PARTITION BY kind, pattern ORDER BY since) AS until FROM g),
l AS (SELECT page_id, url, fetched, host, seg, string_split(host, '.') AS lab FROM p),
k AS (
  SELECT page_id, url, fetched, 'domain' AS kind, array_to_string(lab[j:], '.') AS pattern, len(lab) - j AS rank FROM (SELECT *, unnest(range(1, len(lab) + 1)) AS j FROM l)
  UNION ALL SELECT page_id, url, fetched, 'host', host, 10000 FROM l WHERE host IS NOT NULL
  UNION ALL SELECT page_id, url, fetched, 'prefix', host || '/' || array_to_string(seg[1:j], '/'), 100000 + j FROM (SELECT *, unnest(range(1, len(seg) + 1)) AS j FROM l WHERE host IS NOT NULL)),
a AS (
  SELECT k.page_id, k.url, k.rank, k.kind, k.pattern, i.action, i.since,
         row_number() OVER (PARTITION BY k.page_id, k.url ORDER BY k.rank DESC, k.kind DESC, k.pattern DESC) AS rn
  FROM k JOIN i ON i.kind = k.kind AND i.pattern = k.pattern AND i.action <> 'remove' AND i.since <= k.fetched AND (i.until IS NULL OR k.fetched < i.until))
SELECT p.page_id, CAST(p.fetched AS VARCHAR) AS fetched, coalesce(a.action, 'none') AS action, a.kind AS matched_kind, a.pattern AS matched, CAST(a.since AS VARCHAR) AS since
FROM p LEFT JOIN a ON a.page_id = p.page_id AND a.url = p.url AND a.rn = 1
"""

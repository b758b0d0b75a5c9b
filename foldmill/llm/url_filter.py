"""URL filters by a temporal list join.

Dated list entries (a key is added to a list, or removed from it) become validity intervals, and an as-of
join evaluates every capture against the entries that were active on its fetch day.  Keys are domains
(``d:host``, which also cover subdomains) and path prefixes (``p:host/a/b``, which also cover what lies
below).  A capture asks for all its keys: each suffix of its host of two labels or more (a host of one
label asks for itself) and each prefix of its path.

An entry counts from its day on, until the next entry of the same list and key.  Of several entries on one
day, the one of the largest ``seq`` counts, and of equal ``seq`` the removal.  So a list and key has at
most one interval a day, which bounds the array of intervals that a key carries, however many entries it
has; entries are reduced by partial aggregation first.  Captures are known by 128 bits of hash while their
keys are joined, so no URL is repeated for each key.  The intervals are broadcast if their counted size is
small; else a hot key among the captures is a skewed join with the small row of its intervals, which adaptive
execution splits.

Cases: a null or unparsable URL has no key and is not blocked; a null fetch day is not blocked; entries
with a null list, key, day or action are ignored; repeated captures get equal verdicts; empty tables give
an empty result, or one in which nothing is blocked; other columns pass through, and the verdict's columns
replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, without

INTERVAL = "array<struct<list_name:string,since:date,until:date>>"
#: Counted size of the intervals up to which they are broadcast: near Spark's own bound, as lists grow with the web.
BROADCAST_BYTES = 8 << 20
VERDICT = ("blocked", "n_active", "matched_key", "matched_list", "listed_since")


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without the final slash."""
    return F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("/"))


def domain_key(host: Column) -> Column:
    return F.concat(F.lit("d:"), host)


def prefix_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("p:"), host, path)


def with_keys(df: DataFrame, url_col: str, out: str) -> DataFrame:
    """``df`` once for each key that its URL asks for; rows without a host drop out."""
    host, path = fresh(df.columns, "_host"), fresh(df.columns, "_path")
    df = df.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    first = F.greatest(F.lit(1), F.size(labels) - 1)
    suffixes = F.transform(F.sequence(F.lit(1), first), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("p:"), F.col(host), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    keys = F.when(F.col(host).isNotNull(), F.concat(suffixes, prefixes))
    return without(df.withColumns({out: F.explode(keys)}), [host, path])


def intervals(entries: DataFrame) -> DataFrame:
    """(key, spans): the disjoint validity intervals of each key and list, from
    ``entries`` (list_name, key, day, action 'add' or 'remove', seq)."""
    usable = entries.select("list_name", "key", F.col("day").cast("date").alias("day"), F.lower("action").alias("action"), F.col("seq").cast("bigint").alias("seq"))
    usable = usable.where(F.col("action").isin("add", "remove")).dropna(subset=["list_name", "key", "day"])
    last = usable.groupBy("list_name", "key", "day").agg(F.max(F.struct(F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"), F.col("action"))).alias("x"))
    # One row a day at most: the days of a list and key, in order, are few however hot the key.
    days = F.array_sort(F.collect_list(F.struct(F.col("day"), F.col("x.action").alias("action"))))
    histories = last.groupBy("list_name", "key").agg(days.alias("days"))
    nexts = F.transform(
        "days",
        lambda d, k: F.struct(F.col("list_name").alias("list_name"), d["day"].alias("since"), F.get(F.col("days"), k + 1)["day"].alias("until"), d["action"].alias("action")),
    )
    active = F.transform(F.filter(nexts, lambda x: x["action"] == "add"), lambda x: F.struct(x["list_name"].alias("list_name"), x["since"].alias("since"), x["until"].alias("until")))
    spans = histories.select("key", active.cast(INTERVAL).alias("spans")).where(F.size("spans") > 0)
    return spans.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def evaluated(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetch_day", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``captures`` with the verdict as of the fetch day: ``blocked``, ``n_active`` (active entries),
    and of the longest matching key, in code-point order on ties: ``matched_key``, ``matched_list``,
    ``listed_since``."""
    spans = materialize(intervals(entries), "intervals")
    # A broadcast row was measured at some 210 bytes with one interval and a key of 30.
    size = spans.agg(F.coalesce(F.sum(F.octet_length("key") + 96 * (F.size("spans") + 1)), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if size <= broadcast_bytes else spans
    url, day = fresh(captures.columns, "_url"), fresh(captures.columns, "_day")
    rows = captures.withColumns({url: captures[url_col], day: captures[day_col].cast("date")})
    asked = rows.select(F.col(url).alias("u"), F.col(day).alias("d")).where("u is not null and d is not null").distinct()
    ids = {"i": F.xxhash64("u", "d"), "j": F.xxhash64(F.lit(1), "d", "u")}
    asked = with_keys(asked.withColumns(ids), "u", "key").select("i", "j", "d", "key")
    active = F.filter("spans", lambda x: (x["since"] <= F.col("d")) & (x["until"].isNull() | (F.col("d") < x["until"])))
    hits = asked.join(spans, "key").select("i", "j", "key", active.alias("active")).where(F.size("active") > 0)
    best = F.max(F.struct(F.length("key").alias("n"), F.col("key"), F.get("active", F.lit(0)).alias("x"))).alias("best")
    verdict = hits.groupBy("i", "j").agg(F.sum(F.size("active")).cast("bigint").alias("n"), best)
    names = [fresh([*rows.columns, *VERDICT], n) for n in ("_i", "_j", "_n", "_best")]
    verdict = verdict.toDF(*names[:4])
    known = rows[url].isNotNull() & rows[day].isNotNull()
    same = known & (F.xxhash64(rows[url], rows[day]) == verdict[names[0]]) & (F.xxhash64(F.lit(1), rows[day], rows[url]) == verdict[names[1]])
    kept = without(captures, VERDICT).columns
    out = rows.join(verdict, same, "left")
    n, x = F.col(names[2]), F.col(names[3])
    return out.select(
        *[rows[c] for c in kept],
        n.isNotNull().alias("blocked"),
        F.coalesce(n, F.lit(0)).cast(T.LongType()).alias("n_active"),
        x["key"].alias("matched_key"),
        x["x"]["list_name"].alias("matched_list"),
        x["x"]["since"].alias("listed_since"),
    )


def reported(pages: DataFrame) -> DataFrame:
    """List entries as crawled pages report them: one dated entry for each page, all from its URL's hash."""
    h = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 12), 16, 10).cast("bigint")
    rows = pages.select("page_id", h.alias("h"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    upper = F.when(F.size(F.split("host", r"\.")) > 2, F.substring_index("host", ".", -2)).otherwise(F.col("host"))
    key = F.when(F.expr("h % 4096 = 0"), domain_key(upper)).when(F.expr("h % 5 = 0"), domain_key(F.col("host"))).otherwise(prefix_key(F.col("host"), F.col("path")))
    return rows.select(
        F.expr("case h div 7 % 3 when 0 then 'adult' when 1 then 'malware' else 'spam' end").alias("list_name"),
        key.alias("key"),
        F.expr("date_add(date'2024-01-01', cast(h div 64 % 366 as int))").alias("day"),
        F.expr("if(h div 32768 % 4 = 0, 'remove', 'add')").alias("action"),
        F.col("page_id").alias("seq"),
    )


def captured(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetch_day): ``pages`` has no fetch time, so a page's day comes from its id's hash."""
    h = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 12), 16, 10).cast("bigint")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (h % 366).cast("int")).alias("fetch_day"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, lower(url) AS lu, CAST('0x' || substr(md5(url), 1, 12) AS BIGINT) AS h,
         CAST(DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 12) AS BIGINT) % 366 AS INTEGER) AS DATE) AS fetch_day
  FROM pages
), q AS (
  SELECT *, nullif(regexp_extract(lu, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1), '') AS host,
         rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path
  FROM p
), e AS (
  SELECT CASE h // 7 % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END AS list_name,
         CASE WHEN h % 4096 = 0 THEN 'd:' || array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 1), len(string_split(host, '.'))), '.')
              WHEN h % 5 = 0 THEN 'd:' || host ELSE 'p:' || host || path END AS key,
         CAST(DATE '2024-01-01' + CAST(h // 64 % 366 AS INTEGER) AS DATE) AS day,
         CASE WHEN h // 32768 % 4 = 0 THEN 'remove' ELSE 'add' END AS action, page_id AS seq
  FROM q WHERE host IS NOT NULL
), o AS (SELECT *, row_number() OVER (PARTITION BY list_name, key, day ORDER BY seq DESC, action DESC) AS rn FROM e),
v AS (SELECT list_name, key, action, day AS since, lead(day) OVER (PARTITION BY list_name, key ORDER BY day) AS until FROM o WHERE rn = 1),
k AS (
  SELECT page_id, url, fetch_day, 'd:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS key
  FROM q, unnest(range(1, greatest(2, len(string_split(host, '.'))))) t(i) WHERE host IS NOT NULL
  UNION
  SELECT page_id, url, fetch_day, 'p:' || host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/')
  FROM q, unnest(range(1, len(string_split(path, '/')) + 1)) t(i) WHERE host IS NOT NULL
), m AS (
  SELECT k.*, list_name, since FROM k JOIN v ON k.key = v.key AND v.action = 'add' AND v.since <= fetch_day AND (v.until IS NULL OR fetch_day < v.until)
), b AS (
  SELECT page_id, count(*) AS n, first(key ORDER BY length(key) DESC, key DESC, list_name, since) AS matched_key,
         first(list_name ORDER BY length(key) DESC, key DESC, list_name, since) AS matched_list,
         first(since ORDER BY length(key) DESC, key DESC, list_name, since) AS listed_since
  FROM m GROUP BY page_id
)
SELECT q.page_id, q.url, CAST(q.fetch_day AS VARCHAR) AS fetch_day, b.n IS NOT NULL AS blocked, coalesce(b.n, 0) AS n_active, matched_key, matched_list, CAST(listed_since AS VARCHAR) AS listed_since
FROM q LEFT JOIN b ON q.page_id = b.page_id
"""

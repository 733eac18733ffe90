"""URL filters: a temporal list join.

Dated list changes (entry added, entry removed) become validity intervals by a window over each
entry's changes; every capture asks for its url's keys (host and parent domains, each with and without
the first path part) and an as-of join keeps the entries active at fetch time. The join is an equi-join
on the key with the interval as a further condition; a hot host spreads by Spark's split of skewed
partitions, as an entry has few intervals.

Cases: a null or foreign url has no keys and matches nothing; a capture without a time matches
nothing; several changes of an entry at one time: the last by (action, category) counts; removing what
was never added has no effect; adding again changes the category from then on; several active entries:
block before allow at equal specificity, the most specific key first, then the newest; repeated rows of
captures are kept; an empty list leaves all captures allowed; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import table

FOREVER = 1 << 40


def host_of(url: Column) -> Column:
    """Lower-case host without port; null if the url has no scheme and host."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """Array of (key, depth): each domain of two labels and more, plain and with the first path part."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.concat_ws(".", F.slice(labels, i, n)))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    plain = F.transform(suffixes, lambda s: F.struct(s.alias("key"), F.length(s).alias("depth")))
    deep = F.transform(suffixes, lambda s: F.struct(F.concat(s, F.lit("/"), path).alias("key"), (F.length(s) + 1 + F.length(path)).alias("depth")))
    return F.when(host_of(url).isNotNull(), F.when(path != "", F.concat(plain, deep)).otherwise(plain))


def intervals(changes: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) from changes (key, at, action 'add' or 'remove', category); half-open."""
    kept = changes.where("key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    last = kept.groupBy("key", "at").agg(F.max(F.struct("action", "category")).alias("x"))
    ordered = Window.partitionBy("key").orderBy("at")
    return last.withColumn("valid_to", F.coalesce(F.lead("at").over(ordered), F.lit(FOREVER))).where("x.action = 'add'").select("key", F.col("x.category").alias("category"), F.col("at").alias("valid_from"), "valid_to")


def as_of(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """captures' key with the deciding entry (list_key, category, valid_from), the number of active entries and `blocked`."""
    plain = captures.select(F.col(key), F.col(at).alias("_at"), F.col(url).alias("_url"))
    asked = plain.distinct().select("*", F.explode(keys_of(F.col("_url"))).alias("k")).select(key, "_at", "_url", "k.key", "k.depth")
    e = entries.select(F.col("key").alias("list_key"), "category", "valid_from", "valid_to")
    hits = asked.join(e, (F.col("key") == F.col("list_key")) & (F.col("valid_from") <= F.col("_at")) & (F.col("_at") < F.col("valid_to")))
    order = F.struct("depth", F.when(F.col("category") == "allow", 0).otherwise(1).alias("b"), "valid_from", "list_key", "category")
    best = hits.groupBy(key, "_at", "_url").agg(F.max(order).alias("x"), F.countDistinct("list_key").alias("active"))
    out = plain.join(best, [key, "_at", "_url"], "left")
    blocked = F.coalesce(F.col("x.category") != "allow", F.lit(False))
    return out.select(key, F.col("x.list_key").alias("list_key"), F.col("x.category").alias("category"), F.col("x.valid_from").alias("valid_from"), F.coalesce("active", F.lit(0)).cast("long").alias("active_entries"), blocked.alias("blocked"))


# The query's captures and list: pages have no fetch time and there is no list table, so both follow from
# the urls by md5: day of fetch 0 to 29; hosts and first path parts of a few digests enter and leave lists.
def digit(c: Column, at: int) -> Column:
    """Value of a hexadecimal digit pair of the md5 of c."""
    return F.conv(F.substring(F.md5(F.encode(c, "UTF-8")), at, 2), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (digit(F.col("page_id").cast("string"), 1) % 30).alias("fetched"))


def changes_of(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key IS NOT NULL").distinct()
    domains = hosts.select(F.regexp_extract("key", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("key")).where("key <> ''").distinct()
    listed = hosts.union(domains).distinct().where(digit(F.col("key"), 1) % 3 == 0)
    start = digit(F.col("key"), 3) % 12
    gap = digit(F.col("key"), 5) % 9 + 1
    kind = F.element_at(F.array(*map(F.lit, ("malware", "adult", "spam", "allow"))), (digit(F.col("key"), 7) % 4 + 1).cast("int"))
    steps = F.array(F.struct(start.alias("at"), F.lit("add").alias("action"), kind.alias("category")), F.struct((start + gap).alias("at"), F.lit("remove").alias("action"), kind.alias("category")), F.struct((start + 2 * gap).alias("at"), F.lit("add").alias("action"), F.lit("spam").alias("category")))
    return listed.select("key", F.explode(steps).alias("s")).select("key", "s.*")


def op5_url_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return as_of(captures_of(pages), intervals(changes_of(pages)))


_D = "CAST(('0x' || substr(md5({c}), {at}, 2)) AS BIGINT)"
_HOST = r"nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)"
OP5_SQL = f"""
WITH hosts AS (SELECT DISTINCT {_HOST} AS key FROM pages WHERE {_HOST} IS NOT NULL),
listed AS (
  SELECT key FROM (SELECT key FROM hosts UNION SELECT regexp_extract(key, '([^.]+\\.[^.]+\\.[^.]+)$', 1) FROM hosts WHERE regexp_extract(key, '([^.]+\\.[^.]+\\.[^.]+)$', 1) <> '')
  WHERE {_D.format(c="key", at=1)} % 3 = 0),
t AS (SELECT key, {_D.format(c="key", at=3)} % 12 AS s, {_D.format(c="key", at=5)} % 9 + 1 AS g, list_extract(['malware', 'adult', 'spam', 'allow'], {_D.format(c="key", at=7)} % 4 + 1) AS kind FROM listed),
entries AS (SELECT key, kind AS category, s AS valid_from, s + g AS valid_to FROM t UNION ALL SELECT key, 'spam', s + 2 * g, {FOREVER} FROM t),
caps AS (SELECT page_id, {_D.format(c="CAST(page_id AS VARCHAR)", at=1)} % 30 AS tm, {_HOST} AS host, {_PATH} AS path FROM pages),
suffixes AS (SELECT page_id, tm, path, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS suffix
  FROM (SELECT page_id, tm, path, host, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS i FROM caps WHERE host IS NOT NULL)),
asked AS (SELECT page_id, tm, suffix AS key, length(suffix) AS depth FROM suffixes UNION ALL SELECT page_id, tm, suffix || '/' || path, length(suffix) + 1 + length(path) FROM suffixes WHERE path <> ''),
hits AS (SELECT a.page_id, a.depth, e.* FROM asked a JOIN entries e ON a.key = e.key AND e.valid_from <= a.tm AND a.tm < e.valid_to),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY depth DESC, CASE WHEN category = 'allow' THEN 0 ELSE 1 END DESC, valid_from DESC, key DESC, category DESC) AS rn, (SELECT count(DISTINCT key) FROM hits h WHERE h.page_id = hits.page_id) AS n FROM hits)
SELECT p.page_id, b.key AS list_key, b.category, CAST(b.valid_from AS BIGINT) AS valid_from, CAST(coalesce(b.n, 0) AS BIGINT) AS active_entries, coalesce(b.category <> 'allow', false) AS blocked
FROM pages p LEFT JOIN best b ON p.page_id = b.page_id AND b.rn = 1
"""

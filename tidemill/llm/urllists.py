"""URL filters by a temporal list join, in DataFrame operations only.

A list is a log of dated entries: on a day a pattern is added to or removed from it. :func:`intervals` turns the log into
validity intervals [valid_from, valid_to); :func:`judge` joins every capture, as of its fetch time, to the intervals of the
patterns that can match it: the host, each parent domain, and host plus each leading part of the path.

An active allow entry wins over block entries that are no more specific than it (a longer pattern is more specific);
of equal specificity allow wins, and of equal entries the list first in order is named.

Patterns of a capture are exploded and equi-joined to intervals on the pattern
with the time as the rest of the condition, so no rows of a pattern are compared with other patterns. Of a path, only the leading parts
of lengths that patterns of that host have are made, so a path of any length costs no more. Spark broadcasts the
intervals only under its checked size threshold; otherwise a sort-merge join runs, which AQE splits where one host has
a third of the captures. Captures are first reduced to distinct (host, path, day), so copies of a URL are judged
once; the html column is never read.

Cases: a null or unparsable URL has a null host and isn't blocked; nor is a capture with a null fetch time, as no interval holds it. An entry of
the log with a null field is ignored. An entry removed before it is added has no
effect; adding twice changes nothing; of several changes to a pattern on one day in one list the last action in
order (remove after add) holds. An empty log blocks nothing. Repeated captures are answered one by one. Of the input's columns, those named as
the ones added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import without
from tidemill.tables import table

#: (list, pattern, verdict, action, day): the log that the registered query applies.
LOG = [
    ("gambling", "casino-win.example.com", "block", "add", "2023-01-10"),
    ("gambling", "casino-win.example.com", "block", "remove", "2023-09-01"),
    ("gambling", "casino-win.example.com", "block", "add", "2024-02-01"),
    ("gambling", "free-bets.example.com", "block", "add", "2023-06-15"),
    ("pharma", "cheap-pills.example.com", "block", "add", "2022-12-01"),
    ("pharma", "cheap-pills.example.com", "block", "remove", "2024-03-01"),
    ("pharma", "cheap-pills.example.com/de", "block", "add", "2024-04-01"),
    ("spam", "example.net", "block", "add", "2023-11-01"),
    ("spam", "example.net", "block", "remove", "2023-12-01"),
    ("spam", "tiontion.example.net", "block", "add", "2023-03-01"),
    ("spam", "tiontion.example.net", "block", "add", "2023-05-01"),
    ("spam", "blog.tionsh.example.com", "block", "add", "2023-02-01"),
    ("spam", "blog.tionsh.example.com", "block", "remove", "2023-02-01"),
    ("trusted", "therst.example.net", "allow", "add", "2023-01-01"),
    ("trusted", "tiontion.example.net/en", "allow", "add", "2023-04-01"),
    ("trusted", "casino-win.example.com/fr", "allow", "add", "2024-06-01"),
    ("trusted", "ththth.example.net", "allow", "remove", "2023-11-10"),
]
#: The captures' fetch day in the registered query, as pages has none: a day of two years from 2023-01-01 by page_id.
FETCHED = "date_add(date'2023-01-01', cast(pmod(page_id * 37, 730) as int))"


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port or a final dot; null if the URL has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    """Path without query or fragment, without its first and last slash."""
    return F.trim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), F.lit("/"))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def heads(host: Column, path: Column, lengths: Column) -> Column:
    """The host with as many leading parts of the path as each of the lengths says; lengths the path hasn't are left out."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    fitting = F.filter(lengths, lambda n: n <= F.size(parts))
    return F.transform(fitting, lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def intervals(log: DataFrame) -> DataFrame:
    """(list, pattern, verdict, valid_from, valid_to): when an entry was active; valid_to null while it still is."""
    key = ["list", "pattern", "verdict"]
    log = log.dropna(subset=[*key, "action", "day"])
    daily = log.groupBy(*key, "day").agg(F.max((F.col("action") == "remove").cast("int")).alias("removed"))
    order = Window.partitionBy(*key).orderBy("day")
    changes = daily.withColumn("before", F.lag("removed", 1, 1).over(order)).where(F.col("removed") != F.col("before"))
    return changes.withColumn("valid_to", F.lead("day").over(order)).where("removed = 0").select(*key, F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, active: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Adds host, blocked, list and pattern (of the deciding entry, null if none) to each capture."""
    captures = without(captures, "host", "blocked", "list", "pattern")
    captures = captures.withColumn("host", host_of(F.col(url))).withColumn("_path", path_of(F.col(url)))
    places = captures.select("host", "_path", F.col(fetched).alias("_day")).where("host is not null").distinct()
    below = active.where(F.col("pattern").contains("/")).select(F.substring_index("pattern", "/", 1).alias("_host"), (F.size(F.split("pattern", "/")) - 1).alias("_n"))
    lengths = below.groupBy("_host").agg(F.collect_set("_n").alias("_lengths"))
    known = places.join(lengths, places["host"] == lengths["_host"], "left").withColumn("_lengths", F.coalesce("_lengths", F.array().cast("array<int>")))
    matching = F.array_distinct(F.concat(suffixes(F.col("host")), heads(F.col("host"), F.col("_path"), F.col("_lengths"))))
    tried = known.select("host", "_path", "_day", F.explode(matching).alias("pattern"))
    active_then = (F.col("t._day") >= F.col("a.valid_from")) & (F.col("a.valid_to").isNull() | (F.col("t._day") < F.col("a.valid_to")))
    hit = tried.alias("t").join(active.alias("a"), (F.col("t.pattern") == F.col("a.pattern")) & active_then).select("t.host", "t._path", "t._day", "a.list", "a.pattern", "a.verdict")
    # The least of (shorter pattern last, allow first, list, pattern) decides.
    decided = hit.groupBy("host", "_path", "_day").agg(F.min(F.struct((-F.length("pattern")).alias("short"), (F.col("verdict") == "block").alias("blocked"), "list", "pattern")).alias("_by"))
    joined = captures.alias("c").join(decided.alias("d"), (F.col("c.host") == F.col("d.host")) & (F.col("c._path") == F.col("d._path")) & (F.col(f"c.`{fetched}`") == F.col("d._day")), "left")
    kept = [F.col(f"c.`{x}`") for x in captures.columns if x != "_path"]
    return joined.select(*kept, F.coalesce(F.col("d._by.blocked"), F.lit(False)).alias("blocked"), F.col("d._by.list").alias("list"), F.col("d._by.pattern").alias("pattern"))


def log_frame(spark: SparkSession, log: list[tuple[str, ...]] = LOG) -> DataFrame:
    """The log as a literal table."""
    if not log:
        return spark.sql("select '' as list, '' as pattern, '' as verdict, '' as action, date'2000-01-01' as day where false")
    values = ", ".join("('{}', '{}', '{}', '{}', date'{}')".format(*row) for row in log)
    return spark.sql(f"select * from values {values} as log(list, pattern, verdict, action, day)")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of pages, judged by the entries active on its fetch day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched"))
    out = judge(pages, intervals(log_frame(spark)))
    return out.select("page_id", "url", "fetched", "host", "blocked", "list", "pattern")


ORACLE = """
with log(list, pattern, verdict, action, day) as (values {values}),
daily as (select list, pattern, verdict, day, max(case when action = 'remove' then 1 else 0 end) as removed from log group by all),
changes as (select * from (select *, lag(removed, 1, 1) over (partition by list, pattern, verdict order by day) as before from daily) where removed <> before),
active as (select * from (select *, lead(day) over (partition by list, pattern, verdict order by day) as valid_to from changes) where removed = 0),
captures as (
  select page_id, url, date '2023-01-01' + cast(((page_id * 37) % 730 + 730) % 730 as integer) as fetched,
         nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') as host,
         trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/') as path
  from pages),
hits as (
  select c.page_id, a.list, a.pattern, a.verdict,
         row_number() over (partition by c.page_id order by length(a.pattern) desc, a.verdict, a.list, a.pattern) as place
  from captures c join active a
    on c.fetched >= a.day and (a.valid_to is null or c.fetched < a.valid_to)
   and (c.host = a.pattern or ends_with(c.host, '.' || a.pattern) or c.host || '/' || c.path = a.pattern or starts_with(c.host || '/' || c.path || '/', a.pattern || '/') and a.pattern like '%/%'))
select c.page_id, c.url, c.fetched, c.host, coalesce(h.verdict = 'block', false) as blocked, h.list, h.pattern
from captures c left join hits h on h.page_id = c.page_id and h.place = 1
""".format(values=", ".join("('{}', '{}', '{}', '{}', date '{}')".format(*row) for row in LOG))

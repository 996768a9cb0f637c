"""URL filters: a temporal list join, in DataFrame and SQL operations only.

A list has dated entries (domain, action, listed_on). An entry holds from its
date until the next one of its domain, which makes validity intervals. A capture
(url, fetched) is judged by the entries that are active at its fetch time for
its host or a parent domain of it; the most specific domain wins.

The as-of join is one equi-join on the host: the intervals of each distinct
host's domains are gathered first, one row per host, so a host with a third of all
captures has one partner, and the choice by time is a filter of that row's array.
The host table is broadcast up to `small` hosts, counted; beyond that both
sides are shuffled, and a hot host's captures can be split by the adaptive planner, as
its other side is a single row.

Nulls: a null or unreadable url, a null fetch time and entries with a null
domain or date match nothing, and such captures stay, not blocked. Repeated captures each
give a row. Of several entries of a domain on one date, block wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url):
    """The lower-case host of a url without a dot at its end; null where there is none."""
    return F.nullif(F.rtrim(F.regexp_extract(F.lower(url), _HOST, 1), F.lit(".")), F.lit(""))


def domains(host_):
    """The host and its parent domains of two labels or more, e.g. a.b.c: a.b.c, b.c."""
    labels = F.split(host_, r"\.")
    return F.when(F.size(labels) < 2, F.array(host_)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """entries(domain, action, listed_on) -> domain, action, listed_on, until (null: still active)."""
    one = entries.where("domain is not null and listed_on is not null").groupBy(F.lower("domain").alias("domain"), "listed_on").agg(F.max("action").alias("action"))
    return one.select("domain", "action", "listed_on", F.expr("lead(listed_on) over (partition by domain order by listed_on)").alias("until"))


def judge(captures: DataFrame, entries: DataFrame, small: int = 100_000) -> DataFrame:
    """captures(page_id, url, fetched: date), entries(domain, action: 'block' or 'allow',
    listed_on: date) -> page_id, host, fetched, listed_domain, action, listed_on, blocked."""
    caps = captures.select("page_id", F.col("fetched"), host(F.col("url")).alias("host"))
    hosts = caps.where("host is not null").select("host").distinct()
    listed = hosts.select("host", F.explode(domains(F.col("host"))).alias("domain")).join(intervals(entries), "domain")
    steps = listed.groupBy("host").agg(F.collect_list(F.struct(F.length("domain").alias("size"), "domain", "action", "listed_on", "until")).alias("steps"))
    if steps.limit(small + 1).count() <= small:
        steps = F.broadcast(steps)
    active = F.array_max(F.filter("steps", lambda s: (s["listed_on"] <= F.col("fetched")) & (s["until"].isNull() | (s["until"] > F.col("fetched")))))
    got = caps.join(steps, "host", "left").select("page_id", "host", "fetched", active.alias("a"))
    return got.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), F.col("a.domain").alias("listed_domain"), F.col("a.action").alias("action"), F.col("a.listed_on").cast("string").alias("listed_on"), F.coalesce(F.col("a.action") == "block", F.lit(False)).alias("blocked"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages have no fetch time: page_id is taken as fetched on day page_id mod 366 of 2024."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(pmod(page_id, 366) as int))").alias("fetched"))


def page_list(pages: DataFrame) -> DataFrame:
    """A dated list for the domains of the pages. Byte i = 0..3 of a domain's MD5, if below 96,
    makes an entry in quarter i, on its day byte mod 90, that blocks where i is even and allows
    where it is odd. Domains with the label ads-track are blocked from the start."""
    names = pages.select(F.explode(domains(host(F.col("url")))).alias("domain")).where("domain is not null").distinct()
    byte = names.select("domain", F.posexplode(F.expr("transform(array(1, 3, 5, 7), p -> cast(conv(substring(md5(domain), p, 2), 16, 10) as int))")).alias("i", "byte"))
    dated = byte.where("byte < 96").select("domain", F.expr("if(i % 2 = 0, 'block', 'allow')").alias("action"), F.expr("date_add(DATE'2024-01-01', i * 91 + byte % 90)").alias("listed_on"))
    return dated.unionByName(names.where("concat('.', domain, '.') like '%.ads-track.%'").select("domain", F.lit("block").alias("action"), F.expr("DATE'2024-01-01'").alias("listed_on")))


def op6_url_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(page_captures(pages), page_list(pages))


ORACLE = r"""
with caps as (
  select page_id, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.'), '') as host,
         date '2024-01-01' + ((page_id % 366 + 366) % 366)::int as fetched
  from pages),
hosts as (select distinct host, string_split(host, '.') as l from caps where host is not null),
names as (select host, unnest(case when len(l) < 2 then [host] else list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.')) end) as domain from hosts),
bytes as (select domain, i, ('0x' || substring(md5(domain), 2 * i + 1, 2))::int as byte from (select distinct domain from names), range(4) as t(i)),
entries as (
  select domain, case when i % 2 = 0 then 'block' else 'allow' end as action, date '2024-01-01' + (i * 91 + byte % 90)::int as listed_on from bytes where byte < 96
  union all
  select distinct domain, 'block', date '2024-01-01' from names where '.' || domain || '.' like '%.ads-track.%'),
one as (select domain, listed_on, max(action) as action from entries group by all),
spans as (select *, lead(listed_on) over (partition by domain order by listed_on) as until from one),
found as (
  select c.page_id, c.host, c.fetched, s.domain, s.action, s.listed_on,
         row_number() over (partition by c.page_id order by length(s.domain) desc nulls last) as k
  from caps c left join (names n join spans s using (domain)) on n.host = c.host and s.listed_on <= c.fetched and (s.until is null or s.until > c.fetched))
select page_id, host, fetched::varchar as fetched, domain as listed_domain, action, listed_on::varchar as listed_on, coalesce(action = 'block', false) as blocked
from found where k = 1
"""

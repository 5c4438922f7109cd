"""URL filters by a temporal list join.

Lists are logs of dated entries: a key (a host, a domain with all below it, or a host and path prefix) is added to a list
on one day and removed on another. Each key's entries become validity intervals [day, day of its next entry), of which
additions count; a capture is joined with the intervals of its own keys (host, host and parent domains, host and path
prefixes) that hold at the time it was fetched. An allow list outweighs all block lists.

Defined results: a null or unparsable URL has no host and is allowed; a null fetch time meets no entry; of entries for one
key on one day the last by (seq, action) holds; entries with a null in a needed column are ignored; repeated captures are
judged alike, one row each; with no entries all captures are allowed; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.support import columns, small

_KEY = ["list", "kind", "key"]


def host(url: Column) -> Column:
    """The lower-cased host, null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, since, until) of entries (list, kind, key, action, day, seq); until is null for what still holds."""
    known = columns(entries, *_KEY, "action", "day", "seq").dropna(subset=[*_KEY, "action", "day"])
    last = known.groupBy(*_KEY, "day").agg(F.max(F.struct("seq", "action"))["action"].alias("action"))
    until = F.lead("day").over(Window.partitionBy(*_KEY).orderBy("day"))
    return last.withColumn("until", until).where("action = 'add'").select(*_KEY, F.col("day").alias("since"), "until")


def keys(url: Column) -> Column:
    """(kind, key) that list entries may name a URL by: its host, its domains, and its path's prefixes."""
    name, path = host(url), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    labels, steps = F.split(name, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    pair = lambda kind: lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    upward = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    down = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    return F.when(name.isNotNull(), F.concat(F.array(pair("host")(name)), F.transform(upward, pair("domain")), F.transform(down, pair("path"))))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, host, lists, verdict) per capture (page_id, url, fetched): the lists that hold, sorted and comma-joined."""
    spans = intervals(entries)
    seen = columns(captures, "page_id", "url", "fetched").groupBy("page_id", "url", "fetched").agg(F.count("*").alias("copies"))
    posted = seen.select("page_id", "url", "fetched", F.explode(keys(F.col("url"))).alias("k")).select("page_id", "url", "fetched", "k.kind", "k.key")
    hits = posted.join(small(spans), ["kind", "key"]).where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    per = hits.groupBy(*(F.col(c).alias(f"_{c}") for c in ("page_id", "url", "fetched"))).agg(F.array_sort(F.collect_set("list")).alias("names"))
    same = seen["page_id"].eqNullSafe(per["_page_id"]) & seen["url"].eqNullSafe(per["_url"]) & seen["fetched"].eqNullSafe(per["_fetched"])
    names = F.coalesce("names", F.array().cast("array<string>"))
    verdict = F.when(F.exists(names, lambda n: n.startswith("allow")), "allow").when(F.size(names) > 0, "block").otherwise("allow")
    out = seen.join(per, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("page_id", "url", "fetched", host(F.col("url")).alias("host"), F.array_join(names, ",").alias("lists"), verdict.alias("verdict"))

"""URL filtering against dated lists, in SQL functions only.

List entries are dated: an entry (a domain) is added, and perhaps removed, and perhaps added again. The events of each
entry, in order of time, become validity intervals [since, until). A capture of a URL is evaluated against the entries
that were active when it was fetched: its host and the domains above it are its keys, and the as-of join picks, per
key, the interval that holds the fetch time. An entry's intervals never overlap, so each key meets one at most.

What is looked up are the different pairs of host and fetch time, which are fewer than captures, and captures find
their pair's verdict again. Intervals, and pairs that matched, are broadcast if they are at most BROADCAST_ROWS;
larger tables are joined with a salt on the side of many rows and SALTS copies of the other, so that no domain or host
lands in one task.

A null URL, or one without a host, matches nothing and is kept; so is a capture without a fetch time. Captures that
repeat, or share an id, are each judged by their own URL and time. Events that repeat count once; of an addition and a
removal at one time the removal holds. Host names are compared in lower case, without port, user or a final dot, by
all their last labels, up to as many as the longest listed domain has; an address in brackets is one label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.common import narrow, written

#: Rows of a table that is broadcast: some 100 bytes each.
BROADCAST_ROWS = 500_000
#: Tasks that a key of a larger join is dealt to.
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1)
    host = F.rtrim(host, F.lit("."))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """domain, since, until (null: still valid) of entries (domain, action 'add' or 'remove', at)."""
    held = narrow(entries, {"domain": "string", "action": "string", "at": "timestamp"}).where("domain is not null and at is not null")
    held = held.withColumn("domain", F.lower(F.trim("domain"))).groupBy("domain", "at").agg(F.bool_and(F.col("action") == "add").alias("on"))
    turn = Window.partitionBy("domain").orderBy("at")
    changes = held.withColumn("was", F.lag("on").over(turn)).where("not (on <=> was) and (on or was is not null)")
    return changes.withColumn("until", F.lead("at").over(turn)).where("on").select("domain", F.col("at").alias("since"), "until")


def _dealt(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined with few on keys; few is broadcast if its counted rows allow it, else copied for each salt."""
    if few.count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), keys, how)
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.hash(*many.columns), F.lit(SALTS))
    return many.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def _labels(domain: Column) -> Column:
    return F.when(F.startswith(domain, F.lit("[")), F.array(domain)).otherwise(F.split(domain, r"\."))


def _captures(captures: DataFrame) -> DataFrame:
    held = narrow(captures, {"capture_id": "long", "url": "string", "fetched": "timestamp"})
    return held.select("capture_id", host_of(F.col("url")).alias("host"), "fetched")


def _matches(held: DataFrame, entries: DataFrame) -> DataFrame:
    """host, fetched, domain, since: the entries that were active, of each different host and fetch time."""
    spans = written(intervals(entries), "url-spans")
    most = spans.agg(F.max(F.size(_labels(F.col("domain"))))).first()[0] or 0
    pairs = held.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    labels, n = _labels(F.col("host")), F.size("labels")
    tails = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, most)))), lambda k: F.array_join(F.slice("labels", n - k + 1, k), "."))
    looked = pairs.withColumn("labels", labels).select("host", "fetched", F.explode(tails).alias("domain"))
    active = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    return _dealt(looked, spans, ["domain"]).where(active).select("host", "fetched", "domain", "since")


def match(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, domain, since: the entries that were active when the capture (capture_id, url, fetched) was made."""
    held = _captures(captures)
    return _dealt(held, written(_matches(held, entries), "url-matches"), ["host", "fetched"]).select("capture_id", "domain", "since")


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, host, n_matches, domain (the longest that matched) and kept of every capture."""
    held = _captures(captures)
    found = _matches(held, entries).groupBy("host", "fetched").agg(F.countDistinct("domain").alias("n_matches"), F.max_by("domain", F.struct(F.length("domain"), "domain")).alias("domain"))
    out = _dealt(held, written(found, "url-verdicts"), ["host", "fetched"], "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long")))
    return out.select("capture_id", "host", "n_matches", "domain", (F.col("n_matches") == 0).alias("kept"))

"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import bpe, chat, decontam, dedup, langid, licenses, oracle, quality, repair, toxicity, urls
from crestline.llm.common import read_table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.format_turns(rows))


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.components(read_table(spark, sf_dir, "documents"), similarity=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


#: A small dated list of domains.
URL_ENTRIES = [
    ("casino-win.example.com", "add", "2023-03-01"),
    ("casino-win.example.com", "remove", "2023-09-15"),
    ("casino-win.example.com", "add", "2024-02-01"),
    ("free-bets.example.com", "add", "2023-01-01"),
    ("spam-farm.example.com", "add", "2023-06-01"),
    ("spam-farm.example.com", "remove", "2024-06-01"),
    ("cheap-pills.example.com", "add", "2023-11-20"),
    ("adult-x.example.net", "add", "2022-05-05"),
    ("ads-track.example.com", "add", "2024-01-01"),
    ("ads-track.example.com", "remove", "2024-04-01"),
    ("example.org", "add", "2024-10-01"),
    ("example.org", "remove", "2024-10-08"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time here: page n counts as fetched n * 7919 minutes, modulo two years, after 2023-01-01."""
    entries = spark.createDataFrame(URL_ENTRIES, "domain string, action string, at string")
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), "url", F.expr("timestamp_seconds(1672531200 + 60 * ((page_id * 7919) % 1051200))").alias("fetched"))
    return urls.verdicts(pages, entries).withColumnRenamed("capture_id", "page_id")


_URL_SQL = """
with events as (select domain, bool_and(action = 'add') as active, cast(day as timestamp) as ts from (values {rows}) e(domain, action, day) group by domain, day),
changes as (select * from (select *, lag(active) over (partition by domain order by ts) as was from events) where active is distinct from was and (active or was is not null)),
spans as (select domain, active, ts as since, lead(ts) over (partition by domain order by ts) as until from changes),
caps as (select page_id, nullif(rtrim(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@]+)', 1), '.'), '') as host,
         timestamp '2023-01-01' + to_minutes(cast((page_id * 7919) % 1051200 as bigint)) as fetched from pages),
found as (select page_id, count(distinct domain) as n_matches, arg_max(domain, length(domain)) as domain
          from caps join spans on active and (host = domain or ends_with(host, '.' || domain)) and since <= fetched and (until is null or fetched < until)
          group by page_id)
select c.page_id, c.host, coalesce(n_matches, 0) as n_matches, domain, n_matches is null as kept
from caps c left join found using (page_id)
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.index(repair.write_shards(read_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_bpe_encoding, op3_minhash_near_dedup, op4_quality_rules, op5_toxicity, op6_license_scans, op7_url_filters, op8_language_id, op9_benchmark_decontamination, op10_token_shards)}


def oracle_sql() -> dict[str, str]:
    rows = ", ".join(str(x) for x in URL_ENTRIES)
    return {
        "op1_chat_formatting": oracle.chat_sql(),
        "op3_minhash_near_dedup": oracle.dedup_sql(85),
        "op4_quality_rules": oracle.quality_sql(),
        "op7_url_filters": _URL_SQL.format(rows=rows),
        "op9_benchmark_decontamination": oracle.decontam_sql(),
    }

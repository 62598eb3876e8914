"""Every operator over nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crestline.llm import bpe, chat, decontam, dedup, langid, licenses, quality, repair, toxicity, urls
from crestline.llm.common import narrow

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all".split()


def text(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * k * 3 + k * (seed % 5)) % len(WORDS)] + ("." if k % 9 == 8 else "") for k in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, text(1, 120), "en", "s", 1), (2, None, "en", "s", None), (3, "", None, None, 0), (4, " \n\t ", "fr", "s", 3), (5, text(1, 120), "en", "s", 1), (5, text(1, 120), "en", "s", 1)]
    rows += [(6, text(2, 30_000), "de", "s", 1), (7, "ok", "en", "s", 2), (None, text(3, 60), "fr", "s", 1), (8, "😀 Ünï 日本 \x00 end", "de", "s", 9), (9, "x" * 50_000, "en", "s", 1)]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("TEXT", "kept", "n_words", "spans", "gone", "c0", "votes", "label", "score")
    return held.select("*", *(F.lit(5).alias(c) for c in extra))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (7, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, text(1, 20)), (2, None), (None, text(3, 12)), (3, "ok"), (3, "ok"), (4, "")], "item_id long, text string")


def run(name, docs, labels, benchmark):
    return {
        "bpe": lambda: bpe.round_trip(docs),
        "bpe_ids": lambda: bpe.decode(bpe.encode(docs)),
        "dedup": lambda: dedup.components(docs),
        "quality": lambda: quality.report(docs),
        "toxicity": lambda: toxicity.report(docs, labels),
        "langid": lambda: langid.report(docs),
        "decontam": lambda: decontam.report(docs, benchmark),
        "repair": lambda: repair.index(repair.write_shards(docs)),
    }[name]()


NAMES = ["bpe", "bpe_ids", "dedup", "quality", "toxicity", "langid", "decontam", "repair"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_document(docs, labels, benchmark, name):
    got = run(name, docs, labels, benchmark).collect()
    assert len(got) == docs.count()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    by = {r.doc_id: r for r in got}
    assert name != "dedup" or (by[5].component_id == 1 and not by[5].kept and by[3].component_id == 3 and by[2].kept)
    assert name != "langid" or (by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[2].score == 0)
    assert name != "decontam" or (by[1].n_hit >= 10 and by[7].n_hit == 1 and by[7].n_items == 1 and not by[3].contaminated)
    assert name != "quality" or (by[2].n_words == 0 and by[2].base_failed and not by[2].kept and by[1].n_words == 120)


@pytest.mark.parametrize("name", NAMES)
def test_no_documents(docs, labels, benchmark, name):
    assert run(name, docs.where("doc_id = 777"), labels, benchmark).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "langid", "decontam"])
def test_nothing_to_learn_or_match(docs, labels, benchmark, name):
    got = run(name, docs.withColumn("lang", F.lit(None).cast("string")), labels.where("false"), benchmark.where("false")).collect()
    assert len(got) == docs.count()


def test_stages_keep_columns(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.toDF(*(f"c{i}" for i in range(len(out.columns)))).write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name)).toDF(*docs.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path)).count() == held.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_licenses(docs):
    held = narrow(docs, {"doc_id": "long", "text": "string"}).select("doc_id", F.concat_ws("\n", "text", F.lit("Released under the MIT License.")).alias("text"))
    got = licenses.scan(held).collect()
    assert len(got) == held.count() and {r.license for r in got} == {"MIT-line"} and all(r.coverage == 1.0 for r in got)
    assert licenses.scan(docs).collect() == [] and licenses.scan(docs.where("false")).collect() == []


def test_chat(spark):
    rows = [(1, 0, "user", "a </s> b"), (1, 1, "assistant", "␛a␛ [INST]<|turn|>"), (1, 1, "assistant", "␛a␛ [INST]<|turn|>"), (1, 1, None, None), (None, None, "assistant", "x"), (2, None, "assistant", ""), (3, 9, "odd <s> role", "\n😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("TEXT"), F.lit(1).alias("k"))
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 4, None: 1, 2: 1, 3: 1}
    assert got[1].loss_chars == 2 * len("␛a␛ [INST]<|turn|>") and got[3].loss_chars == 0
    turns = chat.format_turns(df).where("conv_id = 1").orderBy("k").collect()
    assert [r.start for r in turns] == [sum(len(t.ids) for t in turns[:i]) for i in range(4)]
    assert chat.digest(chat.format_turns(df.where("false"))).collect() == []


def test_urls(spark):
    caps = spark.createDataFrame([(1, "HTTP://User@Sub.Bad.example:80/x", "2024-01-02 00:00:00"), (2, None, "2024-01-02 00:00:00"), (3, "https://bad.example/", None), (4, "not a url", "2024-01-02 00:00:00"), (4, "http://bad.example./", "2024-02-01 00:00:00"), (None, "http://bad.example", "2024-01-01 00:00:00")], "capture_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp"))
    entries = spark.createDataFrame([("Bad.example", "add", "2024-01-01"), ("bad.example", "add", "2024-01-01"), ("bad.example", "add", "2024-01-15"), ("bad.example", "remove", "2024-02-01"), (None, "add", "2024-01-01"), ("x", None, "2024-01-01")], "domain string, action string, at string")
    assert [(r.domain, str(r.since), str(r.until)) for r in urls.intervals(entries).collect()] == [("bad.example", "2024-01-01 00:00:00", "2024-02-01 00:00:00")]
    got = sorted((str(r.capture_id), r.kept) for r in urls.verdicts(caps, entries).collect())
    assert got == [("1", False), ("2", True), ("3", True), ("4", True), ("4", True), ("None", False)]
    assert urls.verdicts(caps.where("false"), entries).collect() == []
    assert urls.verdicts(caps, entries.where("false")).where("not kept").collect() == []

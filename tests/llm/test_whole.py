"""Cases in which an operator once did less than the whole job."""

import base64
import math
import os
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.llm import chat, decontam, dedup, langid, licenses, toxicity, urls
from crestline.llm.common import remove_written, written
from tests.llm.test_brute import components, shingle_set


def test_language_filter_rejects_what_is_no_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rng, by = random.Random(5), {}
    for r in docs.orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    letters = ["".join(rng.choice(string.ascii_lowercase + "   ") for _ in range(600)) for _ in range(5)]
    blobs = [base64.b64encode(rng.randbytes(400)).decode(), rng.randbytes(300).hex()]
    other = ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."]
    mixed = ["\n".join(max(texts, key=len)[:500] for texts in by.values())]
    rows = [(100_000 + k, t, None) for k, t in enumerate(letters + blobs + other)] + [(200_000 + k, t, None) for k, t in enumerate(mixed)]
    got = {r.doc_id for r in langid.filter_language(docs.union(spark.createDataFrame(rows, docs.schema))).collect()}
    assert not {i for i in got if 100_000 <= i < 200_000} and 200_000 in got
    assert len(got) > docs.count() * 0.95


def test_passages_are_cut_alike_by_parts_of_the_benchmark(spark):
    w = [f"w{k}" for k in range(60)]
    items = [w[0:12], w[6:20], w[30:42], w[44:56], [*w[24:29], *w[42:44], *w[56:60]]]
    docs = [
        [*(f"a{k}" for k in range(30)), *w[0:20], *(f"b{k}" for k in range(30))],  # the items overlap
        [*w[30:42], *(f"c{k}" for k in range(10)), *w[44:56]],  # each covers 35 %
        [*w[24:29], *w[30:42], *w[42:44], *w[56:60], *(f"d{k}" for k in range(30))],  # neighbours only after a cut
        ["clean", "text"],
    ]
    d = spark.createDataFrame([(k, " ".join(x), 0) for k, x in enumerate(docs)] + [(9, None, 0)], "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").coalesce(1)
    whole, parts = ({r.doc_id: tuple(r) for r in decontam.decontaminate(d, b, shard_chars=n).collect()} for n in (1_000_000, 1))
    assert whole == parts and set(whole) == {0, 2, 3, 9}
    assert parts[0][1].split() == docs[0][:30] + docs[0][50:]
    assert parts[2][1].split() == docs[2][:5] + docs[2][17:]


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_short_near_copies(spark, percent):
    pairs = [(f"p{n}x{j}", n) for n in range(1, 13) for j in range(4)]
    rows = [" ".join(f"{p}w{k}" for k in range(m)) for p, n in pairs for m in (n, n + 1)]
    sets = {i: shingle_set(t) for i, t in enumerate(rows)}
    got = dedup.components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), percent).collect()
    expected = components(sets, percent)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert percent != 80 or all(expected[i] != i for i, t in enumerate(rows) if len(t.split()) in (9, 10) and i % 2)


def test_all_registers_are_in_bands():
    assert [dedup.key_registers(x) for x in (95, 85, 80, 70, 50, 30)] == [4, 4, 4, 2, 2, 1]
    assert (1 - 0.8**4) ** 32 < 1 / 20_000_000 and (1 - 0.5**2) ** 64 < 1 / 20_000_000


def test_short_labelled_texts_are_learnt(spark):
    words = {"en": "the and this with have from they which that were".split(), "fr": "les une dans pour avec sont nous être cette mais".split()}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(words[lang], k=5)), lang) for k, lang in enumerate(["en", "fr"] * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert max(len(t.encode()) for _, t, _ in rows) < langid.SEGMENT
    got = langid.report(docs).where("held_out").collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 0.95 * len(got) > 0


def test_backpropagation_with_a_mask():
    m = langid.train([b"a" * 64, b"b" * 40] * 4, ["x", "y"] * 4, steps=1)
    for name in ("x", "u", "out", "bias"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    ids, label = np.random.default_rng(0).integers(97, 103, (3, 9)).astype(np.uint8), np.array([0, 1, 1])
    there = np.arange(9) < np.array([[9], [4], [6]])

    def loss():
        p = langid._softmax(langid._pooled_states(langid._forward(m, langid._both(ids), langid._masked(there))[0]) @ m.out + m.bias)
        return -(np.log(p[:, np.arange(3), label]) * there.T).sum() / there.sum()

    for p, g in zip(m.parts(), langid._gradients(m, ids, label, there)):
        for k in np.argsort(-np.abs(g).ravel())[:5]:
            at = np.unravel_index(k, p.shape)
            old, h = p[at], 1e-2
            p[at] = old + h
            up = loss()
            p[at] = old - h
            down = loss()
            p[at] = old
            assert (up - down) / (2 * h) == pytest.approx(g[at], rel=0.05, abs=2e-4)


def test_licenses_bear_any_one_changed_word():
    index = licenses.Index(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        words = licenses.words_of(template.encode())
        for k in range(len(words)):
            for new in ([b"zzz"], []):
                text = b" ".join([b"before", b"it", *words[:k], *new, *words[k + 1 :], b"after"])
                assert name in [x[0] for x in index.scan(text, 0.8)], text
    assert [x[0] for x in licenses.Index({"one": "Unlicense", "two": "Public domain"}).scan(b"in the public domain by unlicense", 0.8)] == ["one", "two"]


def test_listed_domains_of_many_labels(spark):
    deep = ".".join(f"l{k}" for k in range(11)) + ".example"
    hosts = [deep, f"a.{deep}", f"b.a.{deep}", deep.split(".", 1)[1], "x.example"]
    caps = spark.createDataFrame([(k, f"http://{h}/", "2024-06-01") for k, h in enumerate(hosts)], "capture_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp"))
    entries = spark.createDataFrame([(deep, "add", "2024-01-01")], "domain string, action string, at string")
    assert {r.capture_id for r in urls.verdicts(caps, entries).where("not kept").collect()} == {0, 1, 2}


def test_repeated_notices_are_all_found():
    index = licenses.Index(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        n = len(licenses.words_of(template.encode()))
        found = [x for x in index.scan(((template + " ") * 300).encode(), 0.8) if x[0] == name]
        assert [(a, z) for _, a, z, _, _ in found] == [(k * n, (k + 1) * n) for k in range(300)], name


def test_captures_are_judged_one_by_one(spark, monkeypatch):
    rows = [(2, "http://good.org/", "2024-06-01"), (2, "http://bad.example/", "2024-06-01"), (2, "http://bad.example/", "2024-06-01"), (2, "http://bad.example/", "2023-06-01"), (3, "http://[2001:db8::1]:80/x", "2024-06-01"), (4, "http://[2001:db8::2]/x", "2024-06-01")]
    caps = spark.createDataFrame(rows, "capture_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp"))
    entries = spark.createDataFrame([("bad.example", "add", "2024-01-01"), ("[2001:db8::1]", "add", "2024-01-01")], "domain string, action string, at string")
    expected = sorted([(2, "good.org", True), *[(2, "bad.example", False)] * 2, (2, "bad.example", True), (3, "[2001:db8::1]", False), (4, "[2001:db8::2]", True)])
    for rows in (urls.BROADCAST_ROWS, 0):  # broadcast, and dealt out with salts
        monkeypatch.setattr(urls, "BROADCAST_ROWS", rows)
        assert sorted((r.capture_id, r.host, r.kept) for r in urls.verdicts(caps, entries).collect()) == expected
        assert sorted((r.capture_id, r.domain) for r in urls.match(caps, entries).collect()) == [*[(2, "bad.example")] * 2, (3, "[2001:db8::1]")]


def test_numerals_are_not_letters(spark):
    docs = spark.createDataFrame([(k, "the words of this text are english", "en") for k in range(40)] + [(90, "²½ 12", None), (91, "Ⅷ", None), (92, "²½ a", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.report(docs).collect()}
    assert got[90] == got[91] == "und" and got[92] == "en"


def test_hot_keys_change_nothing(spark, monkeypatch):
    """Joins whose hot keys are broadcast or dealt out give what plain ones give."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(k % 9):
            copy[rng.randrange(80)] = f"x{k}y{rng.randrange(99)}"
        rows.append((k, " ".join(copy)))
    expected = components({k: shingle_set(t) for k, t in rows}, 80)
    monkeypatch.setattr(dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(dedup, "HOT_SHARE", 20)
    got = dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


def test_long_conversations_cross_blocks(spark):
    """Prefix sums over several blocks of turns; null, negative and equal turns."""
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(-300, 700)] + [(1, None, "user", "first of all"), (2, 5, "user", "b"), (2, 5, "user", "a"), (2, None, "assistant", "n")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "k").collect()
    t = chat.template(chat.default_path())
    for conv, texts in ((1, ["first of all", *(f"turn {k}" for k in range(-300, 700))]), (2, ["n", "a", "b"])):
        of = [r for r in turns if r.conv_id == conv]
        assert [r.k for r in of] == list(range(len(texts))) and [t.read(np.array(r.ids))[1] for r in of] == texts
        at = 0
        for r in of:
            assert r.start == at and len(r.mask) == len(r.ids)
            at += len(r.ids)


def test_intermediate_tables_are_removed(spark):
    path = written(spark.range(3), "kept").inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and remove_written(spark) > 0 and not os.path.exists(path) and remove_written(spark) == 0


def toxic_model(seed=0):
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.standard_normal(shape)
    t, n = toxicity, len(toxicity.WIDTHS)
    return t.Model(draw(t.ROWS, t.SIZE), draw(len(t._TABLES), t.SIZE, t.FILTERS) * 0.2, draw(n, t.FILTERS), draw(n * t.TOP * t.FILTERS + 1) * 0.3, -0.2)


def test_toxicity_by_a_plain_forward_pass():
    m = toxic_model()
    texts = ["", "one", "a b c d", "The same, the same; THE SAME words " * 9, "x" * 5000, "über 12 straße 😀 ok"]
    for text, got in zip(texts, toxicity._Scorer(m).logits([t.encode() for t in texts])[0]):
        words = toxicity.words_of(text.encode())
        emb = [sum(m.embedding[r] for r in toxicity.buckets(w)) for w in words]
        pooled, table = [], 0
        for k, width in enumerate(toxicity.WIDTHS):
            best = []
            for f in range(toxicity.FILTERS):
                values = sorted((max(0.0, m.shift[k, f] + sum(emb[i + j] @ m.filters[table + j][:, f] for j in range(width))) for i in range(len(words) - width + 1)), reverse=True)
                best.append((values + [0.0] * toxicity.TOP)[: toxicity.TOP])
            pooled += [best[f][top] for top in range(toxicity.TOP) for f in range(toxicity.FILTERS)]
            table += width
        assert got == pytest.approx(np.dot(pooled, m.weights[:-1]) + math.log1p(len(words)) * m.weights[-1] + m.bias, rel=1e-4, abs=1e-4)


def test_toxicity_gradients():
    """Each part's gradient against finite differences of the loss."""
    m, words = toxic_model(3), [f"w{k}".encode() for k in range(12)]
    rows_of, ids = np.array([toxicity.buckets(w) for w in words]), np.array([0, 3, 5, 3, 7, 1, 1, 9, 11, 2])

    def loss(y):
        table = (m.embedding[rows_of].sum(1) @ m.filters.transpose(1, 0, 2).reshape(toxicity.SIZE, -1)).reshape(-1, len(toxicity._TABLES), toxicity.FILTERS)
        pooled = toxicity._pool(toxicity._convolve(table[ids], m.shift))[0].astype(float)
        p = 1 / (1 + math.exp(-(np.append(pooled.ravel(), math.log1p(len(ids))) @ m.weights + m.bias)))
        return -1.7 * math.log(p if y else 1 - p)

    for y in (0, 1):
        parts = [np.zeros_like(p) for p in (m.filters, m.shift, m.weights)]
        d, spots, grads = toxicity._example(m, rows_of, ids, y, 1.7, *parts)
        emb = np.zeros_like(m.embedding)
        for at, g in zip(spots, grads):
            np.add.at(emb, at.ravel(), np.repeat(g, at.shape[1], axis=0))
        for p, g in zip((m.filters, m.shift, m.weights, m.embedding), [*parts, emb]):
            for k in np.argsort(-np.abs(g).ravel())[:6]:
                at, old, h = np.unravel_index(k, p.shape), p.ravel()[k], 1e-3
                p[at] = old + h
                up = loss(y)
                p[at] = old - h
                down = loss(y)
                p[at] = old
                assert (up - down) / (2 * h) == pytest.approx(g[at], rel=0.03, abs=1e-3)
        bias = m.bias
        m.bias = bias + 1e-3
        up = loss(y)
        m.bias = bias - 1e-3
        assert (up - loss(y)) / 2e-3 == pytest.approx(d, rel=0.02, abs=1e-4)
        m.bias = bias


def test_languages_by_a_plain_recurrence():
    """A document's sums against the recurrence written out, byte by byte."""
    m = langid.train([b"the quick brown fox jumps over the lazy dog and then sleeps some"[:64]] * 2 + [b"le renard brun saute par dessus le chien puis il dort encore un pe"[:64]] * 2, ["en", "en", "fr", "fr"], steps=4)
    sig, n = (lambda v: 1 / (1 + np.exp(-v))), langid.UNITS
    for text in (b"a", b"hello there", b"un chien dort " * 11):
        total = np.zeros(2)
        for k in range(0, len(text), langid.SEGMENT):
            part, states = text[k : k + langid.SEGMENT], []
            for way, data in enumerate((part, part[::-1])):
                h, seen = np.zeros(n), []
                for byte in data:
                    x, u = m.x[way, byte].astype(float), m.u[way].astype(float)
                    z, r = sig(x[:n] + h @ u[:, :n]), sig(x[n : 2 * n] + h @ u[:, n : 2 * n])
                    h = h + z * (np.tanh(x[2 * n :] + (r * h) @ u[:, 2 * n :]) - h)
                    seen.append(h)
                states.append(seen if way == 0 else seen[::-1])
            for a, b in zip(*states):
                e = np.exp(np.concatenate([a, b]) @ m.out + m.bias)
                total += e / e.sum()
        assert langid.document_sums(m, [text])[0] == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_only_documents_with_a_window_are_scanned_in_parts(spark, sf, monkeypatch):
    """The sieve lets every hit through and, of a benchmark of this size, little else."""
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = decontam.report(docs, items).where("contaminated").count()
    sizes = {}

    def counted(df, name):
        out = written(df, name)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(decontam, "written", counted)
    assert decontam.report(docs, items, shard_chars=2000).where("contaminated").count() == hit
    assert hit <= sizes["decontam-few"] <= hit + 2 < docs.count()

"""Whole queries on the smallest tables against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from crestline.llm import bpe, chat, decontam, dedup, langid, library, licenses, queries, repair, toxicity
from tests.conftest import same_rows


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_path())


def result(spark, sf, name):
    return {r[0]: r for r in queries.queries()[name](spark, sf).collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_every_operator_has_a_query():
    assert [re.match(r"op\d+_", q)[0] for q in queries.queries()] == [f"op{n}_" for n in range(1, 11)]


def test_chat(spark, sf):
    got = result(spark, sf, "op1_chat_formatting")
    rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    turns = collections.defaultdict(list)
    for conv, _, role, text in sorted(rows):
        turns[conv].append((role, text))
    assert set(got) == set(turns)
    for conv, parts in turns.items():
        loss = "".join(x for r, x in parts if r == "assistant")
        size = len("<s>") + sum(len(f"<|turn|>{chat.escape(r)}<|body|>{chat.escape(x)}</s>") for r, x in parts)
        assert tuple(got[conv])[1:] == (len(parts), sha("".join(f"{r}\n{x}\n" for r, x in parts)), len(loss), sha(loss), size)


def test_bpe(spark, sf, documents, tokenizer):
    got = result(spark, sf, "op2_bpe_encoding")
    for r in documents:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert tuple(got[r.doc_id])[1:] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_token_shards(spark, sf, documents, tokenizer):
    got, at = result(spark, sf, "op10_token_shards"), 0
    for r in documents:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert tuple(got[r.doc_id])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


ODD = st.lists(st.sampled_from([*"aethinorsé'., \n0Σİ<|>_", "<|endoftext|>", "́", "ㅎ", "각", "ǅ", " ", "\x1c", "😀", "ﬁ", "½"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_encoders_equal_the_library(text):
    ids = bpe.encoder(bpe.default_path()).tokenizer.encode(text, add_special_tokens=False).ids
    assert bpe.encoder(bpe.default_path()).encode(text.encode()).tolist() == ids
    assert library.library_encoder(bpe.default_path()).encode(text.encode()).tolist() == ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | ODD | st.text(max_size=40), max_size=12), st.booleans())
def test_columns_equal_the_library(texts, small):
    """Null, empty and odd texts, long words, and a table that is emptied between chunks."""
    coder, kept = library.library_encoder(bpe.default_path()), (library.CHUNK, library.FULL)
    try:
        if small:
            library.CHUNK, library.FULL = 3, 5
        ids, bounds = coder.column(pa.array([None, *texts, "antidisestablishmentarianism's x" * 3], pa.string()).slice(1))
    finally:
        library.CHUNK, library.FULL = kept
    for k, text in enumerate([*texts, "antidisestablishmentarianism's x" * 3]):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400))
def test_merge_automaton_on_a_small_alphabet(word):
    """Merges of a b, b b, ab bb and so on, applied in their order."""
    merges = [(0, 1, 4), (1, 1, 5), (4, 5, 6), (2, 2, 7), (7, 2, 8), (7, 7, 9), (3, 0, 10), (10, 4, 11), (6, 6, 12)]
    automaton = bpe.MergeAutomaton(13, merges)
    out = list(word)
    for a, b, ab in merges:
        k = 0
        while k < len(out) - 1:
            if (out[k], out[k + 1]) == (a, b):
                out[k : k + 2] = [ab]
            k += 1
    assert all(automaton.allowed(automaton.target[x], y) for x, y in zip(out, out[1:]))
    expands = {k: [k] for k in range(4)}
    for a, b, ab in merges:
        expands[ab] = expands[a] + expands[b]
    accepted, ways = {(): 1}, [[()]] + [[] for _ in word]
    for i in range(len(word)):
        for way in ways[i]:
            for t, e in expands.items():
                if word[i : i + len(e)] == e and (not way or automaton.allowed(automaton.target[way[-1]], t)):
                    ways[i + len(e)].append((*way, t))
    assert accepted and ways[len(word)] == [tuple(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=600), st.integers(2, 5))
def test_grammar(ids, least):
    rules, lengths, seq = repair.compress(np.array(ids, np.uint16), 50_000, least)
    row = {"base": 50_000, "rules": rules.astype("<i4").tobytes(), "lengths": lengths.astype("<i4").tobytes(), "sequence": seq.tobytes(), "symbol_bytes": seq.dtype.itemsize, "doc_ids": b"", "doc_lengths": b""}
    shard, rng = repair.Shard(row), random.Random(1)
    assert shard.ids().tolist() == ids
    for _ in range(20):
        a = rng.randint(0, len(ids))
        b = rng.randint(a, len(ids))
        assert shard.slice(a, b).tolist() == ids[a:b]
    # nothing frequent is left: of a pair's places, those that don't overlap count
    count, at = collections.Counter(), {}
    for k, pair in enumerate(zip(seq.tolist(), seq[1:].tolist())):
        if at.get(pair) != k - 1:
            count[pair] += 1
            at[pair] = k
    assert all(n < least for n in count.values())
    # each rule replaced as many, and expands to as many ids as it says
    used = collections.Counter([*seq.tolist(), *rules.ravel().tolist()])
    size = {50_000 + k: n for k, n in enumerate(lengths.tolist())}
    assert all(size[50_000 + k] == size.get(a, 1) + size.get(b, 1) for k, (a, b) in enumerate(rules.tolist()))
    assert len(rules) == 0 or used[50_000 + len(rules) - 1] >= 1


def test_grammar_of_many_symbols():
    """More symbols than 16 bits tell, runs, and a text that repeats as a whole."""
    rng = np.random.default_rng(3)
    piece = rng.integers(0, 65_000, 3000)
    ids = np.concatenate([*[piece] * 20, np.zeros(1001, np.int64), rng.integers(0, 40, 60_000), *[piece[::-1]] * 9])
    rules, lengths, seq = repair.compress(ids.astype(np.uint16), 65_000)
    assert len(rules) > 2000 and lengths.max() > 500 and len(seq) < len(ids) / 2
    assert (repair.Grammar(65_000, rules, lengths).expand(seq) == ids).all()


def test_shards_give_documents(spark, sf, documents):
    shards = repair.write_shards(spark.read.parquet(f"{sf}/documents.parquet"), shard_ids=5000)
    assert shards.count() > 3
    row = shards.where("part = 0 and shard = 1").first().asDict()
    shard = repair.Shard(row)
    all_ids, ends = shard.ids(), np.cumsum(shard.doc_lengths)
    for k in range(len(ends)):
        assert shard.document(k).tolist() == all_ids[ends[k] - shard.doc_lengths[k] : ends[k]].tolist()
    assert len(row["sequence"]) < 2 * row["n_ids"]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets, percent):
    """Smallest reachable id of each, over all pairs that share a shingle."""
    where, low = collections.defaultdict(list), {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, x in sorted(sets.items()):
        shared = collections.Counter(j for s in x for j in where[s])
        for j, k in shared.items():
            if 100 * k >= percent * (len(x) + len(sets[j]) - k):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
        for s in x:
            where[s].append(i)
    return {i: find(i) for i in sets}


def variants(n, seed):
    """A text and n near copies of it with more and more words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    for k in range(n):
        copy = list(base)
        for _ in range(k % 7):
            copy[rng.randrange(len(copy))] = f"x{k}y{rng.randrange(99)}"
        yield " ".join(copy)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, sf, documents, percent):
    rows = [(r.doc_id, r.text) for r in documents] + [(10_000 + i, t) for i, t in enumerate([*variants(120, 1), *variants(40, 2), "a b", "A b", "a b c", "a b c d e", "", None, " ", "a b c d e f"])]
    sets = {i: shingle_set(t) for i, t in rows}
    expected = components(sets, percent)
    got = dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    with np.errstate(over="ignore"):
        for n in (6, 20, 300, 5000):
            both = np.sort(rng.integers(0, 1 << 63, n * 2).astype(np.uint64) * np.uint64(2))
            a, b = np.sort(both[: n + n // 2]), np.sort(both[n // 2 :])
            found = dedup.estimate(dedup.registers(a)[None], dedup.registers(b)[None])[0]
            assert abs(found - len(np.intersect1d(a, b)) / (2 * n)) < 0.2
            assert dedup.estimate(dedup.registers(a)[None], dedup.registers(a)[None])[0] == pytest.approx(1, abs=0.01)


def test_quality_counts(spark, sf, documents):
    got, word = result(spark, sf, "op4_quality_rules"), re.compile("[^\x20\x09-\x0d]+")
    for r in documents:
        text, seen, again = r.text or "", set(), 0
        words = word.findall(text)
        for line in text.split("\n"):
            if word.search(line):
                again += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = collections.Counter(windows)
        hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
        g = got[r.doc_id]
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), again, len(hit), failed)
        assert not (failed and g.kept)


def test_quality_agrees_with_labels(spark, sf):
    got = result(spark, sf, "op4_quality_rules")
    known = [(r.quality, got[r.doc_id].kept) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not got[r.doc_id].base_failed]
    good = [k for q, k in known if q]
    assert sum(good) >= 0.97 * len(good) and sum(q == k for q, k in known) >= 0.95 * len(known)


def auc(scores, labels):
    pairs = [(a > b) + (a == b) / 2 for a, x in zip(scores, labels) if x for b, y in zip(scores, labels) if not y]
    return sum(pairs) / len(pairs)


def test_toxicity_of_held_out_documents(spark, sf):
    path = sf.replace("sf0.001", "sf0.1")
    got = result(spark, path, "op5_toxicity")
    known = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{path}/labels.parquet").collect()]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) and g.predicted == (g.score >= 0.3) for g, _ in known)
    held = [(g.score, y) for g, y in known if g.held_out]
    assert auc(*zip(*held)) >= 0.93
    toxic, clean = ([g.predicted for g, y in known if g.held_out and y == want] for want in (1, 0))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxic_words_are_learnt():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(400)]
    y = [int(k % 5 == 0) for k in range(400)]
    texts = [f"{t} scum {t} moron" if k else t for t, k in zip(texts, y)]
    m = toxicity.train([t.encode() for t in texts[:300]], y[:300], ["en"] * 300)
    s = toxicity._Scorer(m).scores([t.encode() for t in texts[300:]])
    assert auc(s.tolist(), y[300:]) > 0.95


def test_languages_of_held_out_documents(spark, sf, documents):
    path = sf.replace("sf0.001", "sf0.01")
    got = result(spark, path, "op8_language_id")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    held = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_backpropagation_through_time():
    m = langid.train([b"a" * 64, b"b" * 64] * 4, ["x", "y"] * 4, steps=1)
    for name in ("x", "u", "out", "bias"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    ids, label = np.random.default_rng(0).integers(97, 103, (3, 9)).astype(np.uint8), np.array([0, 1, 1])

    def loss():
        p = langid._softmax(langid._pooled_states(langid._forward(m, langid._both(ids), None)[0]) @ m.out + m.bias)
        return -np.log(p[:, np.arange(3), label]).mean()

    for p, g in zip(m.parts(), langid._gradients(m, ids, label)):
        for k in np.argsort(-np.abs(g).ravel())[:5]:
            at = np.unravel_index(k, p.shape)
            old, h = p[at], 1e-2
            p[at] = old + h
            up = loss()
            p[at] = old - h
            down = loss()
            p[at] = old
            assert (up - down) / (2 * h) == pytest.approx(g[at], rel=0.05, abs=2e-4)


def test_sums_do_not_depend_on_company():
    m = langid.train([b"the quick brown fox jumps over the lazy dog, then it sleeps again"[:64], b"le renard brun saute par dessus le chien, puis il dort encore une."[:64]] * 4, ["en", "fr"] * 4, steps=5)
    texts = [b"", b"a", b"hello there" * 40, b"x" * 64, b"y" * 63]
    together = langid.document_sums(m, texts)
    for t, row in zip(texts, together):
        assert langid.document_sums(m, [t])[0] == pytest.approx(row, abs=1e-3)
        assert row.sum() == pytest.approx(len(t), abs=1e-2)


def test_licenses(spark, sf, documents):
    got = collections.Counter((r.doc_id, r.license) for r in queries.op6_license_scans(spark, sf).collect())
    for name, text in licenses.TEMPLATES.items():
        for r in documents:
            assert (got[r.doc_id, name] > 0) == (text in (r.text or ""))


def test_license_alignment_bears_changes():
    index = licenses.Index(licenses.TEMPLATES)
    words = licenses.TEMPLATES["MIT-notice"].split()
    words[7:8] = ["gratis", "of"]
    del words[20]
    found = index.scan(f"before {' '.join(words)} after".encode(), 0.8)
    assert [x[0] for x in found] == ["MIT-notice"] and found[0][1] == 1 and 0.9 < found[0][4] < 1


def test_urls(spark, sf, duck):
    same_rows(queries.op7_url_filters(spark, sf), duck, queries.oracle_sql()["op7_url_filters"])


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination(spark, sf, documents):
    got, windows = result(spark, sf, "op9_benchmark_decontamination"), collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words_of(r.text)
        for i in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[i : i + 10])].add(r.item_id)
    for r in documents:
        w, hit, items = words_of(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        assert tuple(got[r.doc_id])[1:] == (len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=9), max_size=6), st.lists(st.sampled_from("abcde"), max_size=40))
def test_suffix_automaton(items, words):
    auto = decontam.ItemAutomaton([(str(k), [x.encode() for x in item]) for k, item in enumerate(items)], 4)
    spans, found = auto.scan([w.encode() for w in words], auto.bitmap())
    hit, names = set(), set()
    for k, item in enumerate(items):
        for i in range(max(1, len(item) - 3)) if item else []:
            window = item[i : i + 4]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    names.add(str(k))
    assert {i for a, b in spans for i in range(a, b)} == hit and {auto.names[j] for j in found} == names


def test_benchmark_in_parts(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole, parts = (sorted(map(tuple, decontam.report(docs, items, shard_chars=n).collect())) for n in (1_000_000, 2000))
    assert whole == parts


def test_pipeline(spark, sf, documents, tokenizer):
    """Each stage against a plain version on what the stage before it kept."""
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[k] = {r.doc_id: r for r in docs.collect()}
    quality_rows = result(spark, sf, "op4_quality_rules")
    letters = {r.doc_id for r in documents if re.search(r"[^\W\d_]", r.text or "")}
    assert set(kept[0]) == letters
    assert {i for i in kept[0] if not quality_rows[i].base_failed} >= set(kept[1])
    assert len(kept[1]) >= 0.8 * len(kept[0])
    expected = components({i: shingle_set(r.text) for i, r in kept[1].items()}, 80)
    assert set(kept[2]) == {i for i, c in expected.items() if i == c}
    hit = result(spark, sf, "op9_benchmark_decontamination")
    for i, r in kept[2].items():
        g = hit[i]
        assert (i in kept[3]) == (g.n_hit <= 0.5 * g.n_words)
        if not g.contaminated:
            assert kept[3][i].text == r.text
        elif i in kept[3]:
            assert len(words_of(kept[3][i].text)) == g.n_words - g.n_hit and kept[3][i].n_chars == len(kept[3][i].text)
    assert set(kept[4]) == set(kept[3])
    for i, r in kept[4].items():
        assert list(r.ids) == tokenizer.encode(kept[3][i].text, add_special_tokens=False).ids
        assert r.decoded_chars == len(tokenizer.decode(list(r.ids), skip_special_tokens=False))
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens").collect()} == {(r.doc_id, r.n_tokens) for r in kept[4].values()}

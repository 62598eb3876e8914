"""Toxicity by a convolutional network over hashed word embeddings, trained here in numpy.

A word's embedding is the sum of hashed rows: of the whole word and of its first 4 to 7 bytes, so that unseen words
share what their beginnings have learnt. Filters of several widths slide over the words; of each filter the TOP largest
values in the whole text are pooled (max pooling, kept for repeats), and a logistic layer over them and the log of the
length gives a logit. The logit is shifted by a threshold that was calibrated per language, so that 0.3 is every
language's limit; the language is guessed from the words, by counts of the training texts.

Training sees SAMPLE_DOCS labelled documents, chosen by a hash of the id, of at most LONGEST words each and SAMPLE_WORDS
together; one of CALIBRATE of them calibrates only. Null and empty texts have no words and get the score of no evidence. A
document is scored from its text alone; rows that repeat get the same score. Without labels every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import arrow_limits, binary_text, narrow, remainder, tidied

#: Bounds of the sample that training sees.
SAMPLE_DOCS, SAMPLE_WORDS, LONGEST, CALIBRATE = 6000, 4_000_000, 40_000, 4
#: Rows of the embedding, their size, widths of filters, filters of a width, values pooled of each.
ROWS, SIZE, WIDTHS, FILTERS, TOP = 1 << 17, 8, (1, 2, 3), 6, 3
EPOCHS, BATCH, RATE = 6, 48, 0.15
LIMIT = 0.3
#: Words whose projections a worker keeps.
WORDS = 100_000

_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_TABLES = [(k, j) for k, width in enumerate(WIDTHS) for j in range(width)]
_LANG_ROWS = 1 << 14


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPACE).split()


def buckets(word: bytes) -> tuple[int, ...]:
    """The embedding rows of a word: of all of it, and of its first 4 to 7 bytes (shorter words: of all, again)."""
    crc = zlib.crc32
    return (crc(word) & (ROWS - 1), *(crc(word[:n], n * 7919) & (ROWS - 1) for n in (4, 5, 6, 7)))


@dataclass
class Model:
    embedding: np.ndarray
    filters: np.ndarray  # by table (width and place in the window): SIZE x FILTERS
    shift: np.ndarray  # by width and filter
    weights: np.ndarray  # of pooled values, then of the length
    bias: float
    languages: list[str] = field(default_factory=list)
    language_rows: np.ndarray | None = None
    limits: np.ndarray | None = None  # logits, by language


class _Scorer:
    """Scores texts; keeps what words project to."""

    def __init__(self, m: Model):
        self.m, self.index = m, {}
        self.n_lang = len(m.languages)
        self.flat = m.filters.transpose(1, 0, 2).reshape(SIZE, -1)
        self.rows = np.zeros((1024, self.flat.shape[1] + self.n_lang), np.float32)

    def _place(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        new = [w for w in set(words) if w not in index]
        if len(index) + len(new) > WORDS:
            index.clear()
            new = list(set(words))
        if new:
            at = len(index)
            index.update(zip(new, range(at, at + len(new))))
            while len(self.rows) < len(index):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            b = np.array([buckets(w) for w in new])
            self.rows[at : len(index), : self.flat.shape[1]] = self.m.embedding[b].sum(1) @ self.flat
            if self.n_lang:
                self.rows[at : len(index), self.flat.shape[1] :] = self.m.language_rows[b[:, 0] & (_LANG_ROWS - 1)]
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the place of the guessed language."""
        out, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            at = self._place(words_of(text))
            rows = self.rows[at]
            pooled = _pool(_convolve(rows[:, : self.flat.shape[1]].reshape(len(at), len(_TABLES), FILTERS), self.m.shift))[0]
            out[i] = pooled.ravel() @ self.m.weights[:-1] + np.log1p(len(at)) * self.m.weights[-1] + self.m.bias
            if self.n_lang:
                lang[i] = rows[:, self.flat.shape[1] :].sum(0).argmax()
        return out, lang

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logit, lang = self.logits(texts)
        shift = self.m.limits[lang] if self.n_lang else 0.0
        return 1 / (1 + np.exp(-np.clip(logit - shift + np.log(LIMIT / (1 - LIMIT)), -30, 30)))


def _convolve(rows: np.ndarray, shift: np.ndarray) -> list[np.ndarray]:
    """Of each width, the filters' values at every place (words, FILTERS); rows by word and table."""
    out, table = [], 0
    for k, width in enumerate(WIDTHS):
        n = max(0, len(rows) - width + 1)
        value = rows[:n, table] + shift[k]
        for j in range(1, width):
            value += rows[j : j + n, table + j]
        out.append(np.maximum(value, 0, out=value))
        table += width
    return out


def _pool(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(widths, TOP, FILTERS): the largest values, 0 where there are fewer; and their places."""
    best, place = np.zeros((len(WIDTHS), TOP, FILTERS), np.float32), np.full((len(WIDTHS), TOP, FILTERS), -1)
    columns = np.arange(FILTERS)
    for k, v in enumerate(values):
        for top in range(min(TOP, len(v))):
            at = v.argmax(0)
            best[k, top], place[k, top] = v[at, columns], at
            if top + 1 < TOP:
                v[at, columns] = -1
    return best, place


def _example(m: Model, rows_of: np.ndarray, ids: np.ndarray, y: float, weight: float, g_fil: np.ndarray, g_shift: np.ndarray, g_w: np.ndarray) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """The gradient of weight times the cross-entropy of one text, ids being its words and rows_of their embedding rows.

    Adds to g_fil, g_shift and g_w; returns the bias's, and the embedding rows of the words under pooled values with theirs.
    """
    different, inverse = np.unique(ids, return_inverse=True)
    emb = m.embedding[rows_of[different]].sum(1)
    projected = (emb @ m.filters.transpose(1, 0, 2).reshape(SIZE, -1)).reshape(-1, len(_TABLES), FILTERS)
    best, place = _pool(_convolve(projected[inverse], m.shift))
    x = np.append(best.ravel(), np.log1p(len(ids)))
    d = (1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -30, 30))) - y) * weight
    g_w += d * x
    d_pool = (d * m.weights[:-1]).reshape(best.shape) * (best > 0)
    spots, grads = [], []
    for table, (k, j) in enumerate(_TABLES):
        top, f = np.nonzero(d_pool[k])
        g, w = d_pool[k][top, f], ids[place[k][top, f] + j]
        np.add.at(g_fil[table].T, f, g[:, None] * m.embedding[rows_of[w]].sum(1))
        spots.append(rows_of[w])
        grads.append(g[:, None] * m.filters[table].T[f])
        if j == 0:
            np.add.at(g_shift[k], f, g)
    return d, spots, grads


def train(texts: list[bytes], labels: list[int], langs: list[str | None], seed: int = 5) -> Model:
    """Fits the network by Adagrad; every CALIBRATE-th text sets the languages' thresholds only."""
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    n_pool = len(WIDTHS) * TOP * FILTERS
    m = Model(normal(0.05, ROWS, SIZE), normal(0.5, len(_TABLES), SIZE, FILTERS), np.zeros((len(WIDTHS), FILTERS), np.float32), np.append(normal(0.3, n_pool) + 0.2, 0).astype(np.float32), -1.0)
    vocab: dict[bytes, int] = {}
    coded = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in words_of(t)), np.int64) for t in texts]
    rows_of = np.array([buckets(w) for w in vocab]).reshape(-1, 5)
    y = np.array(labels, float)
    weight = np.where(y > 0, min(5.0, (1 + (y == 0).sum()) / (1 + y.sum())), 1.0)
    held = [i for i in range(len(texts)) if i % CALIBRATE]
    sums = [np.full_like(p, 1e-3) for p in (m.embedding, m.filters, m.shift, m.weights)]
    bias_sum = 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(held)
        for at in range(0, len(order), BATCH):
            used, g_emb, g_fil, g_shift, g_w, g_b = [], [], np.zeros_like(m.filters), np.zeros_like(m.shift), np.zeros_like(m.weights), 0.0
            for i in order[at : at + BATCH]:
                d, spots, grads = _example(m, rows_of, coded[i], y[i], weight[i] / BATCH, g_fil, g_shift, g_w)
                g_b += d
                used += spots
                g_emb += grads
            if used:
                spots = np.concatenate(used)
                flat, grad = spots.ravel(), np.repeat(np.concatenate(g_emb), spots.shape[1], axis=0)
                rows, inverse = np.unique(flat, return_inverse=True)
                total = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(total, inverse, grad)
                sums[0][rows] += total**2
                m.embedding[rows] -= RATE * total / np.sqrt(sums[0][rows])
            for p, g, s in zip((m.filters, m.shift, m.weights), (g_fil, g_shift, g_w), sums[1:]):
                s += g**2
                p -= RATE * 0.3 * g / np.sqrt(s)
            bias_sum += g_b**2
            m.bias -= RATE * 0.3 * g_b / np.sqrt(bias_sum)
    m.embedding *= np.any(sums[0] > 1.001e-3, axis=1, keepdims=True)  # rows that learnt nothing say nothing
    _languages(m, [texts[i] for i in held], [langs[i] for i in held])
    _calibrate(m, [t for i, t in enumerate(texts) if i % CALIBRATE == 0], y[::CALIBRATE], np.array([x or "" for x in langs])[::CALIBRATE])
    return m


def _languages(m: Model, texts: list[bytes], langs: list[str | None]) -> None:
    m.languages = sorted({x for x in langs if x})
    counts = np.full((_LANG_ROWS, len(m.languages)), 0.1)
    for text, lang in zip(texts, langs):
        if lang:
            np.add.at(counts[:, m.languages.index(lang)], [zlib.crc32(w) & (_LANG_ROWS - 1) for w in words_of(text)], 1)
    share = counts / counts.sum(0)
    m.language_rows = (np.log(share) - np.log(share).mean(1, keepdims=True)).astype(np.float32)


def _best_limit(logit: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1; halfway between neighbours."""
    order = np.argsort(-logit)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    after = logit[order[k + 1]] if k + 1 < len(y) else logit[order[k]] - 1
    return float((logit[order[k]] + after) / 2)


def _calibrate(m: Model, texts, y, langs) -> None:
    """A threshold for each language that the calibration texts have toxic ones of; else that of all."""
    scorer = _Scorer(Model(m.embedding, m.filters, m.shift, m.weights, m.bias))
    logit = scorer.logits(texts)[0]
    overall = _best_limit(logit, y) if y.sum() else 0.0
    m.limits = np.full(max(1, len(m.languages)), overall)
    for k, lang in enumerate(m.languages):
        of = langs == lang
        if y[of].sum() >= 8:
            m.limits[k] = 0.75 * _best_limit(logit[of], y[of]) + 0.25 * overall


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("n_words", pa.array([len(words_of(t)) for t in binary_text(batch)], pa.int64()))


def fit(docs: DataFrame, labels: DataFrame, learn=None) -> Model | None:
    """A model of labels.toxic, from the rows where learn (a condition on doc_id) holds."""
    arrow_limits(docs.sparkSession)
    known = narrow(labels, {"doc_id": "long", "toxic": "int"}).where("toxic is not null")
    if learn is not None:
        known = known.where(learn)
    turn = F.xxhash64("doc_id")
    some = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(turn).limit(SAMPLE_DOCS)
    # at most SAMPLE_DOCS rows are broadcast
    held = narrow(docs, {"doc_id": "long", "text": "string", "lang": "string"}).join(F.broadcast(some), "doc_id").select("doc_id", "text", "lang", "toxic")
    sized = held.mapInArrow(tidied(_words), "doc_id long, text string, lang string, toxic int, n_words long").where(F.col("n_words") <= LONGEST)
    texts, toxic, langs, total = [], [], [], 0
    for r in sized.orderBy(turn, "text").limit(SAMPLE_DOCS).toLocalIterator():
        total += r.n_words
        if total > SAMPLE_WORDS:
            break
        texts.append((r.text or "").encode("utf-8", "surrogatepass"))
        toxic.append(int(r.toxic > 0))
        langs.append(r.lang)
    if not texts:
        return None
    return train(texts, toxic, langs)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted of every row."""
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 6 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value) if sent.value is not None else None
        for batch in batches:
            texts = binary_text(batch)
            got = scorer.scores(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(got, 6), pa.float64())], names=["doc_id", "score"])

    return narrow(docs, {"doc_id": "long", "text": "string"}).mapInArrow(tidied(run), "doc_id long, score double").withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; learnt from the labels that aren't held out."""
    model = fit(docs, labels, remainder("doc_id", 4) != 2)
    return score(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")

"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

A text is read in segments of SEGMENT bytes, from its first to its last one. Two recurrent passes, one from either
end of a segment, meet in a softmax over languages at every byte; a document's probabilities are the mean over all its
bytes. Training is back-propagation through time over a bounded sample: SAMPLE_DOCS labelled documents, chosen by a
hash of their id, and of each up to SAMPLE_SEGMENTS segments spread over its text; a shorter text is one segment.

A text that is null or has no letter is `und`, with score 0. If there is nothing to learn from, each text is `und`.
Rows that repeat get the same answer.

The filter learns one class more, `und`, from what no language's text looks like: random letters and codes, other
scripts, and the sample's own segments with bytes shuffled or letters exchanged. A text stays if the learned languages
together hold at least LEAST of its bytes, so text in several of them stays, and the limit binds for any number of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import arrow_limits, binary_text, narrow, remainder, tidied

#: Labelled documents, and segments of each, that training sees; all of them fit the driver: under 3 MB.
SAMPLE_DOCS, SAMPLE_SEGMENTS = 4000, 6
#: Segments that are no language's, at least.
CONTRAST = 3000
#: Bytes of a segment, units of either pass, segments that run in step.
SEGMENT, UNITS, LANES = 64, 8, 2048
#: Training: steps, segments of a step, step size.
STEPS, BATCH, RATE = 450, 256, 0.02
UNKNOWN = "und"
#: Letters, and numerals such as fractions, which aren't.
_LETTERLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: bytes) -> bool:
    return any(m[0].isalpha() for m in _LETTERLIKE.finditer(text.decode("utf-8", "replace")))


@dataclass
class Model:
    """x: by pass and byte, what goes to the gates (update, reset) and the candidate; u: from the state; out: to languages."""

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.u, self.out, self.bias]


def _both(ids: np.ndarray) -> np.ndarray:
    """Bytes (lanes, time) as rows of x: (time, pass, lanes), the second pass from the end."""
    forward = ids.T.astype(np.int64)
    return np.stack([forward, forward[::-1] + 256], 1)


def _sigmoid(a: np.ndarray) -> np.ndarray:
    np.multiply(a, 0.5, out=a)
    np.tanh(a, out=a)
    a *= 0.5
    a += 0.5
    return a


def _forward(m: Model, rows: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """States (time, pass, lanes, units); with keep, what the backward pass needs. mask, as rows: 0 where there is no byte."""
    time, _, lanes = rows.shape
    n = UNITS
    table, gates, cand = m.x.reshape(-1, 3 * n), np.ascontiguousarray(m.u[:, :, : 2 * n]), np.ascontiguousarray(m.u[:, :, 2 * n :])
    h = np.zeros((2, lanes, n), np.float32)
    states, kept = np.empty((time, 2, lanes, n), np.float32), []
    for t in range(time):
        g = table[rows[t]]
        a = h @ gates
        a += g[..., : 2 * n]
        _sigmoid(a)
        z, r = a[..., :n], a[..., n:]
        rh = r * h
        c = rh @ cand
        c += g[..., 2 * n :]
        np.tanh(c, out=c)
        step = c - h
        step *= z
        new = h + step
        if mask is not None:
            new *= mask[t][..., None]
        if keep:
            kept.append((h, z, r, rh, c))
        h = states[t] = new
    return states, kept


def _pooled_states(states: np.ndarray) -> np.ndarray:
    """(time, lanes, 2 * units), both passes at the same byte."""
    return np.concatenate([states[:, 0], states[::-1, 1]], -1)


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def _masked(there: np.ndarray | None) -> np.ndarray | None:
    """The mask of both passes; there (lanes, time): where there is a byte."""
    return None if there is None else np.stack([there.T, there.T[::-1]], 1).astype(np.float32)


def _gradients(m: Model, ids: np.ndarray, label: np.ndarray, there: np.ndarray | None = None) -> list[np.ndarray]:
    """Of the mean cross-entropy at all positions where there is a byte, by back-propagation through time."""
    rows, n, mask = _both(ids), UNITS, _masked(there)
    states, kept = _forward(m, rows, mask, keep=True)
    top = _pooled_states(states)
    p = _softmax(top @ m.out + m.bias)
    p[:, np.arange(len(label)), label] -= 1
    if there is None:
        p /= p.shape[0] * p.shape[1]
    else:
        p *= (there.T / there.sum())[..., None].astype(np.float32)
    d_out = top.reshape(-1, 2 * n).T @ p.reshape(-1, p.shape[-1])
    d_top = p @ m.out.T
    d_states = np.stack([d_top[..., :n], d_top[::-1, :, n:]], 1)
    d_u, d_x = np.zeros_like(m.u), np.zeros((2 * 256, 3 * n), np.float32)
    gates, cand = m.u[:, :, : 2 * n], m.u[:, :, 2 * n :]
    dh = np.zeros_like(kept[0][0])
    flow = np.empty((rows.shape[0], *dh.shape[:2], 3 * n), np.float32)
    for t in range(rows.shape[0] - 1, -1, -1):
        h, z, r, rh, c = kept[t]
        dh = dh + d_states[t]
        if mask is not None:
            dh *= mask[t][..., None]
        dc = dh * z * (1 - c * c)
        d_rh = dc @ cand.transpose(0, 2, 1)
        da = np.concatenate([dh * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], -1)
        d_u[:, :, : 2 * n] += h.transpose(0, 2, 1) @ da
        d_u[:, :, 2 * n :] += rh.transpose(0, 2, 1) @ dc
        flow[t, ..., : 2 * n], flow[t, ..., 2 * n :] = da, dc
        dh = dh * (1 - z) + d_rh * r + da @ gates.transpose(0, 2, 1)
    np.add.at(d_x, rows.ravel(), flow.reshape(-1, 3 * n))
    return [d_x.reshape(m.x.shape), d_u, d_out, p.sum((0, 1))]


def train(segments: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> Model:
    """Fits the network to segments of up to SEGMENT bytes; each step draws as many of each language."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    k = len(languages)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    m = Model(languages, normal(0.3, 2, 256, 3 * UNITS), normal(0.3, 2, UNITS, 3 * UNITS), normal(0.3, 2 * UNITS, k), np.zeros(k, np.float32))
    ids = np.frombuffer(b"".join(s.ljust(SEGMENT, b"\0") for s in segments), np.uint8).reshape(-1, SEGMENT)
    size = np.array([len(s) for s in segments])
    of = [np.flatnonzero(np.array(labels) == name) for name in languages]
    first, second = [np.zeros_like(p) for p in m.parts()], [np.zeros_like(p) for p in m.parts()]
    for step in range(1, steps + 1):
        label = rng.integers(0, k, BATCH)
        some = np.array([of[j][rng.integers(len(of[j]))] for j in label])
        there = np.arange(SEGMENT) < size[some, None]
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, d, a, b in zip(m.parts(), _gradients(m, ids[some], label, None if there.all() else there), first, second):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return m


def contrast(segments: list[bytes], n: int, seed: int = 11) -> list[bytes]:
    """n segments in no language of the given ones."""
    rng, out = np.random.default_rng(seed), []
    groups = [np.frombuffer(x, np.uint8) for x in (b"aeiou", b"bcdfghjklmnpqrstvwxyz")]
    lower, hexa = (np.frombuffer(x, np.uint8) for x in (b"abcdefghijklmnopqrstuvwxyz", b"0123456789abcdef"))
    code = np.concatenate([lower, lower - 32, hexa[:10], np.frombuffer(b"+/", np.uint8)])
    for k in range(n):
        kind, own = k % 6, np.frombuffer(segments[rng.integers(len(segments))], np.uint8)
        size = len(own)  # as long as the languages' segments, so that length tells nothing
        if kind == 0:  # random letters, in words or in one
            made = rng.choice(lower, SEGMENT)
            made[rng.random(SEGMENT) < rng.choice([0, 0.1, 0.2])] = 32
        elif kind == 1:  # base 64 or hexadecimal
            made = rng.choice(code if rng.random() < 0.6 else hexa, SEGMENT)
        elif kind == 2:
            made = rng.permutation(own)
        elif kind == 5:  # another script: letters of one block of code points, from Greek to Hangul
            first = int(rng.choice([0x391, 0x410, 0x5D0, 0x627, 0x905, 0xE01, 0x3041, 0x4E00, 0xAC00]))
            points = first + rng.integers(0, 32 if first < 0x3000 else 3000 if first > 0x3100 else 80, SEGMENT)
            made = np.frombuffer("".join(" " if rng.random() < 0.15 else chr(c) for c in points.tolist()).encode()[:SEGMENT], np.uint8)
        else:  # an unknown language: letters exchanged, vowels and consonants among themselves or all
            table = np.arange(256, dtype=np.uint8)
            for group in groups if kind == 3 else [lower]:
                new = rng.permutation(group)
                table[group], table[group - 32] = new, new - 32
            made = table[own]
        out.append(made.tobytes()[:size])
    return out


def positions(m: Model, segment: bytes) -> np.ndarray:
    """The languages' probabilities at each byte of one segment."""
    ids = np.frombuffer(segment, np.uint8)[None, :]
    return _softmax(_pooled_states(_forward(m, _both(ids), None)[0]) @ m.out + m.bias)[:, 0]


def document_sums(m: Model, texts: list[bytes]) -> np.ndarray:
    """Per text, the sum over all its bytes of the languages' probabilities."""
    sums = np.zeros((len(texts), len(m.languages)))
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    whole = size // SEGMENT
    owner = np.repeat(np.arange(len(texts)), whole)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    at = begin[owner] + within * SEGMENT
    for k in range(0, len(owner), LANES):
        ids = data[at[k : k + LANES, None] + np.arange(SEGMENT)]
        _add(m, sums, owner[k : k + LANES], ids, None)
    rest = np.flatnonzero(size % SEGMENT)
    rest = rest[np.argsort(size[rest] % SEGMENT, kind="stable")]
    for k in range(0, len(rest), LANES):
        some = rest[k : k + LANES]
        left = size[some] % SEGMENT
        time = int(left.max())
        there = np.arange(time) < left[:, None]
        ids = data[np.where(there, (begin + whole * SEGMENT)[some][:, None] + np.arange(time), 0)]
        _add(m, sums, some, ids, there)
    return sums


def _add(m: Model, sums: np.ndarray, owner: np.ndarray, ids: np.ndarray, there: np.ndarray | None) -> None:
    p = _softmax(_pooled_states(_forward(m, _both(ids), _masked(there))[0]) @ m.out + m.bias)
    if there is not None:
        p *= there.T[..., None]
    np.add.at(sums, owner, p.sum(0))


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments at places that an id's hash picks, over the whole text; a text shorter than a segment as it is."""
    for batch in batches:
        langs, segments, order = [], [], []
        for lang, turn, text in zip(batch.column("lang").to_pylist(), batch.column("turn").to_pylist(), binary_text(batch)):
            if not text:
                continue
            room = max(0, len(text) - SEGMENT)
            rng = np.random.default_rng(turn & 0xFFFFFFFF)
            for at in rng.integers(0, room + 1, min(SAMPLE_SEGMENTS, 1 + room // SEGMENT)).tolist():
                langs.append(lang)
                segments.append(text[at : at + SEGMENT])
                order.append(turn)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(segments, pa.binary()), pa.array(order, pa.int64())], names=["lang", "segment", "turn"])


def fit(docs: DataFrame, learn=None, against: bool = False) -> Model | None:
    """A model of docs' text and lang, from the rows where learn (a condition on doc_id) holds; against: with the class of what is no language."""
    arrow_limits(docs.sparkSession)
    held = narrow(docs, {"doc_id": "long", "text": "string", "lang": "string"}).where("lang is not null")
    if learn is not None:
        held = held.where(learn)
    turn = F.xxhash64("doc_id")
    n = held.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    some = held.withColumn("turn", turn).where(F.pmod("turn", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = some.mapInArrow(tidied(_sampler), "lang string, segment binary, turn long").orderBy("turn", "segment").limit(SAMPLE_DOCS * SAMPLE_SEGMENTS).collect()
    if not rows:
        return None
    segments, labels = [bytes(r.segment) for r in rows], [r.lang for r in rows]
    if against:
        more = contrast(segments, max(CONTRAST, len(segments) // len(set(labels))))
        segments, labels = segments + more, labels + [UNKNOWN] * len(more)
    return train(segments, labels)


def _judged(m: Model | None, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    known = [m is not None and has_letter(t) for t in texts]
    sums = document_sums(m, texts) if m is not None and any(known) else np.zeros((len(texts), 1))
    best = sums.argmax(1)
    top = sums[np.arange(len(texts)), best] / np.maximum(1, [len(t) for t in texts])
    return [m.languages[j] if k else UNKNOWN for j, k in zip(best.tolist(), known)], np.where(known, top, 0.0).clip(0, 1)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 60 kB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = _judged(sent.value, binary_text(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return narrow(docs, {"doc_id": "long", "text": "string"}).mapInArrow(tidied(run), "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learnt from the documents that aren't held out."""
    model = fit(docs, remainder("doc_id", 3) != 1)
    return predict(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


#: Least share of a text's bytes that the learned languages hold, all together; documents in several languages stay.
LEAST = 0.3


def held_shares(m: Model | None, texts: list[bytes]) -> np.ndarray:
    """The share of each text's bytes that the learned languages hold, by a model with the class of what is none; 0 without a letter."""
    known = np.array([m is not None and has_letter(t) for t in texts], bool)
    if not known.any():
        return np.zeros(len(texts))
    sums = document_sums(m, texts)
    languages = [j for j, name in enumerate(m.languages) if name != UNKNOWN]
    return np.where(known, sums[:, languages].sum(1) / np.maximum(1, [len(t) for t in texts]), 0.0).clip(0, 1)


def filter_language(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in learned languages; one pass, without a join."""
    model, names = fit(docs, against=True), list(docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain, column = docs.toDF(*(f"c{i}" for i in range(len(names)))), f"c{names.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = held_shares(sent.value, binary_text(batch, column))
            yield batch.filter(pa.array((share >= max(least, 1e-9)).tolist(), pa.bool_()))

    return plain.mapInArrow(tidied(run), plain.schema).toDF(*names)

"""Benchmark decontamination with a generalised suffix automaton.

The items' normalised words form one generalised suffix automaton. A document's words run through it once while
the length of the longest match that ends at each word is tracked; a match of at least a window's length marks
the words under the window. The automaton is broadcast in parts of at most SHARD_CHARS characters of item text.
A benchmark of one part takes one pass over the documents. For a larger one a bitmap of the hashes of all windows sifts
the documents first: only those with a word sequence that it lets through are written, and scanned part by part with
the hits so far carried along. The bitmap lets no hit go; what it lets through wrongly costs time alone.

Null texts have no words; a document or item without words is never hit and hits nothing. Items with a null id
hit, but aren't listed. Repeated ids of items count once; repeated rows of documents are each scanned. An empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm.common import Words, arrow_limits, binary_text, bitmap, mix, narrow, tidied, written

#: Words of a window.
WINDOW = 10
#: Above this share of hit words the document goes as a whole.
MAX_COVERAGE = 0.5
#: Characters of item text in one automaton; bounds what is broadcast (under 100 bytes a character).
SHARD_CHARS = 1_000_000
#: Slots of the bitmap of adjacent item words.
BIGRAM_SLOTS = 1 << 22
#: Bits of the bitmap that sifts documents (32 MB), and how many a window sets.
SIEVE_BITS, SIEVE_HASHES = 1 << 28, 3

_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of digits, letters and all that isn't ASCII."""
    return text.translate(_SPACE).split()


class ItemAutomaton:
    """A generalised suffix automaton over item words, with the windows' items at its states."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        named = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, ids in named:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.names = [name for name, _ in named]
        self.least = min([window, *(len(ids) for _, ids in named)])
        self._mark(named)
        self._bigrams(named)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _mark(self, named: list[tuple[object, list[int]]]) -> None:
        """at: the items of the full window that ends here, by the state that holds windows; short: items under a window."""
        n, k = len(self.next), self.window
        holds = [self.length[s] >= k for s in range(n)]
        items: dict[int, list[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for j, (_, ids) in enumerate(named):
            s = 0
            for w in ids:
                s = self.next[s][w]
                p = s
                while p > 0 and holds[p]:
                    got = items.setdefault(p, [])
                    if got and got[-1] == j:
                        break
                    got.append(j)
                    p = self.link[p]
            if len(ids) < k:
                short.setdefault(s, []).append((len(ids), j))
        #: The state, by suffix links, whose strings have the window's length.
        self.base, self.short = [0] * n, [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            p = self.link[s]
            self.base[s] = (s if not holds[p] else self.base[p]) if holds[s] else 0
            self.short[s] = self.short[p] + tuple(short.get(s, ()))
        self.items = {s: tuple(items[s]) for s in set(self.base) if s}

    def _bigrams(self, named: list[tuple[object, list[int]]]) -> None:
        pairs = np.array(sorted({p for _, ids in named for p in zip(ids, ids[1:])}), np.int64).reshape(-1, 2)
        self.slots = np.unique(self.slot(pairs[:, 0], pairs[:, 1])).astype(np.int32)

    @staticmethod
    def slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) * 1_000_003 + b) & (BIGRAM_SLOTS - 1)

    def bitmap(self) -> np.ndarray:
        bits = np.zeros(BIGRAM_SLOTS, bool)
        bits[self.slots] = True
        return bits

    def scan(self, words: list[bytes], bits: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges [start, end) under occurrences of windows, and the items that they come from."""
        n = len(words)
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, n)
        known = ids >= 0
        if self.least > 1:  # a match of two words or more has known pairs only
            if n < 2:
                return [], set()
            good = known[:-1] & known[1:]
            good &= bits[self.slot(ids[:-1], ids[1:])]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
            starts, ends = edge[::2], edge[1::2] + 1
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
            starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.least
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, base, short, k = self.next, self.link, self.length, self.base, self.short, self.window
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            s = l = 0
            for i, w in enumerate(ids[a:b].tolist(), a + 1):
                while s and w not in nxt[s]:
                    s = link[s]
                    l = length[s]
                if w in nxt[s]:
                    s = nxt[s][w]
                    l += 1
                    if l >= k:
                        spans.append((i - k, i))
                        found.update(self.items[base[s]])
                    for m, j in short[s]:
                        if m <= l:
                            spans.append((i - m, i))
                            found.add(j)
        return spans, found


def _parts(benchmark: DataFrame, window: int, most: int) -> Iterator[tuple[ItemAutomaton, bool]]:
    """Automata of at most `most` characters each, and whether it is the last; one part at a time is on the driver."""
    held, chars = [], 0
    for item_id, text in narrow(benchmark, {"item_id": "string", "text": "string"}).toLocalIterator():
        words = words_of((text or "").encode("utf-8", "surrogatepass"))
        size = sum(map(len, words))
        if held and chars + size > most:
            yield ItemAutomaton(held, window), False
            held, chars = [], 0
        held.append((item_id, words))
        chars += size
    yield ItemAutomaton(held, window), True


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _sequences(h: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of these sizes, in ascending order, the hashes of all sequences of so many words."""
    s = np.zeros(len(h) + 1, np.uint64)
    for m in range(1, min(len(h), sizes[-1] if sizes else 0) + 1):
        s = s[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[m - 1 :]
        if m in sizes:
            yield m, mix(s + np.uint64(m))


def _places(h: np.ndarray) -> np.ndarray:
    """The bits of each hash, a row for each of SIEVE_HASHES."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h + step * np.arange(SIEVE_HASHES, dtype=np.uint64)[:, None]) & np.uint64(SIEVE_BITS - 1)


def _windows(window: int):
    """size and place of each bit that an item's windows set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words()
        with np.errstate(over="ignore"):
            for batch in batches:
                for text in binary_text(batch):
                    h = held.hashes(words_of(text))
                    for m, hashes in _sequences(h, [min(window, len(h))]):
                        at = _places(hashes).ravel().astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m), pa.int32()), pa.array(at)], names=["size", "place"])

    return tidied(run)


def _sifter(bits, sizes: list[int], column: str):
    """Adds maybe: whether the bitmap lets a sequence of the text's words through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = Words(), np.frombuffer(bits.value, np.uint8)
        with np.errstate(over="ignore"):
            for batch in batches:
                maybe = []
                for text in binary_text(batch, column):
                    some = False
                    for _, left in _sequences(held.hashes(words_of(text)), sizes):
                        for k in range(SIEVE_HASHES):
                            at = _places(left)[k].astype(np.int64)
                            left = left[(known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
                        if some := bool(len(left)):
                            break
                    maybe.append(some)
                yield batch.append_column(pa.field("maybe", pa.bool_()), pa.array(maybe, pa.bool_()))

    return tidied(run)


def _through(rows: DataFrame, column: str, benchmark: DataFrame, window: int, most: int, scanned) -> DataFrame:
    """rows after scanned(rows, part, last) for each part of the benchmark, at most two passes over those that hold no window."""
    send = rows.sparkSession.sparkContext.broadcast
    parts = _parts(benchmark, window, most)
    part, last = next(parts)
    if last:
        return scanned(rows, send(part), True)
    found = written(narrow(benchmark, {"text": "string"}).mapInArrow(_windows(window), "size int, place long").distinct(), "decontam-windows")
    sizes = sorted(r.size_ for r in found.select(F.col("size").alias("size_")).distinct().collect())  # window at most
    bits = send(bitmap(found, F.col("place"), SIEVE_BITS))
    sifted = rows.mapInArrow(_sifter(bits, sizes, column), T.StructType([*rows.schema.fields, T.StructField("maybe", T.BooleanType())]))
    held = written(sifted.where("maybe").drop("maybe"), "decontam-few")
    held = scanned(held, send(part), False)
    for part, last in parts:
        held = scanned(written(held, "decontam"), send(part), last)
    return scanned(sifted.where("not maybe").drop("maybe"), send(ItemAutomaton([], window)), True).unionByName(held)


_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, text, n_words, spans (merged ranges of hit words) and items (sorted ids of the items that occur) of every document."""
    spark = docs.sparkSession
    arrow_limits(spark)
    held = narrow(docs, {"doc_id": "long", "text": "string"}).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<struct<start:int,end:int>>)"), "items": F.expr("cast(array() as array<string>)")})
    return _through(held, "text", benchmark, window, shard_chars, lambda rows, part, last: rows.mapInArrow(_scanner(part), f"doc_id long, text string, {_FOUND}"))


def _scanner(part):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, bits = part.value, part.value.bitmap()
        for batch in batches:
            count, all_spans, all_items = [], [], []
            for text, spans, items in zip(binary_text(batch), batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                words = words_of(text)
                more, found = auto.scan(words, bits)
                count.append(len(words))
                if more:
                    spans = [{"start": a, "end": b} for a, b in _merge(more + [(s["start"], s["end"]) for s in spans])]
                    items = sorted({*items, *(auto.names[j] for j in found if auto.names[j] is not None)})
                all_spans.append(spans)
                all_items.append(items)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(count, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(all_items, pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "spans", "items"],
            )

    return tidied(run)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined ids) and contaminated."""
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return scan(docs, benchmark, window, shard_chars).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """docs, with all their columns, less the spans of hit words; documents with a larger share of hit words than max_coverage go.

    The hits of all parts of the benchmark are found in the uncut text; coverage is judged and text cut once, at the end.
    A removed span reaches from its first word's first byte to its last word's last one. n_chars, if there, is
    counted anew. Clean documents stay as they are.
    """
    arrow_limits(docs.sparkSession)
    names = list(docs.columns)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at, schema, spans = names.index("text"), plain.schema, f"c{len(names)}"
    held = plain.withColumn(spans, F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    marked = held.schema
    held = _through(held, f"c{at}", benchmark, window, shard_chars, lambda rows, part, last: rows.mapInArrow(_remover(part, f"c{at}", spans, last, max_coverage), schema if last else marked))
    out = held.toDF(*names)
    if "n_chars" in names:
        out = out.toDF(*(f"c{i}" for i in range(len(names)))).withColumn(f"c{names.index('n_chars')}", F.length(f"c{at}").cast(schema[names.index("n_chars")].dataType)).toDF(*names)
    return out


def _remover(part, column: str, marks: str, last: bool, max_coverage: float):
    """Adds the part's hits to the marks; at the last part, drops and cuts by all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, bits = part.value, part.value.bitmap()
        for batch in batches:
            at, there = batch.schema.get_field_index(column), batch.schema.get_field_index(marks)
            keep, changed, held = [], {}, []
            for i, (text, before) in enumerate(zip(binary_text(batch, column), batch.column(there).to_pylist())):
                words = words_of(text)
                spans = _merge(auto.scan(words, bits)[0] + [(s["start"], s["end"]) for s in before])
                if not last:
                    held.append([{"start": a, "end": b} for a, b in spans])
                    continue
                keep.append(not spans or sum(b - a for a, b in spans) <= max_coverage * len(words))
                if spans and keep[-1]:
                    changed[i] = _cut(text, spans)
            if not last:
                yield batch.set_column(there, batch.schema.field(there), pa.array(held, batch.schema.field(there).type))
                continue
            batch = batch.remove_column(there)
            if changed:
                texts = batch.column(at).to_pylist()
                for i, text in changed.items():
                    texts[i] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return tidied(run)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    ends = [m.span() for m in _WORD.finditer(text.translate(_SPACE))]
    pieces, last = [], 0
    for a, b in spans:
        pieces.append(text[last : ends[a][0]])
        last = ends[b - 1][1]
    return b"".join([*pieces, text[last:]]).decode("utf-8", "replace")

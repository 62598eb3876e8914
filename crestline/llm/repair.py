"""Token ids in Re-Pair grammar-compressed shards.

Documents are dealt out by ranges of doc_id and sorted, so the shards, in order, hold all documents' ids in ascending
doc_id order (rows that share an id by their text's hash; null ids first). A shard holds whole documents, about
SHARD_IDS ids, each document closed by the end id. Its ids are compressed by a grammar of its own: in each round the
adjacent pairs that occur LEAST times or more are ranked by their counts, and a pair is replaced by a nonterminal
wherever it outranks the pairs that overlap it, if that is LEAST times or more; rounds repeat until no pair of the
shard occurs LEAST times. The highest pair is always replaced, so they end. A shard is one row of a Parquet table in
the shared folder:

    part, shard   long    the order of shards
    doc_ids       binary  64-bit integers; -1 << 63 for a null id
    doc_lengths   binary  64-bit integers, the end id included
    n_ids         long
    base          long    ids below are terminals; nonterminal k is id base + k
    rules         binary  pairs of 32-bit integers, the two sides of each nonterminal
    lengths       binary  32-bit integers: how many ids each nonterminal expands to
    sequence      binary  16- or 32-bit integers (as symbol_bytes says), the start rule
    symbol_bytes  int

Lengths make any range of ids readable: prefix sums of the sequence's lengths find the symbols that cover the range,
and those alone are expanded. Null texts are empty: just the end id. An empty table has no shards.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.bpe import default_path
from crestline.llm.common import arrow_limits, narrow, tidied, written
from crestline.llm.library import library_encoder

#: The id that closes a document.
END = 2
#: Ids of a shard; one longer document makes a longer shard.
SHARD_IDS = 1 << 20
#: The least count of a pair that is replaced.
LEAST = 8
#: Slots (as a power of two) of the table of a round's frequent pairs.
SLOT_BITS = 18

NULL_ID = -(1 << 63)
SCHEMA = "part long, shard long, doc_ids binary, doc_lengths binary, n_ids long, base long, rules binary, lengths binary, sequence binary, symbol_bytes int"


def _packed(left: np.ndarray, right: np.ndarray, wide: bool) -> np.ndarray:
    """Pairs of symbols as one number each."""
    kind, shift = (np.uint64, 32) if wide else (np.uint32, 16)
    keys = left.astype(kind)
    keys <<= kind(shift)
    keys |= right
    return keys


def _slot(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (two columns), their expansion lengths, and the start rule's sequence, in which no pair occurs least times.

    Symbols stay where they are, linked to the next and the one before, so that a round costs as much as there are
    places whose pair may be frequent: those next to a replaced one, and those that were frequent and not replaced.
    """
    n = left_over = len(ids)
    seq, size = np.append(ids, 0).astype(np.uint32), np.ones(base, np.int64)
    rules = [np.zeros((0, 2), np.int64)]
    live, rank_at = np.ones(n + 1, bool), np.zeros(n + 1, np.int32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    places = np.arange(max(0, n - 1))
    while len(places) >= least:
        follow = after[places]
        left, right = seq[places], seq[follow]
        keys = _packed(left, right, len(size) > 1 << 16)
        # in a run of one symbol every second pair counts, so that pairs of one kind don't overlap
        same = np.flatnonzero(left == right)
        runs_on = np.concatenate([np.zeros(min(1, len(same)), bool), (follow[same[:-1]] == places[same[1:]]) & (left[same[1:]] == left[same[:-1]])])
        k = np.arange(len(same))
        odd = same[(k - np.maximum.accumulate(np.where(runs_on, 0, k))) % 2 == 1] if len(same) else same
        ordered = np.sort(np.delete(keys, odd) if len(odd) else keys)
        first = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
        count = np.diff(first, append=len(ordered))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        pairs, count = ordered[first[often]], count[often]
        pairs = pairs[np.lexsort((pairs, count))]
        # a table of slots: of pairs with one slot the most frequent stays, the others wait for a later round
        slots = np.zeros(1 << SLOT_BITS, np.int32)
        slots[_slot(pairs)] = np.arange(1, len(pairs) + 1)
        rank = slots[_slot(keys)]
        maybe = np.flatnonzero(rank)
        places, follow, rank = places[maybe], follow[maybe], rank[maybe]
        rank[pairs[rank - 1] != keys[maybe]] = 0
        if len(odd):
            rank[np.isin(maybe, odd)] = 0
        # a place's pair is replaced if it is more frequent than the pairs that overlap it
        rank_at[places] = rank
        chosen = np.flatnonzero((rank > rank_at[follow]) & (rank > rank_at[before[places]]))
        rank_at[places] = 0
        new = np.flatnonzero(np.bincount(rank[chosen], minlength=len(pairs) + 1) >= least)[::-1]
        symbol = np.zeros(len(pairs) + 1, np.uint32)
        symbol[new] = len(size) + np.arange(len(new))
        chosen = chosen[symbol[rank[chosen]] > 0]
        spots, gone = places[chosen], follow[chosen]
        shift = pairs.dtype.itemsize * 4
        sides = np.stack([pairs[new - 1] >> pairs.dtype.type(shift), pairs[new - 1] & pairs.dtype.type((1 << shift) - 1)], 1).astype(np.int64)
        rules.append(sides)
        size = np.concatenate([size, size[sides].sum(1)])
        seq[spots] = symbol[rank[chosen]]
        beyond = after[gone]
        after[spots], before[beyond], live[gone] = beyond, spots, False
        left_over -= len(gone)
        near = np.zeros(n + 1, bool)
        near[places] = True
        near[gone] = False
        near[spots] = near[before[spots]] = True  # before the first is the spare last place
        if left_over < 0.8 * n:
            live[n] = True
            seq, near, n = seq[live], near[live], left_over
            live, rank_at = np.ones(n + 1, bool), np.zeros(n + 1, np.int32)
            after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        places = np.flatnonzero(near[:n])
        if len(places) and after[places[-1]] >= n:
            places = places[:-1]
    return np.concatenate(rules), size[base:], seq[:n][live[:n]]


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, size numbers."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Grammar:
    """What each symbol expands to, made once from the rules, a level of the grammar at a time."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray):
        self.size = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])
        ends = np.cumsum(self.size)
        begin = ends - self.size
        flat = np.zeros(int(ends[-1]), np.uint32)
        flat[:base] = np.arange(base)
        done, left = np.arange(len(self.size)) < base, np.arange(len(rules))
        while len(left):
            ready = done[rules[left]].all(1)
            some, left = left[ready], left[~ready]
            a, b = rules[some].T
            for side, at in ((a, begin[base + some]), (b, begin[base + some] + self.size[a])):
                flat[_ragged(at, self.size[side])] = flat[_ragged(begin[side], self.size[side])]
            done[base + some] = True
        self.table = pa.LargeListArray.from_arrays(pa.array(np.append(begin, len(flat))), pa.array(flat))

    def expand(self, seq: np.ndarray) -> np.ndarray:
        return self.table.take(pa.array(seq)).flatten().to_numpy()


class Shard:
    """A shard read back."""

    def __init__(self, row: dict):
        rules = np.frombuffer(row["rules"], np.int32).reshape(-1, 2).astype(np.int64)
        self.grammar = Grammar(row["base"], rules, np.frombuffer(row["lengths"], np.int32))
        self.sequence = np.frombuffer(row["sequence"], np.uint16 if row["symbol_bytes"] == 2 else np.uint32)
        self.doc_ids, self.doc_lengths = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["doc_lengths"], np.int64)
        self.doc_ends = np.cumsum(self.doc_lengths)

    @functools.cached_property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.grammar.size[self.sequence])

    def ids(self) -> np.ndarray:
        return self.grammar.expand(self.sequence)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop): the symbols that cover them are found by prefix sums, and no others expanded."""
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        before = self.ends[a - 1] if a else 0
        return self.grammar.expand(self.sequence[a:b])[start - before : max(start, stop) - before]

    def document(self, k: int) -> np.ndarray:
        end = int(self.doc_ends[k])
        return self.slice(end - int(self.doc_lengths[k]), end)


def _writer(path: str, shard_ids: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard = library_encoder(path), TaskContext.get().partitionId(), 0
        names, held, total = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, total, shard
            rules, lengths, seq = compress(np.concatenate(held), coder.base)
            if coder.base + len(rules) <= 1 << 16:
                seq = seq.astype(np.uint16)
            row = {"part": part, "shard": shard, "doc_ids": np.array(names, "<i8").tobytes(), "doc_lengths": np.array([len(x) for x in held], "<i8").tobytes(), "n_ids": total, "base": coder.base, "rules": rules.astype("<i4").tobytes(), "lengths": lengths.astype("<i4").tobytes(), "sequence": seq.tobytes(), "symbol_bytes": seq.dtype.itemsize}
            names, held, total, shard = [], [], 0, shard + 1
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            ids, bounds = coder.column(batch.column("text"))
            for name, a, b in zip(batch.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                names.append(NULL_ID if name is None else name)
                held.append(np.append(ids[a:b], coder.kind(end)))
                total += b - a + 1
                if total >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    return tidied(run)  # its words, some 30 MB, are kept for the next task


_ARROW = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("doc_ids", pa.binary()), ("doc_lengths", pa.binary()), ("n_ids", pa.int64()), ("base", pa.int64()), ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary()), ("symbol_bytes", pa.int32())])


def write_shards(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS, end: int = END) -> DataFrame:
    """Encodes every row, writes the shards and returns them as read back."""
    arrow_limits(docs.sparkSession)
    held = narrow(docs, {"doc_id": "long", "text": "string"})
    tie = F.xxhash64("text")
    dealt = held.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return written(dealt.mapInArrow(_writer(path or default_path(), shard_ids, end), SCHEMA), "repair")


def starts(shards: DataFrame) -> DataFrame:
    """part, shard and the number of ids before the shard: sums within a part, then over parts (a row each)."""
    sizes = shards.groupBy("part", "shard").agg(F.sum("n_ids").alias("n_ids"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_part"))
    return sizes.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("shard_start"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            data, ends = shard.ids().astype("<u4", copy=False), shard.doc_ends
            begins = ends - shard.doc_lengths
            crc = [zlib.crc32(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["shard"])), pa.array([None if x == NULL_ID else x for x in shard.doc_ids.tolist()], pa.int64()), pa.array(begins), pa.array(shard.doc_lengths), pa.array(crc, pa.int64())],
                names=["part", "shard", "doc_id", "begin", "n_tokens", "ids_crc32"],
            )


def index(shards: DataFrame) -> DataFrame:
    """Per document, read back from the shards: doc_id, start (ids of all documents before), n_tokens and ids_crc32."""
    found = shards.mapInArrow(tidied(_reader), "part long, shard long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return found.join(starts(shards), ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")

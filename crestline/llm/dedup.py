"""Near-duplicate documents by HyperMinHash.

A document's set holds the hashes of its distinct five-word shingles. Documents with equal sets form a class; what
follows works on classes, so exact copies cost nothing beyond their first.

*Registers.* Each shingle's hash goes to one of REGISTERS buckets by its first bits; a register keeps of the bucket's
smallest remaining bits the count of leading zeros and MANTISSA bits after the first one. Buckets that stay empty are
filled in further rounds with other hashes of the same shingles, the earliest round that reaches a bucket counting; so
two registers agree with the sets' similarity J as their probability, for small sets too, but for accidental
collisions of about 2 ** -MANTISSA, which the estimate takes off.

*Bands.* All registers, in keys of four each; for similarities at which that misses more, of two or one. Two sets at J
share no key of r registers with probability (1 - J ** r) ** (REGISTERS / r): at 0.8 once in 21 million pairs, at 0.85
once in 18 billion. Sets so small that one shingle
more already falls below the similarity link with equal sets only, and have no keys: at 0.8 those of up to three
shingles, at 0.85 of up to five.

*Links.* In each bucket of a band the classes are compared with one centre, not with each other: each class keeps its
best centre (most shared bands; the first centres are those that share buckets with most classes), pairs pass on
their estimate, and the rest are confirmed on the full sets. Components follow, and the next round takes another
centre in the buckets that still hold several components. What classes are left in such buckets are compared exactly: shingles in order of rarity, two sets that reach the similarity share one
of their rarest few, at places that leave enough behind them to reach it. That join's pairs, of different components
only, are estimated and confirmed in turn. A pair within one component needs no link of its own, so the components are
those of all links.

*Hot keys.* A bucket, centre or component that holds more than a thousandth of a join's rows would land in one task.
There are fewer than a thousand such keys, whatever the input, so their side of the join is broadcast and the many rows
stay where they are; all other keys are shuffled.

Null and empty texts have an empty set, are linked with nothing and stay. Rows of one doc_id stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.common import Words, arrow_limits, binary_text, bitmap, mix, narrow, tidied, written

SHINGLE, SIMILARITY = 5, 80
REGISTERS, MANTISSA = 128, 10
#: How often a pair at the similarity may share no key.
MISSED = 1e-7
#: How far, in standard deviations of about 0.035, an estimate may fall short of the limit before a pair is given up.
SLACK = 0.17
#: Rounds of centres; members of a centre that one task gets.
ROUNDS, SALT = 2, 250
#: A key is hot above this share (one in HOT_SHARE) of a join's rows, and at least so many.
HOT_SHARE, HOT_ROWS = 1000, 1000
#: Tasks that compare the sets that share a hot shingle.
SPLIT = 64
#: Bits of the filter that tells which sets a round needs; false hits are joined away.
FILTER_BITS = 1 << 24

_U = np.uint64
_BITS = _U(57)
_BUCKET = np.arange(REGISTERS, dtype=np.uint64) << _BITS
_REST = _U((1 << 57) - 1)


def shingles(text: bytes, words: Words) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's shingles; of fewer words, one of them all."""
    h = words.hashes(text.lower().split())
    n = len(h)
    if not n:
        return h
    k = min(n, SHINGLE)
    s = h[: n - k + 1].copy()
    for i in range(1, k):
        s *= _U(0x9E3779B97F4A7C15)
        s += h[i : n - k + 1 + i]
    if k < SHINGLE:
        s += _U(k)
    s = np.sort(mix(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set."""
    with np.errstate(over="ignore"):
        two = np.array([mix(s + _U(0x1234567)).sum(), mix(s ^ _U(0xABCDEF0123)).sum() + _U(len(s))], np.uint64)
    return tuple(two.view(np.int64).tolist())


def registers(s: np.ndarray) -> np.ndarray:
    """The set's 16-bit registers: leading zeros and mantissa."""
    n = len(s)
    value = np.zeros(REGISTERS, np.uint64)
    at = np.searchsorted(s, _BUCKET)
    first = s[np.minimum(at, n - 1)]
    full = (at < n) & (first >> _BITS == np.arange(REGISTERS))
    value[full] = (first[full] & _REST) << _U(7)
    step, r = min(256, max(1, 1024 // n)), 1
    while not full.all():
        seeds = mix(np.arange(r, r + step, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
        h = mix(s[None, :] ^ seeds[:, None])
        keys = np.sort((h >> _BITS << _BITS | np.arange(step, dtype=np.uint64)[:, None] << _U(49) | (h & _REST) >> _U(8)).ravel())
        at = np.searchsorted(keys, _BUCKET)
        first = keys[np.minimum(at, len(keys) - 1)]
        new = ~full & (at < len(keys)) & (first >> _BITS == np.arange(REGISTERS))
        value[new] = (first[new] & _U((1 << 49) - 1)) << _U(15)
        full |= new
        r += step
    m, e = np.frexp(value.astype(np.float64))
    zeros = np.clip(64 - e, 0, 63).astype(np.uint16)
    return zeros << np.uint16(MANTISSA) | ((m * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity by equal registers (rows), less accidental collisions."""
    gamma = 1.2 / (1 << MANTISSA)
    return (np.equal(a, b).mean(axis=1) - gamma) / (1 - gamma)


def key_registers(similarity: int) -> int:
    """The most registers of a key with which few enough pairs are missed."""
    return next((r for r in (4, 2) if (1 - (similarity / 100) ** r) ** (REGISTERS // r) <= MISSED), 1)


def _described(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        with np.errstate(over="ignore"):
            for batch in batches:
                n, one, two, sigs = [], [], [], []
                for text in binary_text(batch):
                    s = shingles(text, words)
                    a, b = fingerprint(s) if len(s) else (0, 0)
                    n.append(len(s))
                    one.append(a)
                    two.append(b)
                    # a set and one with a shingle more are the closest that aren't equal
                    sigs.append(registers(s).view(np.int64) if len(s) and 100 * len(s) >= similarity * (len(s) + 1) else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    return tidied(run)


def _sets(bits):
    """(fp1, fp2, set) of each set that the filter lets through, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, held = Words(), set(), np.frombuffer(bits.value, np.uint8)
        with np.errstate(over="ignore"):
            for batch in batches:
                one, two, sets = [], [], []
                for text in binary_text(batch):
                    s = shingles(text, words)
                    if not len(s):
                        continue
                    fp = fingerprint(s)
                    k = fp[0] & (FILTER_BITS - 1)
                    if held[k >> 3] >> (k & 7) & 1 and fp not in seen:
                        seen.add(fp)
                        one.append(fp[0])
                        two.append(fp[1])
                        sets.append((s >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sets, pa.binary())], names=["fp1", "fp2", "shingles"])

    return tidied(run)


def _wide(packed: bytes) -> np.ndarray:
    """48 bits of each hash, still sorted."""
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _confirmed(similarity: int):
    """Of rows sorted by centre, the centre first: the members that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, whole = None, None
        for batch in batches:
            a, b = [], []
            for x, y, packed in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles").to_pylist()):
                if x == y:
                    centre, whole = x, _wide(packed)
                    continue
                assert x == centre
                other = _wide(packed)
                both = np.sort(np.concatenate([whole, other]))
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= similarity * (len(whole) + len(other) - same):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tidied(run)


def _estimated(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(x).flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS) for x in ("sig_a", "sig_b"))
                batch = batch.filter(pa.array(estimate(a, b) >= limit))
            yield batch.select(["a", "b"])

    return tidied(run)


def _hot(rows: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame | None:
    """The hot keys of rows, a table that can be read again; counts, if there: rows by key, as column c."""
    limit = max(HOT_ROWS, rows.count() // HOT_SHARE)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("c")) if counts is None else counts
    hot = counts.where(F.col("c") > limit).select(*keys).collect()  # fewer than HOT_SHARE
    return F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys).schema)) if hot else None


def _looked_up(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows with found, which has one row a key, by keys; the hot keys' part of found is broadcast."""
    if (hot := _hot(rows, keys, counts)) is None:
        return rows.join(found, keys, how)
    many = rows.join(hot, keys, "left_semi").join(F.broadcast(found.join(hot, keys, "left_semi")), keys, how)
    return rows.join(hot, keys, "left_anti").join(found, keys, how).unionByName(many)


def _paired(x: DataFrame, y: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """x with y by key; a hot key's rows of x are dealt to SPLIT tasks, and its rows of y go to each."""
    if hot is None:
        return x.join(y, key)
    dealt = x.join(hot, key, "left_semi").withColumn("part", F.pmod(F.hash("a"), F.lit(SPLIT)))
    copies = y.join(hot, key, "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    return x.join(hot, key, "left_anti").join(y, key).unionByName(dealt.join(copies, [key, "part"]).drop("part"))


class _Classes:
    """The classes of a table, and the links between them."""

    def __init__(self, docs: DataFrame, similarity: int):
        self.docs, self.similarity = narrow(docs, {"doc_id": "long", "text": "string"}), similarity
        self.spark = docs.sparkSession
        arrow_limits(self.spark)
        self.base = written(self.docs.mapInArrow(_described(similarity), "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<long>"), "dedup-base")
        classes = self.base.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        self.classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "dedup-classes")

    def keys(self) -> DataFrame:
        bits = 16 * key_registers(self.similarity)
        parts = "sig" if bits == 64 else f"flatten(transform(sig, x -> transform(sequence(0, {64 - bits}, {bits}), k -> shiftrightunsigned(x, k) & {(1 << bits) - 1}L)))"
        return self.classes.where("sig is not null").select("node", "n", F.posexplode(F.expr(parts)).alias("band", "key"))

    def share(self) -> None:
        """shared: the band keys that several classes have; sets: those classes' full sets."""
        keys = self.keys()
        often = written(keys.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1"), "dedup-often")
        shared = written(_looked_up(keys, often, ["band", "key"], counts=often), "dedup-keys")
        degree = shared.groupBy("node").agg(F.sum("c").alias("degree"))
        self.shared = written(shared.drop("c").join(degree, "node"), "dedup-shared")
        wanted = self.classes.join(self.shared.select("node").distinct(), "node").select("node", "n", "fp1", "fp2")
        bits = bitmap(wanted, F.expr(f"fp1 & {FILTER_BITS - 1}L"), FILTER_BITS)
        sets = self.docs.mapInArrow(_sets(self.spark.sparkContext.broadcast(bits)), "fp1 long, fp2 long, shingles binary").dropDuplicates(["fp1", "fp2"])
        self.sets = written(wanted.join(sets, ["fp1", "fp2"]).select("node", "n", "shingles"), "dedup-sets")

    def passed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose estimate comes near the limit; many may share an a."""
        sig = self.classes.select("node", "sig")
        both = _looked_up(pairs, sig.toDF("a", "sig_a"), ["a"]).join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
        return both.mapInArrow(_estimated(self.similarity / 100 - SLACK), "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), a the centre, that the full sets confirm; a centre with many members goes to several tasks."""
        pairs = written(pairs, "dedup-pairs")
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
        members = _looked_up(pairs, salts, ["a"]).select("a", "b", F.pmod(F.hash("b"), "salts").alias("salt"))
        centres = salts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        sets = self.sets.select(F.col("node").alias("b"), "shingles")
        dealt = members.unionByName(centres).join(sets, "b").select("a", "b", "salt", "shingles")
        dealt = dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", F.expr("a != b"))
        return written(dealt.mapInArrow(_confirmed(self.similarity), "a long, b long"), "dedup-links")


def _joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Labels (node, label) after these links; the label is a component's smallest node."""
    if labels is not None:
        left, right = labels.toDF("a", "la"), labels.toDF("b", "lb")
        links = _looked_up(links, left, ["a"], "left").join(right, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a != b").distinct()
    edges = written(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v"), "dedup-edges")
    now = written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")), "dedup-labels")
    while True:
        near = _looked_up(edges, now.toDF("v", "lv"), ["v"]).groupBy("u").agg(F.min("lv").alias("m"))
        step = near.join(now, "u").select("u", F.least("m", "l").alias("l"), F.col("l").alias("was"))
        step = written(step, "dedup-step")
        jump = step.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        after = written(_looked_up(step, jump, ["l"]).select("u", F.col("ll").alias("l"), (F.col("ll") < F.col("was")).alias("moved")), "dedup-labels")
        if after.where("moved").isEmpty():
            break
        now = after.drop("moved")
    now = now.toDF("node", "label")
    if labels is None:
        return now
    old = labels.toDF("node", "old")
    moved = _looked_up(old, now.toDF("old", "label"), ["old"], "left").select("node", F.coalesce("label", "old").alias("label"))
    return written(moved.unionByName(now.join(old, "node", "left_anti")), "dedup-labels")


def components(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) and kept, for each row of docs."""
    held, labels = _Classes(docs, similarity), None
    held.share()
    rows = held.shared.withColumn("label", F.col("node"))
    for k in range(ROUNDS):
        # the centre: first the class that shares most buckets with others, which is nearest to what copies were made
        # from; then that of the least hash
        turn = F.xxhash64("node", F.lit(k)) if k else -F.col("degree")
        open_ = rows.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(turn).alias("turn")).where("lo != hi")
        near = written(_looked_up(rows.withColumn("own", turn), open_.select("band", "key", "turn"), ["band", "key"]), "dedup-near")
        centres = near.where("own = turn").groupBy("band", "key").agg(F.min("node").alias("a"), F.min("label").alias("la"))
        pairs = _looked_up(near, centres, ["band", "key"]).where("label != la").groupBy(F.col("node").alias("b"), "a").agg(F.count("*").alias("c"))
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a"))
        links = held.confirmed(held.passed(written(best.select("a", "b"), "dedup-best")))
        rows = near.select("node", "n", "degree", "band", "key", "label")
        if links.isEmpty():
            break
        labels = _joined(links, labels)
        rows = written(rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "dedup-rows")

    pairs = written(_rare(held, rows), "dedup-rare")
    if not pairs.isEmpty():
        links = held.confirmed(held.passed(pairs))
        if not links.isEmpty():
            labels = _joined(links, labels)
    classes = held.classes.select("fp1", "fp2", "node", "least")
    if labels is not None:
        inside = written(classes.join(labels, "node"), "dedup-inside")
        least = inside.groupBy("label").agg(F.min("least").alias("low"))
        low = _looked_up(inside, least, ["label"]).select("fp1", "fp2", "low")
        classes = classes.join(labels, "node", "left_anti").select("fp1", "fp2", F.col("least").alias("low")).unionByName(low)
    else:
        classes = classes.select("fp1", "fp2", F.col("least").alias("low"))
    rows = held.base.select("doc_id", "n_shingles", "fp1", "fp2")
    full = _looked_up(rows.where("n_shingles > 0"), classes, ["fp1", "fp2"]).select("doc_id", "n_shingles", F.col("low").alias("component_id"))
    out = full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            sets = [_wide(x).astype(np.int64) for x in part.column("shingles").to_pylist()]
            size = [len(x) for x in sets]
            again = lambda name: np.repeat(part.column(name).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets])), *(pa.array(again(x), pa.int64()) for x in ("node", "n", "label"))], names=["token", "node", "n", "label"])


def _rare(held: _Classes, rows: DataFrame) -> DataFrame:
    """Pairs of classes of different components, of those in buckets with several, that may reach the similarity.

    Of n shingles in order of rarity, one of the first n - least + 1 is shared, least being the fewest that two sets
    which reach the similarity can share. A shared one at places i and j leaves min(n - i, m - j) for the rest.
    """
    t = held.similarity
    size = rows.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    open_ = _looked_up(rows, size.select("band", "key"), ["band", "key"]).select("node", "label").distinct()
    tokens = open_.join(held.sets, "node").select("node", "n", "label", "shingles").mapInArrow(tidied(_tokens), "token long, node long, n long, label long")
    tokens = written(tokens, "dedup-tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("c > 1")
    often = written(often.select("token", "c", (F.col("lo") != F.col("hi")).alias("open")), "dedup-shingles")
    turn = Window.partitionBy("node").orderBy("c", "token")
    kept = _looked_up(tokens, often, ["token"], counts=often).withColumn("k", F.row_number().over(turn)).withColumn("all", F.count("*").over(Window.partitionBy("node")))
    # shingles that no other open class has come first
    placed = kept.select("token", "open", "node", "n", "label", (F.col("n") - F.col("all") + F.col("k")).alias("i"))
    first = written(placed.where(f"open and i <= n - ceil({t} * n / 100) + 1").drop("open"), "dedup-first")
    x, y = first.toDF("token", "a", "na", "la", "ia"), first.toDF("token", "b", "nb", "lb", "ib")
    fits = F.expr(f"a < b and la != lb and 1 + least(na - ia, nb - ib) >= ceil({t} * (na + nb) / {100 + t})")
    return _paired(x, y, "token", _hot(first, ["token"])).where(fits).select("a", "b").distinct()


def deduplicate(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that are their component's first document."""
    names = list(docs.columns)
    gone = components(docs, similarity).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.join(gone, F.col(f"c{names.index('doc_id')}").cast("long") == F.col("gone"), "left_anti").toDF(*names)

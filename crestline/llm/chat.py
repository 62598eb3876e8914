"""Conversations as token ids, with a loss mask.

A turn is encoded in segments, its role and its text apart, and reserved ids are spliced around them:

    [start, first turn only] [turn] role [body] text [end]

Prefix sums of the segments' lengths place each segment in the conversation and say where the loss mask is 1: on the
ids of an assistant's text. Rendered, the reserved ids are CONTROL strings; such strings (and others that templates
commonly use) inside a role or text are escaped before encoding, so no content reads as control, and unescaped on
reading back: a control string becomes MARK, a letter that stands for it, MARK; and MARK itself MARK, a letter, MARK.

The output has a row for each turn, so no conversation is ever held whole. Turns are ordered by turn, then role, then
text, null turns first; rows that repeat are turns of their own. Null roles and texts are empty; rows without conv_id
are one conversation, of id null. An empty table gives no rows. Turns are placed by blocks of BLOCK numbers, so a
conversation's rows are dealt out by their turn; rows of one conversation that share a turn are sorted together.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.llm.bpe import byte_symbols
from crestline.llm.common import arrow_limits, narrow, tidied, written

#: Reserved ids follow the vocabulary in this order; what they are rendered as.
START, TURN, BODY, END = range(4)
CONTROL = ["<s>", "<|turn|>", "<|body|>", "</s>"]
#: Control strings of common templates, escaped like our own.
FOREIGN = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>"]
MARK = "␛"
_CODES = {s: chr(ord("a") + i) for i, s in enumerate([MARK, *CONTROL, *FOREIGN])}
_STRINGS = {c: s for s, c in _CODES.items()}
_FIND = re.compile("|".join(re.escape(s) for s in sorted(_CODES, key=len, reverse=True)))
_ESCAPED = re.compile(f"{MARK}(.){MARK}", re.S)
#: Turns of one step of the prefix sums; where null turns go.
BLOCK, FIRST = 256, -(1 << 62)


def escape(text: str) -> str:
    return _FIND.sub(lambda m: f"{MARK}{_CODES[m[0]]}{MARK}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _STRINGS[m[1]], text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Template:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # control strings of the vocabulary are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        at = {c: b for b, c in enumerate(byte_symbols())}
        labels = [*spec["model"]["vocab"].items()]
        self.base = 1 + max([k for _, k in labels] + [t["id"] for t in spec["added_tokens"]])
        self.bytes_of = [b""] * self.base
        for text, k in labels:
            self.bytes_of[k] = bytes(at[c] for c in text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def turn(self, role: list[int], text: list[int], first: bool) -> tuple[np.ndarray, int, int]:
        """A turn's ids, and where its text begins and ends, by prefix sums over the segments."""
        b = self.base
        segments = [[b + START] if first else [], [b + TURN], role, [b + BODY], text, [b + END]]
        ends = np.cumsum([len(s) for s in segments])
        return np.concatenate([np.array(s, np.int64) for s in segments]), int(ends[3]), int(ends[4])

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn's ids."""
        b = self.base
        turn, body, end = (int(np.flatnonzero(ids == b + x)[0]) for x in (TURN, BODY, END))
        return unescape(self.decode(ids[turn + 1 : body].tolist())), unescape(self.decode(ids[body + 1 : end].tolist()))

    def render(self, ids: np.ndarray) -> str:
        """The formatted text of ids."""
        cuts = [-1, *np.flatnonzero(ids >= self.base).tolist(), len(ids)]
        out = []
        for a, z in zip(cuts, cuts[1:]):
            out.append(self.decode(ids[a + 1 : z].tolist()))
            if z < len(ids):
                out.append(CONTROL[ids[z] - self.base])
        return "".join(out)


@functools.lru_cache(maxsize=2)
def template(path: str) -> Template:
    return Template(path)


def format_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each turn: conv_id, k (0 for the first), start (ids of the conversation before it), ids, mask."""
    path = path or default_path()
    arrow_limits(conversations.sparkSession)
    held = narrow(conversations, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    held = held.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # places in two steps: within blocks of turns, then over the blocks, so that one long conversation is not one sort
    block = F.floor(F.coalesce("turn", F.lit(FIRST)) / BLOCK)
    rows = held.withColumn("block", block)
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("k", F.row_number().over(within) - 1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("cid"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = rows.join(blocks, rows["conv_id"].eqNullSafe(blocks["cid"]) & (rows["block"] == blocks["b"])).select("conv_id", (F.col("first") + F.col("k")).alias("k"), "block", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        for batch in batches:
            roles, texts = (t.encode([escape(x) for x in batch.column(c).to_pylist()]) for c in ("role", "text"))
            made = [t.turn(r, x, k == 0) for r, x, k in zip(roles, texts, batch.column("k").to_pylist())]
            loss = [r == "assistant" for r in batch.column("role").to_pylist()]
            ends = np.cumsum([0, *(len(ids) for ids, _, _ in made)]).astype(np.int32)
            flat, mask = np.empty(ends[-1], np.int32), np.zeros(ends[-1], np.int8)
            for (ids, a, z), on, at in zip(made, loss, ends.tolist()):
                flat[at : at + len(ids)] = ids
                if on:
                    mask[at + a : at + z] = 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), batch.column("k"), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, mask)],
                names=["conv_id", "block", "k", "n_ids", "ids", "mask"],
            )

    # written once, as both the blocks' sums and the result read it
    made = written(rows.select("conv_id", "block", "k", "role", "text").mapInArrow(tidied(run), "conv_id long, block long, k long, n_ids long, ids array<int>, mask array<tinyint>"), "chat")
    sums = made.groupBy("conv_id", "block").agg(F.sum("n_ids").alias("n"))
    sums = sums.select(F.col("conv_id").alias("cid"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return made.join(sums, made["conv_id"].eqNullSafe(sums["cid"]) & (made["block"] == sums["b"])).select("conv_id", "k", (F.col("first") + F.col("inside")).alias("start"), "ids", "mask")


def digest(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Per conversation, read back from format_turns' output: the columns that op1's contract names.

    A digest of a conversation is a chain over its turns, so one task reads them in order; it holds one turn at a time.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        at, held = None, None
        for batch in batches:
            done = []
            ids_of, mask_of = batch.column("ids"), batch.column("mask")
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                ids, mask = (c[i].values.to_numpy(zero_copy_only=False) for c in (ids_of, mask_of))
                if held is None or conv != at:
                    if held is not None:
                        done.append(_row(at, held))
                    at, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = t.read(ids)
                loss = unescape(t.decode(ids[mask == 1].tolist()))
                held[0] += 1
                held[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                held[2] += len(loss)
                held[3].update(loss.encode("utf-8", "surrogatepass"))
                held[4] += len(t.render(ids))
            yield pa.RecordBatch.from_pylist(done, schema=_DIGEST)
        if held is not None:
            yield pa.RecordBatch.from_pylist([_row(at, held)], schema=_DIGEST)

    dealt = formatted.select("conv_id", "k", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "k")
    return dealt.mapInArrow(tidied(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _row(conv, held: list) -> dict:
    return {"conv_id": conv, "n_turns": held[0], "turns_sha256": held[1].hexdigest(), "loss_chars": held[2], "loss_sha256": held[3].hexdigest(), "formatted_chars": held[4]}

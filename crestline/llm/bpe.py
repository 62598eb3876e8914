"""BPE encoding and decoding by a tokenization automaton.

The merges, taken in their order, are compiled into one deterministic automaton over tokens that accepts just the
token strings which the merges produce. It begins with one state that reads every token. The gadget of a merge
(a, b) -> ab gives the target of `a` a state of its own that no longer reads `b`, and lets `ab` be read wherever `a`
is, to where `b` led. A state is kept as its parent, the merge at which it was split off, and the tokens that it
stopped reading and when; a token stopped at merge k is stopped for each later token that starts with it.

A word's symbols are read left to right. Each prefix has one accepted token string, so a position keeps one token:
the tokens that start there come from a table of transitions over symbols, and the automaton's state after the
position's token says which of them may follow. Following the tokens back from the word's end gives the ids.
Decoding emits the label of each arc (id), joined by a space, as a tokenizer without a decoder does.

Words repeat, and no pre-split word crosses white space: what a piece between white space encodes to is kept per
worker, up to CACHE pieces. Null texts are empty: no ids, and "" decoded.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


from crestline.llm.common import arrow_limits, binary_text, narrow, tidied

#: Pieces (and, apart from them, words) whose ids a worker keeps.
CACHE = 300_000
#: Pairs of state and token whose answer a worker keeps.
PAIRS = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """The automaton over tokens; allowed(state, token) is its transition relation, target[token] its state after a token."""

    def __init__(self, n_tokens: int, merges: list[tuple[int, int, int]]):
        self.target = [0] * n_tokens
        self.first, self.made = [-1] * n_tokens, [0] * n_tokens
        #: By state: the parent, the merge at which the state was split off, and what it stopped reading at which merge.
        self.parent, self.split, self.stopped = [-1], [0], [{}]
        reach = [n_tokens]  # tokens that lead to the state
        for k, (a, b, ab) in enumerate(merges, 1):
            self._gadget(k, a, b, ab, reach)
        self.known: dict[int, bool] = {}

    def _gadget(self, k: int, a: int, b: int, ab: int, reach: list[int]) -> None:
        reach[self.target[ab]] -= 1
        self.target[ab] = self.target[b]
        reach[self.target[ab]] += 1
        self.first[ab], self.made[ab] = a, k
        s = self.target[a]
        if reach[s] > 1:
            reach[s] -= 1
            self.parent.append(s)
            self.split.append(k)
            self.stopped.append({})
            reach.append(1)
            s = self.target[a] = len(reach) - 1
        self.stopped[s].setdefault(b, k)

    def allowed(self, state: int, token: int) -> bool:
        key = state << 32 | token
        if (got := self.known.get(key)) is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            got = self.known[key] = self._reads(state, token)
        return got

    def _reads(self, state: int, token: int) -> bool:
        until = 1 << 60
        while state >= 0:
            stopped, y, before = self.stopped[state], token, 1 << 60
            while y >= 0:
                if (k := stopped.get(y)) is not None and k < until and k <= before:
                    return False
                before, y = self.made[y], self.first[y]
            until = min(until, self.split[state])
            state = self.parent[state]
        return True


class Splitter:
    """A tokenizer file's pre-splitting and caches; word_ids() is for the encoders below."""

    kind = np.uint16
    keep = CACHE

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        added = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in self.spec["added_tokens"]):
            raise ValueError(f"{path}: such added tokens aren't supported")
        #: As the tokenizer itself normalises and pre-splits; used for what isn't plain Latin text.
        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.labels = [""] * (1 + max([*model["vocab"].values(), *added.values()]))
        if len(self.labels) > 1 << 16:
            self.kind = np.uint32
        for text, k in [*model["vocab"].items(), *added.items()]:
            self.labels[k] = text
        self.added = {k.encode(): np.array([v], self.kind).tobytes() for k, v in added.items()}
        self.special = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + b")") if added else None
        self.symbols = byte_symbols()
        self.bytes_of = {c: b for b, c in enumerate(self.symbols)}
        self.words = _Words(self)
        self.pieces = _Pieces(self)

    def word_ids(self, word: bytes) -> list[int]:
        raise NotImplementedError

    def split(self, piece: bytes) -> list[bytes]:
        """The pre-split words of text without white space of ASCII and without added tokens."""
        if piece.isascii():
            return _ASCII.findall(piece.lower())
        text = piece.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            return [w.encode() for w in _LATIN.findall(text.lower())]
        at = self.bytes_of
        return [bytes(at[c] for c in w) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def piece(self, piece: bytes) -> bytes:
        """The packed ids of text without white space of ASCII."""
        word = self.words.__getitem__
        if piece.isalpha():  # ASCII letters alone are one word, and a mark after them another
            return word(piece.lower())
        if piece[:-1].isalpha() and piece[-1] in b".,;:!?":
            return word(piece[:-1].lower()) + word(piece[-1:])
        if self.special is None or b"<" not in piece or not self.special.search(piece):
            return b"".join(map(word, self.split(piece)))
        return b"".join(self.added[x] if i % 2 else b"".join(map(word, self.split(x))) for i, x in enumerate(self.special.split(piece)))

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a whole text in UTF-8."""
        for kept in (self.pieces, self.words):
            if len(kept) >= self.keep:
                kept.clear()
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, text.split())), self.kind)

    def forget(self) -> None:
        self.pieces.clear()
        self.words.clear()

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids, joined by a space."""
        return " ".join(map(self.labels.__getitem__, ids))


class Encoder(Splitter):
    """Encodes words by the automaton of the file's merges."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.automaton = MergeAutomaton(len(self.labels), [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self._table(vocab, {a + b for a, b in merges})

    def forget(self) -> None:
        super().forget()
        self.automaton.known.clear()

    def _table(self, vocab: dict[str, int], merged: set[str]) -> None:
        """Transitions over bytes: node << 8 | byte -> node; inner[node] and final[node] are the token that ends there, within or at a word's end."""
        code = self.bytes_of
        self.step: dict[int, int] = {}
        self.inner, self.final = [-1], [-1]
        for text, k in vocab.items():
            at_end = bool(self.suffix) and text.endswith(self.suffix)
            body = text.removesuffix(self.suffix) if at_end else text
            if not (text in merged or len(body) == 1):
                continue  # not to be had from symbols
            node = 0
            for c in body:
                key = node << 8 | code[c]
                if key not in self.step:
                    self.step[key] = len(self.inner)
                    self.inner.append(-1)
                    self.final.append(-1)
                node = self.step[key]
            if at_end:
                self.final[node] = k
            else:
                self.inner[node] = k
                if not self.suffix:
                    self.final[node] = k

    def word_ids(self, word: bytes) -> list[int]:
        n, step, inner, final, target, allowed = len(word), self.step, self.inner, self.final, self.automaton.target, self.automaton.allowed
        token, back = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            state, node, e = target[token[j]] if j else 0, 0, j
            while e < n:
                node = step.get(node << 8 | word[e])
                if node is None:
                    break
                e += 1
                t = final[node] if e == n else inner[node]
                if t >= 0 and token[e] < 0 and (not j or allowed(state, t)):
                    token[e], back[e] = t, j
        out = []
        while n:
            out.append(token[n])
            n = back[n]
        return out[::-1]


class _Words(dict):
    """The packed ids of pre-split words."""

    def __init__(self, encoder: Splitter):
        super().__init__()
        self.ids, self.code = encoder.word_ids, "H" if encoder.kind is np.uint16 else "I"

    def __missing__(self, word: bytes) -> bytes:
        got = self[word] = array(self.code, self.ids(word)).tobytes()
        return got


class _Pieces(dict):
    """The packed ids of text between white space."""

    def __init__(self, encoder: Splitter):
        super().__init__()
        self.of = encoder.piece

    def __missing__(self, piece: bytes) -> bytes:
        got = self[piece] = self.of(piece)
        return got


#: The tokenizer file's pattern for words, over text without white space that is lower-cased: ASCII, and
#: characters below U+0300 (no combining ones, so normalisation form C changes nothing).
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile("[!-~¡-˿]+")
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; made once."""
    return Encoder(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row."""
    path = path or default_path()
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids = [coder.encode(b).astype(np.int32) for b in binary_text(batch)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids]))], names=["doc_id", "ids"])

    return narrow(docs, {"doc_id": "long", "text": "string"}).mapInArrow(tidied(run, lambda: encoder(path)), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of doc_id and ids; null ids decode to an empty text."""
    path = path or default_path()
    arrow_limits(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([coder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return narrow(ids, {"doc_id": "long", "ids": "array<int>"}).mapInArrow(tidied(run, lambda: encoder(path)), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (32-bit little-endian ids) and decoded_sha256, encoded and decoded in one pass."""
    path = path or default_path()
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for text in binary_text(batch):
                ids = coder.encode(text)
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").data).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow(docs, {"doc_id": "long", "text": "string"}).mapInArrow(tidied(run, lambda: encoder(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens and decoded_chars (code points of what the ids decode to) of every row."""
    path = path or default_path()
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids = [coder.encode(b) for b in binary_text(batch)]
            chars = [len(coder.decode(x.tolist())) for x in ids]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *(x.astype(np.int32) for x in ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, flat), pa.array(np.diff(ends), pa.int64()), pa.array(chars, pa.int64())], names=["doc_id", "ids", "n_tokens", "decoded_chars"])

    return narrow(docs, {"doc_id": "long", "text": "string"}).mapInArrow(tidied(run, lambda: encoder(path)), "doc_id long, ids array<int>, n_tokens long, decoded_chars long")

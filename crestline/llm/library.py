"""Encoding whole batches of texts with the tokenizers library, each different word once.

A batch's bytes are classed and lower-cased as one array. What lies between white space is cut where letters, digits
and marks meet, if it has only ASCII and letters below U+0100; any other piece (and one with an apostrophe or the sign
that added tokens begin with) stays whole. Words of up to SHORT bytes are looked up in a table of open addressing, all
of a batch at a time; those that it lacks go to the library in one call. Longer words go to a dictionary.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from crestline.llm.bpe import Splitter

#: Bytes of a word that the table holds; its last key byte is the length.
SHORT = 15
#: Slots of the table (as a power of two), the words at which it is emptied, and words that are looked up at once.
SLOT_BITS, FULL, CHUNK = 20, 550_000, 1 << 18

SPACE, LETTER, DIGIT, MARK, WHOLE = range(5)
_U = np.uint64
_KIND = np.array([SPACE if c in b" \t\n\r\x0b\x0c" else LETTER if chr(c).isalpha() and c < 128 else DIGIT if 0x30 <= c <= 0x39 else WHOLE if c >= 128 or c in b"'<" else MARK for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """Ids by word: keys of two 64-bit numbers, found by linear probing."""

    def __init__(self, kind):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        n = 1 << SLOT_BITS
        self.low, self.high, self.entry = np.zeros(n, _U), np.zeros(n, _U), np.zeros(n, np.int32)
        self.ends, self.pool, self.used = np.zeros(n + 1, np.int32), np.zeros(1 << 16, self.kind), 0

    def place(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' slots, and which words are new: the first that took their slot."""
        last = (1 << SLOT_BITS) - 1
        slot = (((low * _U(0x9E3779B97F4A7C15)) ^ high) * _U(0xC2B2AE3D27D4EB4F) >> _U(64 - SLOT_BITS)).astype(np.int64)
        left, new = np.arange(len(low)), []
        while len(left):
            at = slot[left]
            there = self.high[at]
            other = np.flatnonzero((there != high[left]) | (self.low[at] != low[left]))
            left, at, free = left[other], at[other], there[other] == 0
            mine, spot = left[free], at[free]
            if len(mine):
                self.entry[spot] = mine  # of several words that want a slot one gets it
                got = self.entry[spot] == mine
                self.low[spot[got]], self.high[spot[got]] = low[mine[got]], high[mine[got]]
                new.append(mine[got])
            slot[left[~free]] = (at[~free] + 1) & last
        return slot, np.concatenate(new) if new else np.zeros(0, np.int64)

    def fill(self, slots: np.ndarray, ids: list[bytes]) -> None:
        """Gives new words their ids."""
        flat = np.frombuffer(b"".join(ids), self.kind)
        k, begin = self.used, self.ends[self.used]
        self.ends[k + 1 : k + 1 + len(ids)] = begin + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize)
        if begin + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), self.kind)])
        self.pool[begin : begin + len(flat)] = flat
        self.entry[slots] = np.arange(k, k + len(ids))
        self.used += len(ids)

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these slots, one after the other, and where each word's end."""
        held = pa.ListArray.from_arrays(pa.array(self.ends[: self.used + 1]), pa.array(self.pool[: self.ends[self.used]]))
        taken = held.take(pa.array(self.entry[slots]))
        return taken.flatten().to_numpy(), taken.offsets.to_numpy()[1:]


class LibraryEncoder(Splitter):
    """Encodes columns of texts as the library's encode(text, add_special_tokens=False) does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path)
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.spec["model"]["end_of_word_suffix"]
        self.closes = np.array([bool(suffix) and x.endswith(suffix) for x in self.labels])
        self.table = Words(self.kind)

    def forget(self) -> None:
        super().forget()
        self.table.clear()

    def word_ids(self, word: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(self._symbols(word))]

    def _symbols(self, word: bytes) -> str:
        return word.decode() if word.isalnum() else "".join([self.symbols[b] for b in word])

    def many(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of pre-split words, by one call of the library; a word's last id is one that closes words."""
        if not words:
            return []
        ids = np.array(self.bare.encode_batch_fast([" ".join(map(self._symbols, words))], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):  # a vocabulary that doesn't mark the end of words
            return [np.array(self.word_ids(w), self.kind).tobytes() for w in words]
        raw, cuts = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def segments(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes without white space, plain pieces in lower case; per word its place in data, its size, and whether it is a piece that stays whole. first: where texts begin."""
        n = len(data)
        low, kind = _LOWER[data], _KIND[data]
        lead = np.flatnonzero(data == 0xC3)  # letters from U+00C0 to U+00FF, but for the two signs among them
        after = data[lead + 1]
        letter = (after != 0x97) & (after != 0xB7)
        lead, after = lead[letter], after[letter]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead[after < 0x9F] + 1] += 0x20
        cut = np.empty(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == DIGIT
        cut[first] = True
        whole = np.zeros(n, bool)
        odd = np.flatnonzero(kind == WHOLE)
        if len(odd):
            space = kind == SPACE
            edge = np.empty(n, bool)
            np.not_equal(space[1:], space[:-1], out=edge[1:])
            edge[first] = True
            edges = np.append(np.flatnonzero(edge), n)
            piece = np.searchsorted(edges, odd, "right") - 1
            piece = piece[np.concatenate(([True], piece[1:] != piece[:-1]))]
            step = np.zeros(n + 1, np.int8)
            step[edges[piece]] += 1
            step[edges[piece + 1]] -= 1
            whole = np.cumsum(step[:-1], dtype=np.int8).view(bool)
            inside = np.flatnonzero(whole)
            low[inside], cut[inside] = data[inside], False
            cut[edges[piece]] = True
        starts = np.flatnonzero(cut)
        there = kind[starts] != SPACE
        size, starts = np.diff(starts, append=n)[there], starts[there]
        return low[kind != SPACE], starts, size, whole[starts]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after the other, and where each text's begin, with the end of the last; null is empty."""
        held = texts.fill_null("").cast(pa.binary())
        bounds = np.frombuffer(held.buffers()[1], np.int32, len(held) + 1, held.offset * 4).astype(np.int64)
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(held) + 1, np.int64)
        kept, starts, size, whole = self.segments(data, bounds[:-1][np.diff(bounds) > 0])
        ends = np.cumsum(size)
        begin = ends - size
        padded = np.concatenate([kept, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(kept) + 8, "<u8", padded, strides=(1,))
        out, counts = [], []
        for k in range(0, len(size), CHUNK):
            some = slice(k, k + CHUNK)
            ids, ended = self._words(padded, eight, begin[some], size[some], whole[some])
            out.append(ids)
            counts.append(np.diff(ended, prepend=0))
        total = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))])
        return np.concatenate([np.zeros(0, self.kind), *out]), total[np.searchsorted(starts, bounds)]

    def _words(self, padded: np.ndarray, eight: np.ndarray, begin: np.ndarray, size: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table.used > FULL:
            self.table.clear()
        short = size <= SHORT
        every = bool(short.all())
        a, n = (begin, size) if every else (begin[short], size[short])
        low = eight[a] & _BYTES[np.minimum(n, 8)]
        high = eight[a + np.minimum(n, 8)] & _BYTES[np.maximum(n - 8, 0)] | n.astype(_U) << _U(56)
        slots, new = self.table.place(low, high)
        if len(new):
            word = [padded[x : x + k].tobytes() for x, k in zip(a[new].tolist(), n[new].tolist())]
            odd = (whole if every else whole[short])[new].tolist()
            plain = iter(self.many([w for w, o in zip(word, odd) if not o]))
            self.table.fill(slots[new], [self.piece(w) if o else next(plain) for w, o in zip(word, odd)])
        ids, ended = self.table.ids(slots)
        if every:
            return ids, ended
        # long words go between the short ones
        packed = ids.tobytes()
        at, width = 0, ids.itemsize
        pieces, counts = [], np.empty(len(size), np.int64)
        counts[short] = np.diff(ended, prepend=0)
        place = np.concatenate([[0], ended])[np.cumsum(short)[~short]] * width
        for k, cut in zip(np.flatnonzero(~short).tolist(), place.tolist()):
            word = padded[begin[k] : begin[k] + size[k]].tobytes()
            got = self.pieces[word] if whole[k] else self.words[word]
            pieces += [packed[at:cut], got]
            counts[k], at = len(got) // width, cut
        if len(self.pieces) + len(self.words) > self.keep:
            super().forget()
        return np.frombuffer(b"".join([*pieces, packed[at:]]), self.kind), np.cumsum(counts)

    def encode(self, text: bytes) -> np.ndarray:
        return self.column(pa.array([text.decode("utf-8", "replace")]))[0]


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)

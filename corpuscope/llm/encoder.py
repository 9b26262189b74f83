"""Ids of texts from a public tokenizer file, a buffer of texts at a time in NumPy.

The tokenizer drops white space, composes no character across it and merges only within its words, so a text's ids are
those of its words in order. Words of Latin-1 text are found, hashed and looked up as arrays; only words not yet known go
to the tokenizer, many as one text. A chunk between spaces with other characters or a special token goes to it whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from corpuscope.llm.common import mix64

LEVELS = 16
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that are split and looked up at once, cut at white space.
WINDOW = 1 << 17
#: Words that the tokenizer gets as one text.
JOINED = 256
#: Slots of the table of known words (17 bytes each); words that were not met since the last sweep go when 3 in 5 are taken.
SLOTS = 1 << 20
#: Bytes of chunks given to the tokenizer whole that are kept, about.
KEPT_BYTES = 8 << 20
#: Starts the names of special tokens, which the tokenizer finds before it splits.
SPECIAL = "<|"

_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, dtype=np.uint8)
    out[[*range(9, 14), 32, 0x85, 0xA0]] = _SPACE
    out[[*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
    out[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
    return out


_CLASS = _classes()
#: The tokenizer's endings, words of their own behind an apostrophe that starts one.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_starts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-case bytes: runs of letters, endings, single digits, runs of others."""
    kind = _CLASS[b]
    new = np.empty(len(b) + 3, dtype=bool)  # three more: an ending may be the last
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1 : len(b)])
    new[: len(b)] |= kind == _DIGIT
    for i in np.flatnonzero(b == 39).tolist():
        if new[i] and (n := next((len(e) for e in _ENDINGS if b[i + 1 : i + 1 + len(e)].tobytes() == e), 0)):
            new[i + 1] = False
            new[i + 1 + n] = True
    start = np.flatnonzero(new[: len(b)])
    end = np.append(start[1:], len(b))
    on = kind[start] != _SPACE
    return start[on], end[on]


class Encoder:
    """Ids of texts; words once seen are kept in an open table of hashes (64 bits stand for a word)."""

    def __init__(self, path: str, slots: int = SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << LEVELS:
            raise ValueError("ids of more than 16 bits")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(1 << LEVELS, dtype=bool)  # ids that end a word
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.power = self.back = np.ones(1, dtype=np.uint64)
        self.raw: dict[str, np.ndarray] = {}
        self.raw_bytes = 0
        self._clear(slots)

    # -- known words ---------------------------------------------------------------------------------------------

    def _clear(self, slots: int) -> None:
        self.slots, self.taken = slots, 0
        self.keys = np.zeros(slots, dtype=np.uint64)  # 0: free
        self.at = np.zeros(slots, dtype=np.int32)
        self.size = np.zeros(slots, dtype=np.int32)
        self.met = np.zeros(slots, dtype=bool)
        self.pool = np.zeros(1 << 16, dtype="<u2")
        self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of every hash, -1 of those that are not known."""
        out = np.full(len(h), -1, dtype=np.int64)
        who, slot = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(who):
            key = self.keys[slot]
            hit = key == h[who]
            out[who[hit]] = slot[hit]
            on = ~hit & (key != 0)
            who, slot = who[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Take up words by their distinct hashes, their ids one after the other."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(self.used, len(ids)), dtype="<u2"), ids))
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.taken += len(h)
        who, slot = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(who):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[who[free]]
            won = free & (self.keys[slot] == h[who])  # of several for one slot, one
            s, w = slot[won], who[won]
            self.at[s], self.size[s], self.met[s] = at[w], size[w], True
            who, slot = who[~won], slot[~won]
            slot = np.where(self.keys[slot] == 0, slot, (slot + 1) & (self.slots - 1))

    def _gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in these slots one after the other, and how many each has."""
        size = self.size[slot].astype(np.int64)
        total = int(size.sum())
        return self.pool[np.repeat(self.at[slot] - (np.cumsum(size) - size), size) + np.arange(total)], size

    def _sweep(self, more: int) -> None:
        """Make room: words not met since the last sweep go; all, if too many have been met."""
        kept = np.flatnonzero(self.met & (self.keys != 0))
        kept = kept if len(kept) + more <= self.slots // 2 else kept[:0]
        h, (ids, size) = self.keys[kept], self._gather(kept)
        self._clear(max(self.slots, 1 << (4 * more).bit_length()))
        self._add(h, ids, size)
        self.met[:] = False

    def _fresh(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has: an id that ends a word shows where it stops."""
        out: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode("latin-1") for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u2")
            end = np.flatnonzero(self.last[ids]) + 1
            if len(end) == len(group) and end[-1] == len(ids):
                out.append(ids)
                sizes.append(np.diff(end, prepend=0))
            else:
                each = [np.array(self.tokenizer.encode(w.decode("latin-1"), add_special_tokens=False).ids, dtype="<u2") for w in group]
                out += each
                sizes.append(np.array([len(x) for x in each]))
        return np.concatenate(out), np.concatenate(sizes)

    def _window(self, low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the words of some bytes, how many ids each has, and the ids."""
        b = np.frombuffer(low, dtype=np.uint8)
        start, end = word_starts(b)
        if not len(start):
            return start, start, np.zeros(0, dtype="<u2")
        if len(self.power) < len(b):
            n = max(len(b), WINDOW) + 1
            self.power, self.back = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, dtype=np.uint64)))) for x in (_STEP, _BACK))
        value = _BYTE_HASH[b]
        value *= self.power[: len(b)]
        edge = np.empty(2 * len(start), dtype=np.int64)  # sums of the words and of what lies between
        edge[::2], edge[1::2] = start, end
        sums = np.add.reduceat(np.append(value, np.uint64(0)), edge)[::2]
        h = mix64(sums * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        h[h == 0] = 1
        slot = self._find(h)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            ids, size = self._fresh([low[s:e] for s, e in zip(start[miss[first]].tolist(), end[miss[first]].tolist(), strict=True)])
            if 5 * (self.taken + len(new)) > 3 * self.slots:
                self.met[slot[slot >= 0]] = True
                self._sweep(len(new) + len(h))
                self._add(new, ids, size)
                slot = self._find(h)
                if (slot < 0).any():  # all were swept out
                    return self._window(low)
            else:
                self._add(new, ids, size)
                slot[miss] = self._find(h[miss])
        self.met[slot] = True
        ids, size = self._gather(slot)
        return start, size, ids

    # -- texts ---------------------------------------------------------------------------------------------------

    def _whole(self, chunk: str) -> np.ndarray:
        out = self.raw.get(chunk)
        if out is None:
            out = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u2")
            self.raw_bytes += 2 * out.nbytes + 4 * len(chunk) + 300
            if self.raw_bytes > KEPT_BYTES:
                self.raw.clear()
                self.raw_bytes = 0
            self.raw[chunk] = out
        return out

    @staticmethod
    def _parts(text: str) -> Iterator[bytes | str]:
        """A text as lower-case Latin-1 bytes and chunks for the tokenizer."""
        if SPECIAL not in text:
            try:
                yield text.encode("latin-1").translate(_LOWER)
                return
            except UnicodeEncodeError:
                pass
        held: list[bytes] = []
        for chunk in text.replace("\n", " ").split(" "):
            try:
                if SPECIAL not in chunk:
                    held.append(chunk.encode("latin-1").translate(_LOWER))
                    continue
            except UnicodeEncodeError:
                pass
            if held:
                yield b" ".join(held)
                held = []
            yield chunk
        if held:
            yield b" ".join(held)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint16) of every text; of null: none."""
        parts = [list(self._parts(t)) if t else [] for t in texts]
        plain = [x for p in parts for x in p if isinstance(x, bytes)]
        low = b" ".join(plain)
        begin = np.cumsum([0, *(len(x) + 1 for x in plain)])
        starts, sizes, ids = [], [], []
        at = 0
        while at < len(low):
            cut = len(low)
            if len(low) - at > WINDOW:
                cut = low.rfind(b" ", at, at + WINDOW) + 1 or low.find(b" ", at + WINDOW) + 1 or len(low)
            start, size, got = self._window(low[at:cut])
            starts.append(start + at)
            sizes.append(size)
            ids.append(got)
            at = cut
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype="<u2")
        count = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, dtype=np.int64)
        edge = count[np.searchsorted(np.concatenate(starts), begin)] if starts else np.zeros(len(begin), dtype=np.int64)
        out, k = [], 0
        for p in parts:
            got = []
            for x in p:
                if isinstance(x, bytes):
                    got.append(flat[edge[k] : edge[k + 1]])
                    k += 1
                else:
                    got.append(self._whole(x))
            out.append(got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, dtype="<u2"))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

"""Ids of the words of Latin texts, found in blocks with numpy: split, hashed and looked up without an object for each word.

A block is one string of many texts. Character classes tell where words begin, a word is known by two 64-bit sums of random
numbers, one for each pair of place and character (tabulation hashing, 128 bits in all), and a table with open addresses
holds where its ids lie in one array. Only words that the table lacks become strings.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .bpe import BEYOND_LATIN, SPACE

#: Code points below this are looked at; words of more characters than ``PLACES`` are asked for one by one.
LATIN, PLACES = 0x250, 64
#: Characters of one block, about; a longer text is cut at blanks.
BLOCK = 1 << 20
GAP, LETTER, DIGIT, OTHER = range(4)
#: What may stand behind an apostrophe that begins a word.
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": DIGIT}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(LATIN)], np.uint8)
    low, high = map(ord, SPACE.split("-")[0] + SPACE.split("-")[1][0])
    out[[*range(low, high + 1), *map(ord, SPACE.split("-")[1][1:])]] = GAP
    return out


CLASSES = _classes()
GAPS = "".join(map(chr, np.flatnonzero(CLASSES == GAP)))


def plain(text: str) -> str | None:
    """The text in lower case, or None if it has characters that are not Latin before or after that."""
    low = text.lower()
    if text.isascii():
        return low
    return None if BEYOND_LATIN.search(text) or BEYOND_LATIN.search(low) else low


def pieces(text: str) -> list[str]:
    """The text itself, or parts of about :data:`BLOCK` characters that end at blanks."""
    out, at = [], 0
    while len(text) - at > 2 * BLOCK:
        end = text.find(" ", at + BLOCK)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def word_starts(c: np.ndarray) -> np.ndarray:
    """Where the words of code points ``c`` (lower case) begin; each ends at the next start or the white space before it.

    A word is a run of letters, a digit, a run of other characters, or an apostrophe with one of the known endings if nothing
    of its own kind stands before it.
    """
    kind = CLASSES[c]
    begins = kind != GAP
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    quote = np.flatnonzero((c == ord("'")) & begins)
    if len(quote):
        behind = np.concatenate([c, np.zeros(3, c.dtype)])
        one, two = behind[quote + 1], behind[quote + 2]
        short = np.isin(one, [ord(x) for x in ENDINGS_1])
        long = np.zeros(len(quote), bool)
        for x, y in ENDINGS_2:
            long |= (one == ord(x)) & (two == ord(y))
        begins[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        after = after[after < len(c)]
        begins[after] = kind[after] != GAP
    return np.flatnonzero(begins)


class WordIds:
    """Ids of each word, from ``ask`` (a list of words to a list of id bytes) for the words that the table lacks.

    The table starts anew when it holds ``most`` words: bounded, never wrong. A block of more words makes it larger.
    """

    def __init__(self, ask: Callable[[list[str]], list[bytes]], kind: np.dtype, most: int):
        self.ask, self.kind, self.most = ask, kind, most
        rng = np.random.default_rng(11)
        self.sums = [rng.integers(0, 1 << 64, (PLACES, LATIN), np.uint64) for _ in range(2)]
        for s in self.sums:
            s[:, CLASSES == GAP] = 0
        self._clear(most)

    def _clear(self, words: int) -> None:
        slots = 1 << max(4, (2 * words).bit_length())
        self.held, self.mask, self.used = 0, slots - 1, 0
        self.keys = [np.zeros(slots, np.uint64) for _ in range(2)]
        self.begin, self.count = np.full(slots, -1, np.int32), np.zeros(slots, np.int32)
        self.pool = np.zeros(1 << 12, self.kind)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair of keys, -1 for those that the table lacks."""
        place = (a & np.uint64(self.mask)).astype(np.int64)
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        while len(todo):
            p = place[todo]
            taken = self.begin[p] >= 0
            same = taken & (self.keys[0][p] == a[todo]) & (self.keys[1][p] == b[todo])
            out[todo[same]] = p[same]
            todo = todo[taken & ~same]
            place[todo] = (place[todo] + 1) & self.mask
        return out

    def _insert(self, a: np.ndarray, b: np.ndarray, ids: list[bytes]) -> None:
        n = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        fresh = np.frombuffer(b"".join(ids), self.kind)
        while self.used + len(fresh) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(fresh)] = fresh
        begin = self.used + np.cumsum(n) - n
        self.used += len(fresh)
        self.held += len(ids)
        place = (a & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(a))
        while len(todo):
            free = todo[self.begin[place[todo]] < 0]
            p, first = np.unique(place[free], return_index=True)
            new = free[first]
            self.keys[0][p], self.keys[1][p], self.begin[p], self.count[p] = a[new], b[new], begin[new], n[new]
            todo = np.setdiff1d(todo, new, assume_unique=True)
            place[todo] = (place[todo] + 1) & self.mask

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of the words of each text that :func:`plain` gave."""
        whole = "\n".join(texts)
        c = np.frombuffer(whole.encode("utf-16-le"), "<u2")
        first = word_starts(c)
        if not len(first):
            return [b""] * len(texts)
        span = np.diff(np.append(first, len(c)))
        at = np.arange(len(c) - first[0], dtype=np.int32) - np.repeat((first - first[0]).astype(np.int32), span)
        at = np.minimum(at, PLACES - 1) * LATIN + c[first[0] :]
        a, b = (np.add.reduceat(s.ravel()[at], first - first[0]) for s in self.sums)
        word = lambda i: whole[first[i] : first[i] + span[i]].rstrip(GAPS)
        long = np.array([i for i in np.flatnonzero(span > PLACES) if len(word(i)) > PLACES], np.int64)
        alone = np.zeros(len(first), bool)
        alone[long] = True
        slot = self._find(a, b)
        missing = np.flatnonzero((slot < 0) & ~alone)
        while len(missing):
            new = missing[np.unique(a[missing], return_index=True)[1]]
            if self.held and self.held + len(new) > self.most:
                self._clear(self.most)
                slot[:] = -1
                missing = np.flatnonzero(~alone)
                continue
            if self.held + len(new) > self.mask // 2:
                self._clear(len(new))
            self._insert(a[new], b[new], self.ask([word(i) for i in new]))
            slot[missing] = self._find(a[missing], b[missing])
            missing = missing[slot[missing] < 0]
        begin, n, pool = self.begin[slot].astype(np.int64), self.count[slot].astype(np.int64), self.pool
        if len(long):
            extra = self.ask([word(i) for i in long])
            n[long] = [len(x) // self.kind.itemsize for x in extra]
            begin[long] = self.used + np.cumsum(n[long]) - n[long]
            pool = np.concatenate([pool[: self.used], np.frombuffer(b"".join(extra), self.kind)])
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = pool[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)].tobytes()
        size = np.array([len(t) + 1 for t in texts])
        cuts = (ends[np.searchsorted(first, np.append(np.cumsum(size) - size, len(c) + 1))] * self.kind.itemsize).tolist()
        return [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

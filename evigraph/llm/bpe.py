"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token ids; a path from its start spells a text if and only if it is the BPE tokenization of that
text. It is compiled from the merges by one gadget for each rule ``(u, v) -> w``, in order of rank:

* the state behind ``u`` is copied without its arc ``v``, and all arcs ``u`` lead to the copy from then on, so that
  the pair can never be read apart again;
* every state with an arc ``u`` gets an arc ``w`` to the state behind ``v``.

So each rule makes one state: its parent, the arc taken away and the rank at which that happened; ``behind[t]`` is the
state behind token ``t``. An arc ``w`` leaves a state if each token on the left spine of ``w`` was still there when the next
one was made of it. Tokens are numbered along the tree of left spines, children in order of rank: what a state lacks
because an arc was taken away is then that token and one interval, its later children with all that is below them. When all
gadgets are placed, the state behind each token becomes one row of the arc table: the bounds of the intervals it lacks.

A prefix of a word has one tokenization, hence one last token. Encoding goes through the positions of a word and finds at
each the one token that ends there and that the arc table lets follow the last token of the prefix before it; the path is read
back from the end. Decoding emits the label of each arc.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import rows_of, ship, slices

WORD_END = "</w>"
#: Added to the last symbol of a word, beyond all byte symbols.
LAST = 0x2000
#: A normaliser and a splitter, as vocabulary files state them, that :class:`Splitter` need not ask the library for
#: where a text has Latin characters only (fixed values). They are the same in all versions of Unicode.
KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_SPLITTER = [{"type": "Split", "pattern": {"Regex": KNOWN_SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
#: White space below U+0250 (Unicode White_Space).
SPACE = "\t-\r \x85\xa0"
#: Longer words are not remembered.
LONG_WORD = 256


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Automaton:
    """States and the arc table compiled from ``merges``, a list of token pairs in order of rank, over the tokens of ``vocab``."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = vocab
        size = max(vocab.values(), default=0) + 1
        self.labels = [""] * size
        for token, i in vocab.items():
            self.labels[i] = token
        self.left, self.rank = [-1] * size, [-1] * size
        self.behind = [0] * size
        self.parent, self.gone, self.when = [-1], [-1], [-1]  # of each state; state 0 has all its arcs
        self.made: set[int] = {i for t, i in vocab.items() if len(t.removesuffix(WORD_END)) == 1}
        twice = [t for t, n in Counter(a + b for a, b in merges).items() if n > 1]
        if twice:
            raise ValueError(f"several rules make {twice[:5]}; this construction needs one rule for each token")
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self._compile(size)
        self.by_symbols = {self.spelled(t): i for t, i in vocab.items() if i in self.made}
        self.reach: dict[str, int] = {}  # the longest token that ends with these two symbols
        for s in self.by_symbols:
            self.reach[s[-2:]] = max(len(s), self.reach.get(s[-2:], 1))

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if u not in self.made or v not in self.made or not self._leaves(self.behind[u], v):
            return  # an earlier rule always takes one of the two first
        self.left[w], self.rank[w] = u, rank
        self.made.add(w)
        self.behind[w] = self.behind[v]
        self.parent.append(self.behind[u])
        self.gone.append(v)
        self.when.append(rank)
        self.behind[u] = len(self.parent) - 1

    def _taken(self, state: int, token: int) -> int | None:
        """The rank at which the arc ``token`` was taken from a state on its way."""
        while state:
            if self.gone[state] == token:
                return self.when[state]
            state = self.parent[state]
        return None

    def _leaves(self, state: int, token: int) -> bool:
        """Whether the arc ``token`` leaves ``state``, while gadgets are placed."""
        if self._taken(state, token) is not None:
            return False
        while self.rank[token] >= 0:
            made, token = self.rank[token], self.left[token]
            taken = self._taken(state, token)
            if taken is not None and taken <= made:
                return False
        return True

    def _compile(self, size: int) -> None:
        """Numbers the tokens along their left spines and writes the arc table, one row for each state that a token leads to."""
        kids: list[list[int]] = [[] for _ in range(size)]
        for w in sorted(range(size), key=self.rank.__getitem__):
            if self.left[w] >= 0:
                kids[self.left[w]].append(w)
        self.number, end, n = [0] * size, [0] * size, 0
        stack = [(t, False) for t in reversed(range(size)) if self.left[t] < 0]
        while stack:
            t, done = stack.pop()
            if done:
                end[t] = n
                continue
            self.number[t] = n
            n += 1
            stack.append((t, True))
            stack += [(k, False) for k in reversed(kids[t])]

        def lacks(token: int, rank: int) -> list[tuple[int, int]]:
            later = next((k for k in kids[token] if self.rank[k] >= rank), None)
            out = [(self.number[token], self.number[token] + 1)]
            return out + [(self.number[later], end[token])] if later is not None else out

        rows: dict[int, array] = {}
        for state in set(self.behind):
            spans, q = [], state
            while q:
                spans += lacks(self.gone[q], self.when[q])
                q = self.parent[q]
            bounds = array("i")
            for low, high in sorted(spans):
                if bounds and low <= bounds[-1]:
                    bounds[-1] = max(bounds[-1], high)
                else:
                    bounds.extend((low, high))
            rows[state] = bounds
        self.table: list[array] = [rows[state] for state in self.behind]

    def arc(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last``: its number lies outside all intervals that the state lacks."""
        return not bisect_right(self.table[last], self.number[token]) & 1

    def encode(self, symbols: str) -> list[int]:
        """Token ids of one pre-split word in :meth:`spelled` symbols: the one path of the automaton that spells it."""
        by_symbols, reach, table, number = self.by_symbols, self.reach, self.table, self.number
        whole = by_symbols.get(symbols)
        if whole is not None:  # the one path that spells a token's own symbols is its arc
            return [whole]
        last, start = [-1] * (len(symbols) + 1), [-1] * (len(symbols) + 1)
        for at in range(1, len(symbols) + 1):
            for low in range(max(0, at - reach.get(symbols[max(0, at - 2) : at], 1)), at):
                t = by_symbols.get(symbols[low:at])
                if t is not None and (not low or (last[low] >= 0 and not bisect_right(table[last[low]], number[t]) & 1)):
                    last[at], start[at] = t, low
                    break
        out, at = [], len(symbols)
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary has no token for a symbol of this word")
            out.append(last[at])
            at = start[at]
        return out[::-1]

    @staticmethod
    def spelled(token: str) -> str:
        """Byte symbols with the word end drawn into the last one."""
        bare = token.removesuffix(WORD_END)
        return token if bare == token or not bare else bare[:-1] + chr(ord(bare[-1]) + LAST)

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, joined by one space."""
        return " ".join(self.labels[i] for i in ids)


class Memo(dict):
    """A dict that computes what it lacks and starts anew when it holds ``most`` entries: bounded, never wrong.

    Long words are computed each time, so that bytes are bounded too.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if isinstance(key, str) and len(key) > LONG_WORD:
            return value
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Splitter:
    """Normalises and pre-splits texts as a vocabulary file says.

    The library's own normaliser and splitter, built from the file, do this. Where the file states the known ones
    and a text is Latin (below U+0250, before and after lower case), one pattern does the same.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        data = json.loads(spec)
        odd = [t["content"] for t in data["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd:
            raise ValueError(f"added tokens that take in what stands beside them are not supported: {odd}")
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.begin = os.path.commonprefix(list(self.specials)) if self.specials else ""
        data["model"] = {"type": "BPE", "vocab": {}, "merges": []}  # nothing but the normaliser and the splitter is asked of it
        library = Tokenizer.from_str(json.dumps(data | {"added_tokens": []}))
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        parts = lambda x, name: x[name] if x and x["type"] == "Sequence" else [x]
        self.known = parts(data["normalizer"], "normalizers") == KNOWN_NORMALIZER and parts(data["pre_tokenizer"], "pretokenizers") == KNOWN_SPLITTER
        self.ascii, self.latin_1, self.latin = _latin_words(0x80), _latin_words(0x100), _latin_words(0x250)

    def words(self, text: str) -> list[str] | None:
        """The words of a text without special tokens, or None if it is for the library to split."""
        if not self.known:
            return None
        if text.isascii():
            return self.ascii(text.lower())
        try:
            text.encode("latin-1")
            return self.latin_1(text.lower())
        except UnicodeEncodeError:
            if BEYOND_LATIN.search(text):
                return None
        low = text.lower()
        return None if BEYOND_LATIN.search(low) else self.latin(low)

    def symbols(self, text: str) -> list[str]:
        """The words of a text without special tokens in byte symbols, by the library's normaliser and splitter."""
        low = self.normalizer.normalize_str(text) if self.normalizer else text
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(low)] if self.pre_tokenizer else [low] if low else []

    def has_special(self, text: str) -> bool:
        return self.special is not None and self.begin in text and self.special.search(text) is not None


@lru_cache(4)
def _latin_words(below: int):
    """:data:`KNOWN_SPLIT` for texts of characters ``below`` a code point up to U+0250.

    Words come first in the pattern: nothing before them in :data:`KNOWN_SPLIT` begins with a letter.
    """
    classes = {"L": "", "N": ""}
    for cp in range(below):
        kind = unicodedata.category(chr(cp))[0]
        if kind in classes:
            classes[kind] += f"\\U{cp:08x}"
    letter, digit = classes["L"], classes["N"]
    return re.compile(rf"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digit}]|[^{SPACE}{letter}{digit}]+").findall


class Tokenizer:
    """Encodes and decodes whole texts by the automaton of one vocabulary file's content."""

    def __init__(self, spec: str, word_memo: int = 200_000):
        data = json.loads(spec)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        self.automaton = Automaton(data["model"]["vocab"], merges)
        self.split = Splitter(spec)
        self.table = str.maketrans(dict(enumerate(byte_symbols())))
        self.names = {i: t for t, i in self.split.specials.items()}
        self.words: Memo = Memo(self._word, word_memo)
        self.by_symbols: Memo = Memo(self._symbols, word_memo // 4)

    def _word(self, word: str) -> tuple[int, str, str]:
        return self._symbols(word.encode("utf-8").decode("latin-1").translate(self.table))

    def _symbols(self, symbols: str) -> tuple[int, str, str]:
        ids = self.automaton.encode(symbols[:-1] + chr(ord(symbols[-1]) + LAST))
        return len(ids), " ".join(map(str, ids)), self.automaton.decode(ids)

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        words = self.split.words(text)
        return list(map(self.words.__getitem__, words)) if words is not None else list(map(self.by_symbols.__getitem__, self.split.symbols(text)))

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """The number of tokens, the ids as decimals joined by one space, and the decoded text."""
        text = text or ""
        if self.split.has_special(text):
            found = []
            for i, part in enumerate(self.split.special.split(text)):
                found += [(1, str(self.split.specials[part]), part)] if i % 2 else self._plain(part) if part else []
        else:
            found = self._plain(text) if text else []
        if not found:
            return 0, "", ""
        n, ids, labels = zip(*found, strict=True)
        return sum(n), " ".join(ids), " ".join(labels)


@lru_cache(2)
def tokenizer(spec: str) -> Tokenizer:
    """One for each Python worker."""
    return Tokenizer(spec)


def _encoded(batches: Iterator[pa.RecordBatch], spec: str, whole: bool) -> Iterator[pa.RecordBatch]:
    t = tokenizer(spec)
    for batch in slices(batches):
        keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
        names = [name for name in batch.schema.names if name != "_text"]
        n, ids, decoded = [], [], []
        for (text,) in rows_of(batch, "_text"):
            k, a, b = t.encode(text)
            n.append(k)
            ids.append(a if whole else hashlib.sha256(a.encode()).hexdigest())
            decoded.append(b if whole else hashlib.sha256(b.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([*keep, pa.array(n, pa.int64()), pa.array(ids, pa.large_string() if whole else pa.string()).cast(pa.string()), pa.array(decoded, pa.string())], [*names, "n_tokens", "ids" if whole else "ids_sha256", "decoded" if whole else "decoded_sha256"])


def bpe(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode and decode each row's whole text: ``id, n_tokens, ids, decoded``, with ``digests`` their SHA-256 instead.

    ``ids`` are decimals joined by one space, ``decoded`` the token labels joined by one space. The vocabulary (1.7 MB,
    fixed) is read by the driver and travels with the tasks. Each row stands alone: no shuffle.

    Cases: null or empty text has no tokens and empty strings; repeated rows and null ids pass through; no rows, no result;
    other columns of ``docs`` are not read. Results of words are remembered, in bounded number.
    """
    ship(docs.sparkSession)
    with open(vocab_path, encoding="utf-8") as f:
        spec = f.read()
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    base = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema[0].dataType.simpleString()
    return base.mapInArrow(lambda it: _encoded(it, spec, not digests), f"`{id_col}` {kind}, n_tokens long, {names[0]} string, {names[1]} string")

"""Secret scans: patterns, and literals whose target's name gives them away, through assignments of source and configuration."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ship, slices

# Fixed patterns of the contract, the group whose length counts, and the least length; in the order in which kinds are listed.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
LITERAL = "literal"
KINDS = (*(k for k, *_ in PATTERNS), LITERAL)
#: What a text must hold for a pattern to match, in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

#: A target, with or without quotes or an index, and its operator. No part can be given back, so a scan never looks at a word twice.
PAIR = re.compile(r"""(?<![\w$.\-])-{0,2}([A-Za-z_$][\w$.\-]*+)["'`]?\]?[ \t]*+(\+=|:=|=>|\?=|=|:)(?![=:/~])[ \t]*+""")
#: ``name: type = value``: the type is passed over.
TYPE = re.compile(r"[A-Za-z_][\w.\[\]|, ]{0,60}?[ \t]*=(?![=~])[ \t]*+")
QUOTED = re.compile(r'''[rbuRBUfF]{0,2}(?:"""((?:[^"\\]|\\.|"(?!""))*+)"""|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`)''', re.DOTALL)
NAME = re.compile(r"\$?\{?([A-Za-z_$][\w$.]*+)\}?(?![\w(\[])")
#: What may stand between two parts of one value.
JOIN = re.compile(r"[ \t]*+(?:\+|\.\.?|~|\|\||&)?[ \t]*+(?:\\\n[ \t]*+)?")
#: A value without quotes takes the rest of its line but for a comment or a comma.
BARE = re.compile(r"""([^\s"'`,;#(){}\[\]<>|]++)[ \t]*+(?:[,;][ \t]*+)?(?:(?:#|//)[^\n]*+)?(?=\n|$)""")
ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*+)>([^<>\s]++)</\1>")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

SENSITIVE = {"password", "passwd", "passwort", "passphrase", "passcode", "pwd", "pass", "secret", "secrets", "token", "apikey", "credential", "credentials"}
KEY_OF = {"api", "access", "private", "secret", "encryption", "signing", "auth", "account", "shared", "master", "storage", "session"}
#: Words at the end of a name that tell of something about a secret, not of one.
ABOUT = {"hint", "policy", "length", "len", "min", "max", "count", "type", "name", "field", "label", "url", "uri", "path", "file", "dir", "id", "ids", "expiry", "expires", "timeout", "ttl", "regex", "pattern", "prompt", "format", "header", "message", "error", "method", "index"}
PLACEHOLDER = re.compile(r"(?i)change.?me|example|your.|placeholder|redacted|dummy|todo|^(?:none|null|true|false|undefined)|\.\.\.|[<>{}]|%s|\$\w|(.)\1{5}")
LEAST = 8
#: A name counts 2; a literal must add 1.
NAME_SCORE, THRESHOLD = 2.0, 3.0


@dataclass
class Value:
    """What is assigned: literals ``(start, end)``, the values it refers to, and the characters of all of them."""

    target: str
    literals: list[tuple[int, int]] = field(default_factory=list)
    refs: list[int] = field(default_factory=list)
    open: list[str] = field(default_factory=list)
    length: int = 0


def name_score(target: str) -> float:
    """How much the words of a target's name speak for a secret: 2 or 0."""
    words = [w.lower() for w in WORDS.findall(target)]
    if not words or words[-1] in ABOUT:
        return 0.0
    key = any(b in ("key", "keys") and a in KEY_OF for a, b in zip(words, words[1:], strict=False))
    return NAME_SCORE if key or not SENSITIVE.isdisjoint(words) else 0.0


def literal_score(text: str, length: int) -> float:
    """How much a literal looks like a secret: ``length`` characters with what it is joined to, letters beside digits, entropy; blanks, places and placeholders speak against it."""
    if length < LEAST or not text or PLACEHOLDER.search(text):
        return 0.0
    counts = Counter(text)
    entropy = -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())
    mixed = any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts)
    place = text.startswith(("http://", "https://", "/", "./", "~/"))
    return 1.0 + 0.5 * mixed + 0.5 * (entropy >= 3) - (1.5 if place else 0.0) - (1.5 if any(c.isspace() for c in counts) else 0.0)


def assignments(text: str) -> list[Value]:
    """Name-literal pairs in order, from one pass: names that a value is made of point to their last value before, if there is one."""
    values: list[Value] = []
    last: dict[str, int] = {}
    at = 0
    while m := PAIR.search(text, at):
        v, at = Value(m[1]), m.end()
        if m[2] == ":" and (t := TYPE.match(text, at)):
            at = t.end()
        near = max(m.start() - 64, 0)
        line = text.rfind("\n", near, m.start()) + 1
        alone = (line or not near) and text[line : m.start()].strip(" \t\"'") in ("", "export", "set", "-", "const", "let", "var")
        if m[2] == "+=" and v.target in last:
            v.refs.append(last[v.target])
        p = at
        while True:
            if q := QUOTED.match(text, p):
                v.literals.append(q.span(q.lastindex))
            elif q := NAME.match(text, p):
                if q[1] in last:
                    v.refs.append(last[q[1]])
                elif q[0][0] == "$":
                    v.open.append(q[1])
                else:
                    break
            else:
                break
            at = q.end()
            p = JOIN.match(text, at).end()
            if p == at and text[p : p + 1] not in ('"', "'", "`", "$"):
                break
        if not (v.literals or v.refs or v.open) and alone and (b := BARE.match(text, at)):
            v.literals.append(b.span(1))
            at = b.end()
        v.length = min(sum(e - s for s, e in v.literals) + sum(values[r].length for r in v.refs), 1 << 20)
        last[v.target] = len(values)
        values.append(v)
    for v in values:  # shell and make expand names that are set further down
        v.refs += [last[n] for n in v.open if n in last]
    return values


def sensitive_literals(text: str) -> list[tuple[int, int, str, float]]:
    """``start, end, target, score`` of literals that reach a sensitive target: named there, or carried by constants on the way."""
    found: dict[tuple[int, int], tuple[str, float]] = {}
    values = assignments(text)
    seen: set[int] = set()
    for i, v in enumerate(values):
        if name_score(v.target):
            stack = [(i, v.length)]
            while stack:
                k, length = stack.pop()
                if k in seen:
                    continue
                seen.add(k)
                own = values[k]
                joined = "".join(text[s:e] for s, e in own.literals)
                score = NAME_SCORE + literal_score(joined, max(length, own.length))
                if score >= THRESHOLD:
                    found |= {x: (v.target, score) for x in own.literals if x not in found and x[0] < x[1]}
                stack += [(r, length) for r in own.refs]
    for m in ELEMENT.finditer(text) if "</" in text else ():
        score = name_score(m[1]) + literal_score(m[2], len(m[2]))
        if score >= THRESHOLD:
            found.setdefault(m.span(2), (m[1], score))
    return sorted((s, e, target, score) for (s, e), (target, score) in found.items())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind (its place in KINDS), end`` of the fixed patterns, leftmost and without overlap within a kind."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    may = (any(w in low for w in ASSIGN_WORDS), "AKIA" in text, b"h" * PATTERNS[2][3] in text.encode("utf-8", "surrogatepass").translate(HEX_BYTES))
    for kind, (_, pattern, group, least) in enumerate(PATTERNS):
        if may[kind]:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def spans(text: str | None) -> list[dict]:
    """All spans of a text: the fixed patterns' ones, and literals of sensitive targets that are in none of these."""
    if not text:
        return []
    base = base_spans(text)
    out = [(s, k, e, None, None) for s, k, e in base]
    if "=" in text or ":" in text or "</" in text:
        starts, reach = [s for s, _, _ in base], []
        for _, _, e in base:
            reach.append(max(e, reach[-1] if reach else 0))
        for s, e, target, score in sensitive_literals(text):
            i = bisect_right(starts, s)
            if not i or reach[i - 1] < e:
                out.append((s, len(PATTERNS), e, target, score))
    return [{"kind": KINDS[k], "start": s, "end": e, "target": target, "score": score} for s, k, e, target, score in sorted(out, key=lambda x: x[:3])]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("target", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, digests: bool = False) -> DataFrame:
    """``doc_id, spans`` of every document; with ``digests`` counts of the fixed patterns, their digest and all spans as text instead.

    Each text is lexed once: targets and operators of source, configuration, shell and markup syntax, quoted and bare values, what is joined by ``+`` and the like. Names in
    a value stand for the constant that they hold. A literal that reaches a target of a sensitive name, by however many steps, is a span of
    kind ``literal`` if name and literal together score 3 and no fixed pattern has it. Positions count code points; ends are exclusive.

    Cases: null and empty texts have no spans; a row for each row, repeated ids and null ids too; no rows, no result; time and memory follow a
    text's length, whatever it holds; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=1024):
            found = pa.array([spans(t) for t in batch.column(1).to_pylist()], pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "spans"])

    ship(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = given.mapInArrow(rows, "doc_id long, spans array<struct<kind string, start int, end int, target string, score double>>")
    if not digests:
        return out
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != LITERAL)
    n = [F.size(F.array_compact(F.transform("spans", lambda x: F.when(x["kind"] == KINDS[i], 1)))).cast("long").alias(f"n_{KINDS[i]}") for i in range(len(PATTERNS))]
    return out.select("doc_id", *n, F.sha2(F.encode(said(base), "UTF-8"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))

"""Secret scans with assignment-aware lexing.

Two layers. Fixed patterns give the base spans (``assign``, ``access``,
``hex``). Then lines of source or configuration syntax are lexed into
assignments ``name = value`` (also ``:``, ``:=``, ``=>``, with declaration
keywords, quoted keys and ``+`` concatenation; a value may stand on the line
after its sign). A value without quotes that is
neither a bound name nor a call is a literal up to the end of the line, a
comment after a blank, or a delimiter; one of letters alone, with dots and
underscores, could be a reference or prose and counts only in a line that is
``NAME=value`` as a whole. Names bound to a literal
propagate it to the names that they are assigned to, wherever in the document;
the binding before a use goes before one after it. A literal whose name, or a
name it reaches, is sensitive is scored by the name and by its own form. Literals
that reach ``min_score`` become ``literal`` spans.

Defined cases: null and empty texts have no spans; a very long text is scanned
whole; a span found twice counts once; repeated rows are scanned each; other
columns go along unseen, whatever their names, but secret_spans and
secret_score are replaced; an empty table gives an empty result.
Offsets are code points of the whole text, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append, read

# The base patterns, over UTF-8 bytes so that only ASCII letters fold.
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_STEMS = (b"passw", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "literal")

#: Sensitive name parts and how much each says.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.8, "privatekey": 1.0, "accesskey": 1.0, "authkey": 0.9, "encryptionkey": 1.0, "signingkey": 1.0}
_PARTS = tuple(part.encode() for part in SENSITIVE)
#: Names are compared without what isn't a letter or digit, and so are texts before they are lexed.
_FLAT = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NOT_FLAT = bytes(c for c in range(256) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_HEX_MAP = bytes(120 if 48 <= c <= 57 or 97 <= c <= 102 else 46 for c in range(256))

_LEX = re.compile(
    rb"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    rb"""|(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)|(?P<number>[0-9][A-Za-z0-9_.-]*)|(?P<op>:=|=>|==|!=|[=:+,;(){}\[\]<>])|(?P<rest>[^\s])"""
)
_DECLARE = {b"const", b"let", b"var", b"export", b"set", b"final", b"static", b"public", b"private", b"String", b"string", b"str", b"val", b"def"}
_PREFIXES = {b"b", b"f", b"r", b"u", b"br", b"rb", b"fr", b"rf"}
_BLOCKS = {b"|", b">", b"|-", b">-"}
_TAG = re.compile(rb"<([A-Za-z_][A-Za-z0-9_.-]*)>([^<>\n]+)</\1>")
_ASSIGNS = (b"=", b":", b":=", b"=>")
_BARE = re.compile(rb"""\s*([^\s"'`,;(){}\[\]]+)(?=\s*$|\s+(?:#|//|--|;)|\s*[,;)}\]])""")
_REFERENCE = re.compile(rb"[A-Za-z_.]+")
_WHOLE = re.compile(rb"\s*(?:export\s+)?[A-Za-z_][A-Za-z0-9_.-]*=[A-Za-z_]+\s*")
_PLACEHOLDER = re.compile(rb"\$\{.*\}|\$[A-Za-z_][A-Za-z0-9_]*|<[^<>]*>|\{\{.*\}\}|\{[A-Za-z0-9_]*\}|%[A-Za-z0-9_]+%|%\([A-Za-z0-9_]+\)s")


def sensitivity(name: bytes) -> float:
    flat = name.translate(_FLAT, _NOT_FLAT).decode()
    return max((w for part, w in SENSITIVE.items() if part in flat), default=0.0)


def strength(literal: bytes) -> float:
    """0 to 1 from the length and the entropy of a literal; 0 for placeholders and prose."""
    if len(literal) < 8 or b" " in literal or _PLACEHOLDER.fullmatch(literal) or len(set(literal)) < 5:
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, 0.4 + 0.3 * min(1.0, n / 24) + 0.3 * min(1.0, entropy / 4))


def _values(tokens: list, i: int) -> tuple[list[tuple[int, int, bytes]], bytes, int]:
    """The literals from token i on (joined by +, in parentheses, with prefixes or in threefold quotes), or else the name that stands there."""
    parts, name = [], b""
    while i < len(tokens) and tokens[i][1] == b"(":
        i += 1
    while i < len(tokens):
        kind, text, a, b = tokens[i]
        touching = i + 1 < len(tokens) and tokens[i + 1][0] == "string" and tokens[i + 1][2] == b
        if touching and (kind == "name" and text.lower() in _PREFIXES or kind == "string" and len(text) == 2):
            i += 1
            continue
        if kind == "string":
            parts.append((a + 1, b - 1, text[1:-1]))
        elif kind == "name" and not parts:
            name = text
        else:
            break
        if i + 1 < len(tokens) and tokens[i + 1][1] == b"+":
            i += 2
            continue
        return parts, name, i + 1
    return parts, name, i


def _bare(line: bytes, at: int, before: int) -> tuple[int, int, bytes] | None:
    """The value without quotes that stands at a place of a line with so many bytes before it."""
    m = _BARE.match(line, at)
    if not m or _REFERENCE.fullmatch(m[1]) and not _WHOLE.fullmatch(line):
        return None
    return before + m.start(1), before + m.end(1), m[1]


def _assignments(text: bytes) -> list[tuple]:
    """(name, literals, name that stands for a value, value without quotes) of each assignment, with byte places."""
    found, at, pending = [], 0, None
    for line in text.split(b"\n"):
        if b"</" in line:
            found += [(m[1], [(at + m.start(2), at + m.end(2), m[2])], b"", None) for m in _TAG.finditer(line)]
        if pending or b"=" in line or b":" in line or b"(" in line:
            tokens = [(m.lastgroup, m[0], at + m.start(), at + m.end()) for m in _LEX.finditer(line)]
            if pending and tokens:
                if not any(t[0] == "op" and t[1] in _ASSIGNS for t in tokens):
                    parts, source, _ = _values(tokens, 0)
                    found.append((pending, parts, source, None if parts else _bare(line, 0, at)))
                pending = None
            for i in range(1, len(tokens) - 2):  # a call with a name and its value
                if tokens[i][0] == "string" and tokens[i - 1][1] == b"(" and tokens[i + 1][1] == b",":
                    parts, _, _ = _values(tokens, i + 2)
                    if parts:
                        found.append((tokens[i][1].strip(b"\"'`"), parts, b"", None))
            for i in range(1, len(tokens)):
                if tokens[i][1] not in _ASSIGNS or tokens[i][0] != "op":
                    continue
                typed = i >= 3 and tokens[i][1] == b"=" and tokens[i - 2][1] == b":" and tokens[i - 1][0] == "name"
                keyed = i >= 3 and tokens[i - 1][1] == b"]" and tokens[i - 2][0] == "string" and tokens[i - 3][1] == b"["
                kind, name, _, _ = tokens[i - 3 if typed else i - 2 if keyed else i - 1]  # name: Type = value, table["name"] = value
                if kind not in ("name", "string") or name in _DECLARE:
                    continue
                name = name.strip(b"\"'`")
                rest = b"".join(t[1] for t in tokens[i + 1 :])
                if not rest or rest == b"\\" or rest in _BLOCKS and tokens[i][1] == b":":
                    pending = name
                    continue
                parts, source, end = _values(tokens, i + 1)
                if not parts and source and end < len(tokens) and tokens[end][1] in _ASSIGNS:
                    continue  # a type; the later sign assigns
                found.append((name, parts, source, None if parts else _bare(line, tokens[i][3] - at, at)))
        at += len(line) + 1
    return found


def literals(text: bytes, min_score: float = 0.5) -> list[tuple[int, int, float]]:
    """Byte spans and scores of literals that reach a sensitive name."""
    made = _assignments(text)
    first: dict[bytes, tuple] = {}
    for name, parts, source, bare in made:
        if parts or source or bare:
            first.setdefault(name, (parts, source, bare))

    known: dict[bytes, list] = {}

    def reached(name: bytes, start: bytes) -> list:
        """The literal that a name is bound to anywhere, over any number of other names; the nearest to it without quotes, if there is no other."""
        chain, seen, bare = [], {start}, None
        while name not in seen and name in first:
            if name in known:
                return known[name]
            seen.add(name)
            chain.append(name)
            parts, source, plain = first[name]
            bare = plain or bare
            if parts or not source:
                found = list(parts) or ([bare] if bare else [])
                if found:
                    known.update(dict.fromkeys(chain, found))
                return found
            name = source
        return [bare] if bare else []

    bound: dict[bytes, list[tuple[int, int, bytes]]] = {}
    found: dict[tuple[int, int], float] = {}
    for name, parts, source, bare in made:
        parts = parts or bound.get(source) or (reached(source, name) if source else []) or ([bare] if bare else [])
        if parts:
            bound[name] = parts
            score = sensitivity(name) * strength(b"".join(p[2] for p in parts))
            if score >= min_score:
                for a, b, _ in parts:
                    found[a, b] = max(score, found.get((a, b), 0.0))
    return sorted((a, b, s) for (a, b), s in found.items())


def scan(text: bytes) -> tuple[list[tuple[int, int, int]], float]:
    """(start, kind, end) in code points, by start and kind, and the score of the document."""
    low, flat = text.lower(), text.translate(_FLAT, _NOT_FLAT)
    spans: list[tuple[int, int, int]] = []
    score = 0.0
    if any(s in low for s in _STEMS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"x" * 16 in text.translate(_HEX_MAP):
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(part in flat for part in _PARTS):
        for a, b, s in literals(text):
            spans.append((a, 3, b))
            score = max(score, s)
    if not spans:
        return [], 0.0
    base = {k for _, k, _ in spans}
    score = max(score, 1.0 if 1 in base else 0.9 if 0 in base else 0.6 if 2 in base else 0.0)
    spans.sort()
    if not text.isascii():
        chars, before, out = 0, 0, {}
        for at in sorted({x for a, _, b in spans for x in (a, b)}):
            chars += len(text[before:at].decode(errors="replace"))
            before, out[at] = at, chars
        spans = [(out[a], k, out[b]) for a, k, b in spans]
    return spans, score


def find_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with secret_spans (kind, start, end) and secret_score."""

    def make():
        def work(rows: list[bytes]) -> dict:
            both = [scan(text) for text in rows]
            return {
                "secret_spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans, _ in both],
                "secret_score": [s for _, s in both],
            }

        return work

    return append(docs, text_col, make, "secret_spans array<struct<kind:string,start:long,`end`:long>>, secret_score double")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("secret_spans")).alias("spans"),
        F.col("secret_score").alias("score"),
    )

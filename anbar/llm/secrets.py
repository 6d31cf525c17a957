"""Secret scan with an assignment-aware lexer.

Fixed patterns find the known shapes (`assign`, `access`, `hex`). Beyond them, a lexer reads
source and configuration syntax as pairs of a name and a literal: ``name = "x"``,
``name: x``, ``"name": "x"``, ``name := 'x'``, ``name => "x"``, ``put("name", "x")``,
``<name>x</name>``, and strings joined by ``+``. A type may stand between (``name: str = "x"``,
``name string = "x"``, ``char name[] = "x"``). A literal may reach a sensitive name over other
names (``a = "x"`` and later ``password = a``, ``password = a = "x"``); such constants are propagated. Each
literal is scored by the most sensitive name it reaches and by how random it looks. Literals
above the bar become spans of kind ``named``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anbar.llm.common import per_text, table

# --- fixed values: kinds in order and their patterns -------------------------
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

# --- fixed values: words of names --------------------------------------------
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9,
    "auth": 0.6, "authorization": 0.8, "pass": 0.7, "pin": 0.5, "key": 0.4, "salt": 0.5,
}
#: With "key" these make a name as sensitive as a password.
KEY_KINDS = {"api", "access", "private", "secret", "signing", "encryption", "master", "account"}
#: A name that ends so tells about a secret but does not hold it.
ABOUT = {
    "hint", "label", "length", "count", "policy", "url", "uri", "path", "file", "field",
    "type", "expiry", "expires", "ttl", "min", "max", "regex", "pattern", "prompt", "header",
}
PLACEHOLDERS = {
    "null", "none", "true", "false", "undefined", "required", "optional", "string", "example",
    "placeholder", "changethis", "redacted", "your_password", "yourpassword",
}

#: Words of messages: a literal of words with one of them is no passphrase.
MESSAGE = {
    "a", "an", "and", "are", "at", "be", "by", "can", "cannot", "do", "does", "enter", "for", "from", "has",
    "have", "in", "incorrect", "invalid", "is", "it", "missing", "must", "my", "new", "no", "not", "of", "on",
    "or", "password", "please", "required", "should", "that", "the", "this", "to", "use", "was", "were",
    "will", "with", "wrong", "you", "your",
}

_STRING = r'"(?:[^"\\\n]|\\.)*+"' + r"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"
_NAME = r"[A-Za-z_$][\w$.-]*+"
#: After a colon: references and pointers, a name with arguments, alternatives.
_TYPE = (
    r"[&*?]*+(?:'[a-z_]\w*+[ \t]++)?(?:mut[ \t]++)?[A-Za-z_][\w.]*+(?:::\w++)*+"
    r"(?:[<\[][^\n=;\"`]{0,80}?[>\]])?[?!*&]*+(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+"
)
#: Behind the name without a colon only known types, as `String name = "x"` looks the same.
_TYPE_WORD = (
    r"(?:\*|\[\])*+(?i:string|str|bytes?|char|text|any|interface\{\}|"
    r"n?(?:var)?char2?[ \t]*+\([ \t]*+\w++[ \t]*+\)|n?varchar2?)\??"
)
PAIR = re.compile(
    rf"(?<![\w$.-])(?:--?)?(?P<q>[\"']?)(?P<name>{_NAME})(?P=q)(?:\]|\[(?P<index>\w*+)\])?+[ \t]*+"
    rf"(?:(?::[ \t]*+{_TYPE}|(?<=[ \t]){_TYPE_WORD})[ \t]*+=(?![=>])[ \t]*+"
    rf"|(?::=|=>|=(?!=)|:(?!//))[ \t]*+|(?P<comma>,)[ \t]*+(?=[\"'`]))"
    rf"(?:(?P<literal>(?:{_STRING})(?:[ \t]*+\+[ \t]*+(?:{_STRING}))*+)"
    # An inner name of a chain is left for the next match.
    rf"|(?=(?P<inner>{_NAME})(?:[ \t]++=(?!=)[ \t]*+(?=[\"'`\w$])|=[\"'`]))"
    rf"|(?P<bare>[^\s\"'`,;(){{}}\[\]<>]++))",
    re.ASCII,
)
ELEMENT = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\s]++)</(?P=name)>", re.ASCII)
PIECE = re.compile(_STRING)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
BAR, LEAST_CHARS = 1.2, 8


def name_score(name: str) -> float:
    """How sensitive what a name holds is, 0 to 1."""
    parts = [p.lower() for p in PART.findall(name)]
    if not parts or parts[-1] in ABOUT:
        return 0.0
    if "key" in parts and KEY_KINDS & set(parts):
        return 1.0
    return max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)


def literal_score(text: str) -> float:
    """How random a literal looks, 0 to 1: its entropy in bits over 48, 0 for placeholders."""
    low = text.lower()
    if len(text) < LEAST_CHARS or low in PLACEHOLDERS:
        return 0.0
    words = low.split()
    if len(words) > 1 and (
        MESSAGE & {w.strip(".,:;!?") for w in words} or len(words) < 3 and all(w.isalpha() for w in words)
    ):
        return 0.0
    if low.startswith(("${", "{{", "<", "$(", "%(", "your", "http://", "https://")):
        return 0.0
    counts = Counter(text)
    if len(counts) < 4:
        return 0.0
    n = len(text)
    bits = -sum(c * math.log2(c / n) for c in counts.values())
    kinds = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 48) * (0.55 if kinds == 1 else 1.0)


def _pairs(text: str) -> Iterator[tuple[str, str, list[tuple[int, int]], bool]]:
    """(name, literal or bare word, places of its pieces, whether it is quoted)."""
    for m in PAIR.finditer(text):
        # table[name] = "x" sets name, name[n] = "x" too
        names = [m["name"], m["index"]] if m["index"] and not m["index"].isdigit() else [m["name"]]
        if m["literal"]:
            if m["comma"] and not m["q"]:
                continue  # f(x, "y"): x is no name of y
            at = m.start("literal")
            spans = [(at + p.start() + 1, at + p.end() - 1) for p in PIECE.finditer(m["literal"])]
            value, quoted = "".join(text[a:b] for a, b in spans), True
        elif m["inner"]:
            value, spans, quoted = m["inner"], [m.span("inner")], False
        elif not text.startswith("(", m.end()):  # a call is no literal
            value, spans, quoted = m["bare"], [m.span("bare")], False
        else:
            continue
        for name in names:
            yield name, value, spans, quoted
    for m in ELEMENT.finditer(text):
        yield m["name"], m["value"], [m.span("value")], False


def _reach(names: set[str], sources: dict[str, set[str]]) -> dict[str, float]:
    """The highest score of a name or of the names that are set from it, over any steps."""
    reach: dict[str, float] = {}
    for start in sorted(names, key=lambda n: (-name_score(n), n)):
        waiting = [start]
        while waiting:
            name = waiting.pop()
            if name not in reach:
                reach[name] = name_score(start)
                waiting += sources.get(name, ())
    return reach


def named_literals(text: str) -> list[tuple[int, int]]:
    """Places of the literals that reach a sensitive name and look like a secret."""
    pairs = list(_pairs(text))
    names = {name for name, _, _, _ in pairs}
    sources: dict[str, set[str]] = {}
    for name, value, _, quoted in pairs:
        if not quoted and value in names and value != name:
            sources.setdefault(name, set()).add(value)
    reach = _reach(names, sources)
    found: set[tuple[int, int]] = set()
    for name, value, spans, quoted in pairs:
        reference = not quoted and value in names
        if reach[name] and not reference and reach[name] + literal_score(value) >= BAR:
            found.update(spans)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        found += [
            (m.start(), 0, m.end())
            for m in ASSIGN.finditer(text)
            if m.end(1) - m.start(1) >= ASSIGN_CHARS
        ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_CHARS
        ]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans. A literal inside a base span is not told twice."""
    base = base_spans(text)
    named = []
    for a, b in named_literals(text):
        if not any(s <= a and b <= e for s, _, e in base):
            named.append((a, 3, b))
    return base, sorted(base + named)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, and the columns of the spans.

    n_assign, n_access, n_hex (long): base spans; base_spans and spans: ``kind:start:end`` by
    start, then kind, comma-joined, in code points, end exclusive. Null text counts as empty.
    Whole texts are scanned, one at a time, so memory is bounded by a batch and a text.
    """

    def scanned(texts: list[str | None]) -> Iterator[tuple]:
        for value in texts:
            base, spans = scan(value or "")
            kinds = Counter(k for _, k, _ in base)
            yield kinds[0], kinds[1], kinds[2], _joined(base), _joined(spans)

    fields = "n_assign long, n_access long, n_hex long, base_spans string, spans string"
    return per_text(docs, key, text, fields, scanned)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans",
    )

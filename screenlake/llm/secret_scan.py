"""Secrets in texts that hold source code and configuration, by assignment-aware lexing.

Three fixed patterns are the base (``assign``, ``access``, ``hex``).  The method adds ``literal`` spans:

1. *Lexing.*  Every assignment is read as a target name and a value: ``name = "x"``, ``name: x``,
   ``"name": "x"``, ``name => 'x'``, ``<name>x</name>``, ``name``/``value`` attribute pairs, settings
   inside a string (``"user=x;password=y"``), the user part of a URL.  A value is a chain of string literals, bare words and references to other names.
2. *Constants.*  A name that another assignment refers to takes over the sensitivity of that target,
   over any number of steps, in either order of the text, and through ``${name}`` in configuration.
3. *Scores.*  A literal scores by the words of its most sensitive target and by how much it looks like
   a value rather than a placeholder, a label or prose.  From ``threshold`` on it is a secret.

A literal within a base span is not reported again.  Spans are in code points.  Each text is judged
for itself.  Defined cases: a null text is empty and has no spans; texts of any length are read whole,
in time linear in their length; equal scores keep the first target by text order; repeated rows and
null ids get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.llm.arrow import parts

THRESHOLD = 0.5
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# runs are longest from their first character on, so the length may stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

_NAME = r"[A-Za-z_$][\w$.-]*+"
_TARGET = re.compile(rf"""(?:(?<![\w$.-])(?P<name>{_NAME})\]?|(?P<quote>["'])(?P<key>[^"'\n]+)(?P=quote)\]?)[ \t]*(?::=|=>|\?=|[:=](?![=:]))[ \t]*""", re.ASCII)
_ELEMENT = re.compile(rf"<(?P<name>{_NAME})(?:\s[^<>]*)?>(?P<value>[^<>\n]+)</", re.ASCII)
_SETTING = re.compile(rf"(?<![\w$.-])(?P<name>{_NAME})=(?P<value>[^;&\s\"'=]++)", re.ASCII)
_USER = re.compile(r"[a-z][a-z0-9+.-]*+://[^\s:/@]*+:(?P<value>[^\s/@]++)@", re.ASCII)
_STRING = re.compile(r'''[rRbBuUfF]{0,2}(?:"""(?P<a>(?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'(?P<b>(?:[^'\\]|\\.|'(?!''))*+)\'\'\'|"(?P<c>(?:[^"\\\n]|\\.)*+)"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`]*+)`)''', re.DOTALL)
_REFERENCE = re.compile(r"\$\{(?P<braced>[\w.-]+)\}|\$(?P<plain>\w+)|(?P<name>" + _NAME + ")", re.ASCII)
_BARE = re.compile(r"""[^\s,;"'`(){}\[\]<>#]++""")
_JOIN = re.compile(r"\s*(?:\+|\.\.|&|\\\n)\s*|[ \t]+(?=[\"'`])|\s*\n\s*(?=[\"'])")
_OPEN = re.compile(r"(?:\(\s*|new\s+|export\s+)*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# fixed values: words of a name and their weights, words that make them harmless, values that stand for none
_WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "credential": 1.0, "credentials": 1.0, "token": 0.9, "apikey": 1.0, "bearer": 0.8, "jwt": 0.9, "psk": 0.9, "otp": 0.7, "pin": 0.6, "salt": 0.6, "auth": 0.5, "key": 0.4}
_WITH_KEY = {"api", "access", "private", "secret", "encryption", "signing", "account", "master", "client", "auth", "storage", "service", "license", "webhook", "ssh"}
_HARMLESS = {"count", "length", "len", "max", "min", "limit", "size", "name", "file", "path", "url", "uri", "type", "field", "label", "hint", "prompt", "policy", "format", "regex", "pattern", "expiry", "expires", "ttl", "age", "header", "public", "primary", "foreign", "enabled", "required", "placeholder", "title", "text", "message", "error", "help", "description", "column", "version"}
_NO_VALUE = {"password", "secret", "changeme", "change_me", "example", "placeholder", "undefined", "required", "optional", "string", "unknown", "default", "redacted", "hidden", "disabled", "enabled"}
_NAMING = {"name", "key", "id"}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    name: str | None = None
    score: float = 1.0


class Pair(NamedTuple):
    """A target and its value: pieces (start, end, quoted), and the names it refers to."""

    target: str
    pieces: list[tuple[int, int, bool]]
    references: list[str]


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, leftmost and without overlap for each kind."""
    found = [Span("assign", m.start(), m.end(), m[1].lower()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return found + [Span(kind, *m.span()) for kind, pattern in (("access", _ACCESS), ("hex", _HEX)) for m in pattern.finditer(text)]


def _value(text: str, at: int) -> tuple[list[tuple[int, int, bool]], list[str], int]:
    """The pieces and references of the value that starts at ``at``, and where its last literal ends."""
    pieces, references, used = [], [], at
    at = _OPEN.match(text, at).end()
    while True:
        string = _STRING.match(text, at)
        if string:
            pieces.append((*string.span(string.lastgroup), True))
            used = at = string.end()
        else:
            reference, bare = _REFERENCE.match(text, at), _BARE.match(text, at)
            if reference and text[reference.end() : reference.end() + 1] == "(":
                break  # a call: its value is not written here
            if reference and (bare is None or reference.end() >= bare.end()):
                references.append(reference[reference.lastgroup])
            if not bare:
                at = reference.end() if reference else at
            else:
                pieces.append((*bare.span(), False))
                at = bare.end()
                # what may be a name can be the target of the next assignment
                if not reference or reference.end() < at:
                    used = at
            if not (reference or bare):
                break
        joined = _JOIN.match(text, at)
        if not joined:
            break
        at = joined.end()
    return pieces, references, used


def pairs(text: str) -> Iterator[Pair]:
    """The assignments of a text in order."""
    named, at = None, 0
    while m := _TARGET.search(text, at):
        target = m["name"] or m["key"]
        # literals are read once, so the work is linear
        pieces, references, at = _value(text, m.end())
        if not pieces and not references:
            continue
        if target.lower() == "value" and named:
            target = named
        # name: x, value: y and key="x" value="y" name what comes next
        named = text[slice(*pieces[0][:2])] if target.lower() in _NAMING and pieces else None
        yield Pair(target, pieces, references)
        for a, b, quoted in pieces:
            if quoted:
                for inner in _SETTING.finditer(text, a, b):
                    yield Pair(inner["name"], [(*inner.span("value"), False)], [])
    for m in _ELEMENT.finditer(text):
        yield Pair(m["name"], [(*m.span("value"), True)], [])
    for m in _USER.finditer(text):
        yield Pair("password", [(*m.span("value"), True)], [])


def name_score(name: str) -> float:
    """How sensitive a target is, by the words of its name."""
    words = [w.lower() for w in _WORDS.findall(name)]
    score = max((_WEIGHTS.get(w, 0.0) for w in words), default=0.0)
    if ("key" in words or "keys" in words) and _WITH_KEY & set(words):
        score = 1.0
    return score * (0.2 if _HARMLESS & set(words) else 1.0)


def value_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a value of its own."""
    low = value.strip().lower()
    if len(low) < 6 or len(set(low)) < 3 or low in _NO_VALUE or low.startswith(("your", "<", "{{", "${", "%(", "xxx", "***", "...")):
        return 0.0
    if low.startswith(("http://", "https://", "/", "./")):
        return 0.3
    if any(c.isspace() for c in low):
        label = any(_WEIGHTS.get(w.lower(), 0) >= 0.8 for w in _WORDS.findall(value))
        return 0.2 if label or not quoted or len(low.split()) > 8 else 0.5
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if kinds >= 3 or (kinds == 2 and any(c.isdigit() for c in value)):
        return 1.0
    return 0.7 if quoted else 0.3


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """The literals that flow into sensitive names."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    found = list(pairs(text))
    defined = {p.target for p in found}
    best: dict[str, tuple[float, str]] = {}
    sources: dict[str, set[str]] = defaultdict(set)
    for p in found:
        if p.target not in best:
            best[p.target] = (name_score(p.target), p.target)
        sources[p.target].update(r for r in p.references if r in defined and r != p.target)
    # sensitivity goes back along references until nothing rises
    queue = [t for t, (score, _) in best.items() if score and sources[t]]
    while queue:
        target = queue.pop()
        for source in sources[target]:
            if best[target][0] > best[source][0]:
                best[source] = best[target]
                queue.append(source)
    out = {}
    for p in found:
        score, name = best[p.target]
        own = [(a, b, quoted) for a, b, quoted in p.pieces if quoted or text[a:b] not in defined]
        if not score or not own:
            continue
        score *= value_score("".join(text[a:b] for a, b, _ in own), all(q for _, _, q in own))
        if score >= threshold:
            for a, b, _ in own:
                if a < b and out.get((a, b), (0,))[0] < score:
                    out[a, b] = (score, name)
    return [Span("literal", a, b, name, round(score, 6)) for (a, b), (score, name) in out.items()]


def secrets(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text by start, then by kind."""
    base = base_spans(text or "")
    ends, reach = [], 0
    for s in sorted(base, key=lambda s: s.start):
        reach = max(reach, s.end)
        ends.append((s.start, reach))
    added, at = [], -1
    for s in sorted(literal_spans(text or "", threshold), key=lambda s: s.start):
        while at + 1 < len(ends) and ends[at + 1][0] <= s.start:
            at += 1
        # within a base span: reported already
        if at < 0 or s.end > ends[at][1]:
            added.append(s)
    return sorted(base + added, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, with ``secrets``: kind, start, end, target name and score of each span."""
    kept = [c for c in docs.columns if c not in (text, "secrets")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [[s._asdict() for s in secrets(t, threshold)] for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(found, _ARROW)], names=[*kept, "secrets"])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("secrets", _SPANS)])
    return docs.select(*[f"`{c}`" for c in kept], text).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; overlapping spans become one."""
    at = docs.columns.index(text)

    def cleaned(value: str | None) -> str | None:
        out, end = [], 0
        for s in secrets(value, threshold):
            if s.start >= end:
                out += [value[end : s.start], mask]
            end = max(end, s.end)
        return value if not out else "".join(out) + value[end:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.set_column(at, batch.schema.field(at), pa.array([cleaned(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``secrets`` by document."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))

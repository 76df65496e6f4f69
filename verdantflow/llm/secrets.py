"""Secret scans: fixed patterns, and literals that source or configuration syntax gives to a sensitive name.

A text is lexed into pairs of a name and a value: assignments of programs, keys of JSON, YAML and property files,
attributes and elements of XML, options of commands, arguments of setters, credentials in URLs. A value is made of
literals and other names. Names carry a weight; what a sensitive name gets is scored, also over the constants
and the names in between.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdantflow.llm.shared import slices

#: The patterns of the base scan, the least length of what they name, in the order of their kinds.
ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "literal")
LEAST = 0.5

#: How much a word of a name tells that its value is secret; several words add up as independent evidence.
SENSITIVE = {
    "password": 0.95, "passwd": 0.95, "passphrase": 0.95, "passwort": 0.9, "pwd": 0.9, "secret": 0.9, "apikey": 0.9, "credential": 0.85, "credentials": 0.85,
    "token": 0.8, "bearer": 0.8, "jwt": 0.8, "pass": 0.75, "authorization": 0.75, "private": 0.6, "auth": 0.55, "signing": 0.5, "encryption": 0.5, "key": 0.45, "api": 0.4,
    "access": 0.4, "salt": 0.4, "session": 0.35, "cookie": 0.35, "client": 0.2, "master": 0.3, "admin": 0.2, "dsn": 0.4,
}
#: Words by which a sensitive name is about something else, such as the length of a token.
HARMLESS = frozenset("count max min limit length size type name id url uri path file field column label hint prompt expiry expires ttl policy public primary foreign sort partition format regex pattern header prefix suffix enabled required index text".split())

_STEM = "(?i)" + "|".join(("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "jwt", "private", "://[^\\s/]*:[^\\s/]*@", "access", "salt", "session", "cookie", "signing", "encryption", "dsn", "api"))
_ASSIGN_STEM = "(?i)password|passwd|secret|token|api_?key"
_assign, _access, _hex = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
_pair = re.compile(r"""(?<![\w$.\-])(?P<name>[A-Za-z_$][\w$.\-]*)["']?\]?[ \t]*(?P<op>=>|:=|\?=|\+=|:(?![:/])|=(?![=~>]))[ \t]*(?:&(?P<anchor>\w+)[ \t]+)?""", re.A)
_other = re.compile(
    r"""<(?P<tag>[A-Za-z_][\w.\-]*)>(?P<body>[^<>]+)</"""
    r"""|--(?P<option>[A-Za-z][\w\-]*)[ \t]+["']?(?P<given>[^\s"'=\-][^\s"']*)"""
    r"""|\b(?:key|name)[ \t]*=[ \t]*(?P<q>["'])(?P<key>[^"'\n]*)(?P=q)[ \t]+(?:value|content)[ \t]*=[ \t]*["'](?P<content>[^"'\n]*)["']"""
    r"""|\([ \t]*(?P<r>["'])(?P<argument>[\w.\-]+)(?P=r)[ \t]*,[ \t]*["'](?P<set>[^"'\n]*)["']"""
    r"""|://(?P<user>[^\s:/@"'?#]*):(?P<login>[^\s:/@"']+)@""",
    re.A,
)
_string = re.compile(r'''[rRbBuUfF]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)''')
_name = re.compile(r"(?:\$\{?|\*|%)?([A-Za-z_][\w.]*)\}?%?", re.A)
_bare = re.compile(r"""[^\s"'`,;#<>(){}\[\]=:&|]+={0,2}""")
_variable = re.compile(r"\$\{(\w+)\}|\$\((\w+)\)", re.A)
_typed = re.compile(r"[ \t]*=(?![=>])[ \t]*")
_scheme = re.compile(r"(?:Bearer|Basic|Token)[ \t]+", re.I)
_join = re.compile(r"[ \t]*(?:\+|\.\.?(?=[ \t])|(?=[\"']))[ \t]*(?:\\?\n[ \t]*)?")
_words = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", re.A)
_placeholder = re.compile(r"(?i)(?:[x*.#_\-]+|change_?me.*|example.*|your.*|my_?(?:password|secret|token).*|<.*>|\$.*|\{\{.*|%.*|null|none|nil|true|false|undefined|todo|test|dummy|redacted|password|secret|token)")


@dataclass
class Pair:
    """A name, where its value begins, and what it is made of: spans of literals, and other names."""

    name: str
    at: int
    literals: list[tuple[int, int]] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)


def _own(name: str) -> str:
    """A name without the object that it is a member of."""
    return re.sub(r"^(?:self|this|env|process\.env)\.", "", name)


def _value(text: str, at: int, typed: bool) -> tuple[list[tuple[int, int]], list[str]]:
    """Literals and names of the value that begins at a place: strings, names and bare words, joined by ``+`` or side by side."""
    literals, refs = [], []
    while True:
        for mark in ('"""', "'''"):
            if text.startswith(mark, at):
                end = text.find(mark, at + 3)
                if end < 0:
                    return literals, refs
                literals.append((at + 3, end))
                at = end + 3
                break
        else:
            scheme = _scheme.match(text, at)
            at = scheme.end() if scheme else at
            if m := _string.match(text, at):
                k = m.lastindex or 1
                inner = _scheme.match(text, m.start(k), m.end(k))
                literals.append((inner.end() if inner else m.start(k), m.end(k)))
            elif m := _variable.match(text, at):
                refs.append(m[m.lastindex])
            elif m := _bare.match(text, at):
                own = _name.fullmatch(text, at, m.end())
                if own and typed and (more := _typed.match(text, own.end())):
                    at, typed = more.end(), False  # name: type = value
                    continue
                if text[m.end() : m.end() + 1] in ("(", "["):  # a call or a member: nothing is known of it
                    return literals, refs
                if own:
                    refs.append(_own(own[1]))
                literals.append((at, m.end()))
            else:
                return literals, refs
            at = m.end()
        typed = False
        more = _join.match(text, at)
        if not more or more.end() == at and text[at : at + 1] not in ("'", '"'):
            return literals, refs
        at = more.end()


def pairs(text: str) -> list[Pair]:
    """All pairs of names and values of a text, in order; a value that holds pairs itself (a URL, JSON) is lexed too."""
    found, closed = [], True
    for m in _pair.finditer(text):
        at = m.end()
        if text.startswith(('"""', "'''"), at):  # an open block would be searched to the end for each of its marks
            if not closed or text.find(text[at : at + 3], at + 3) < 0:
                closed = False
                continue
        literals, refs = _value(text, at, m["op"] == ":")
        if literals or refs:
            found.append(Pair(_own(m["name"]), at, literals, refs))
            if m["anchor"]:
                found.append(Pair(m["anchor"], at, literals, refs))
    for m in _other.finditer(text):
        for name, value in (("tag", "body"), ("option", "given"), ("key", "content"), ("argument", "set"), ("user", "login")):
            if m[value]:
                found.append(Pair("password" if name == "user" else m[name], m.start(value), [m.span(value)]))
    return sorted(found, key=lambda p: p.at)


def name_score(name: str) -> float:
    """How sensitive a name is, 0 to 1: its words in snake, kebab or camel case."""
    words = [w.lower() for w in _words.findall(name)]
    harmless = sum(w in HARMLESS for w in words)
    return (1 - math.prod(1 - SENSITIVE.get(w, 0.0) for w in words)) * 0.2**harmless


def literal_score(value: str) -> float:
    """How much a literal looks like a secret and not like a placeholder, a number, a path or prose."""
    if len(value) < 6 or _placeholder.fullmatch(value):
        return 0.0
    bits = -sum(n * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum() and not c.isspace()))
    shape = (0.0, 0.4, 0.9, 1.0, 1.0)[classes]
    prose = 0.3 if " " in value or "\t" in value else 0.5 if value.startswith(("/", "./", "http")) else 1.0
    return min(1.0, bits / 20) * shape * prose


def secret_literals(text: str, least: float = LEAST) -> list[tuple[int, int]]:
    """Spans of literals that a sensitive name gets, by itself or over other names; each once, in order.

    A name stands for its last value before its use, or for its first after it where there is none before.
    """
    every = pairs(text)
    places: dict[str, list[int]] = {}
    for i, p in enumerate(every):
        places.setdefault(p.name, []).append(i)
    found, seen = set(), set()
    rated = sorted(((name_score(name), i) for name, own in places.items() for i in own), key=lambda x: (-x[0], x[1]))
    for score, i in rated:
        if score < least:
            break
        todo = [i]
        while todo:
            k = todo.pop()
            if k in seen:  # it was reached from a name of no lower score
                continue
            seen.add(k)
            known = {r for r in every[k].refs if r in places}
            for a, b in every[k].literals:
                if score * literal_score(text[a:b]) >= least and _own(text[a:b].strip("${}*%")) not in known:
                    found.add((a, b))
            for r in known:
                own = places[r]
                before = bisect_right(own, k - 1)
                todo.append(own[before - 1] if before else own[0])
    return sorted(found)


def base_spans(text: str, kinds: tuple[str, ...] = KINDS[:3]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in a text, in order; a match that is too short is dropped but not searched again."""
    out = []
    if "assign" in kinds:
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[1]) >= 12]
    if "access" in kinds:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if len(m[0]) >= 18]
    if "hex" in kinds:
        out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in slices(batches, "text"):
        texts = pc.fill_null(batch.column("text"), "")
        # a pattern is searched in texts that can have it
        can = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in (("assign", _ASSIGN_STEM), ("access", "AKIA"), ("hex", "[0-9a-f]{16}"), ("literal", _STEM))}
        n = batch.num_rows
        counts, digests, spans = [[0] * n for _ in range(3)], [empty] * n, [""] * n
        for i in (can["assign"] | can["access"] | can["hex"] | can["literal"]).nonzero()[0].tolist():
            text = texts[i].as_py()
            base = base_spans(text, tuple(k for k in KINDS[:3] if can[k][i]))
            starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
            more = []
            for a, b in secret_literals(text, least) if can["literal"][i] else ():
                k = bisect_right(starts, a)
                if not (k and ends[k - 1] >= b):  # a base span that starts no later and ends no earlier has it
                    more.append((a, 3, b))
            for k in range(3):
                counts[k][i] = sum(kind == k for _, kind, _ in base)
            digests[i], spans[i] = hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(sorted(base + more))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_assign, n_access, n_hex, base_sha256, spans``.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) by start, then kind, comma-joined: the base
    matches, and literals with a score of ``least`` or more that no base match holds. ``base_sha256`` is of the base
    matches in the same form. A null text is empty; texts of any length are scanned whole, each by itself, so rows
    that repeat an id or a text stay rows; nothing is shuffled. Columns beyond id and text play no part.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _scan(b, least), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

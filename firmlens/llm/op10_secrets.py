"""Secret scan: three base patterns, and assignment-aware lexing on top.

Base spans are the leftmost non-overlapping matches of each pattern, too short
ones dropped.  The lexer reads source and configuration syntax into pairs of a
target name and a value:

* ``name = value`` with ``=``, ``:=``, ``=>`` or ``:``, the name bare, quoted, behind ``--``,
  in a subscript (``cfg["name"] = ``) or with a type (``name: string = ``, ``var name string = ``, ``name[32] = ``);
* ``<name>value</name>``, ``key="name" value="value"``, and calls that begin with a name and a value (``setenv("name", "value")``);
* values are literals in single, double, back or triple quotes, bare words, joined literals and names, elements of
  lists, parentheses and calls, quoted literals on the next line, and indented YAML blocks behind ``|`` or ``>``.

A name that was assigned before stands for its value, so constants reach the names they are
passed on to.  Values share what they are made of, and each literal is given out once, so
chains of constants cost no more than their text.  Pairs inside a literal are read as well,
behind its escapes.  What a value looks like and the words of its target name make a score;
from ``THRESHOLD`` on the value's literals are spans of kind ``named``, unless a base span covers them already.
Elements of a list or call are scored one by one, joined literals together.

Spans count code points, ends are exclusive.  Results: a null or empty text has
no spans and stays as it is; every row is read by itself and whole; an empty
table gives no rows; other columns are kept by ``redact`` and ignored elsewhere.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import rebatched

KINDS = ("assign", "access", "hex", "named")
_CASELESS = re.IGNORECASE | re.ASCII
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _CASELESS)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of fewer than 24 is dropped anyway, and runs are maximal: the same spans as of one or more.
_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

# Lexing: a target with its operator, and the terms behind it.
_TARGET = re.compile(
    r"""(?<![\w.$-])(?:key|name)\s*+=\s*+(?P<q2>["'])(?P<key>[A-Za-z_$][\w.$-]*+)(?P=q2)\s++value\s*+=\s*+(?=["'])
        |(?<![\w.$-])(?:(?:--?)?(?P<quote>["'`]?)(?P<name>[A-Za-z_$][\w.$-]*+)(?P=quote)(?:\s*+\]|\[\d*+\])?(?:\s*+(?P<sign>:=|=>|=(?![=~])|:(?![:/]))|
            (?:(?<=var)|(?<=const)|(?<=let)|(?<=val))[ \t]++(?P<declared>[A-Za-z_]\w*+)[ \t]++[A-Za-z_*\[][\w.*\[\]<>]*+[ \t]*+=(?![=~]))[ \t]*+)
        |<(?P<tag>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>(?:<!\[CDATA\[)?\s*+(?P<content>[^<>\s](?:[^<>\n]*[^<>\s\]])?)\s*+(?:\]\]>)?</(?P=tag)
        |\(\s*+(?P<q1>["'])(?P<first>[A-Za-z_$][\w.$-]*+)(?P=q1)\s*+,\s*+(?=["'`])""", re.ASCII | re.VERBOSE
)
_TYPE = re.compile(r"[A-Za-z_&*][\w.<>\[\]|?&*, \t]*+=(?![=~>])[ \t]*+", re.ASCII)
_TERM = re.compile(
    r"""(?:[bBfFrRuU]{0,2})(?:\"{3}((?:[^"\\]++|\\.|"(?!""))*+)\"{3}|\'{3}((?:[^'\\]++|\\.|'(?!''))*+)\'{3}|"((?:[^"\\\n]++|\\.)++)"|'((?:[^'\\\n]++|\\.)++)'|`([^`\n]++)`)
        |([A-Za-z_$][\w.$]*)(?![\w+/=-])|([^\s,;"'`\#{}()\[\]<>]+)""", re.ASCII | re.DOTALL | re.VERBOSE
)
_LITERALS, _NAME, _BARE = (1, 2, 3, 4, 5), 6, 7
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|&)[ \t]*\\?\n?[ \t]*|[ \t]+(?=[\"'])")
_NEXT_LINE = re.compile(r"""\n[ \t]*+(?=["'`(\[])""")
_OPEN = re.compile(r"[(\[{][\s(\[{]*+")
_BETWEEN = re.compile(r"[\s,)\]}(\[{]++")
_BLOCK = re.compile(r"[|>][+-]?\d?[ \t]*+\n")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_.:/ -]*")
_SIGN = re.compile("[:=]")
_ESCAPE = re.compile(r"""\\([\\"'`/nrt])""")
_BLANKS = {"n": "\n", "r": "\r", "t": "\t"}
# How much a word of the target's name says: for a secret, or against.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.5, "signing": 0.5,
    "encryption": 0.5, "access": 0.4, "key": 0.5, "salt": 0.4, "api": 0.3, "client": 0.1,
    "public": -0.8, "name": -0.6, "file": -0.6, "path": -0.6, "url": -0.6, "uri": -0.6, "type": -0.6, "length": -0.8, "size": -0.8,
    "count": -0.8, "max": -0.5, "min": -0.5, "field": -0.6, "header": -0.4, "column": -0.6, "index": -0.6, "primary": -0.8, "foreign": -0.8,
    "id": -0.3, "hint": -0.6, "label": -0.6, "expiry": -0.8, "ttl": -0.8, "limit": -0.8,
}
THRESHOLD = 0.8
NAMED_LEAST = 8
_PLACEHOLDER = re.compile(r"(?i)^(?:(.)\1*|change_?me|placeholder|example.*|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*|none|null|true|false|undefined|redacted.*|\[\w+\]|\*+)$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself)."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return out + [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]


def name_score(name: str) -> float:
    words = [w.lower() for part in re.split(r"[_.$-]+", name) for w in _WORDS.findall(part)]
    pairs = {a + b for a, b in zip(words, words[1:], strict=False)}
    return sum(NAME_WORDS.get(w, 0.0) for w in {*words, *pairs})


@dataclass(eq=False)
class Value:
    """What a name stands for: own literals and other values, and how all of it looks when joined; or elements that stand apart."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    parts: list[Value] = field(default_factory=list)
    elements: list[Value] = field(default_factory=list)
    length: int = 0
    marks: int = 0  # 1 digits, 2 lower, 4 upper case, 8 blanks
    chars: frozenset[str] = frozenset()  # no more than say that there are enough
    quoted: bool = False
    placeholder: bool = True  # of all parts
    given: bool = False

    @classmethod
    def literal(cls, text: str, start: int, end: int, quoted: bool) -> Value:
        value = text[start:end]
        marks = sum(bit for bit, f in ((1, str.isdigit), (2, str.islower), (4, str.isupper), (8, str.isspace)) if any(map(f, value)))
        chars = frozenset(list(dict.fromkeys(value))[:_MANY_CHARS])
        return cls([(start, end)] if end > start else [], length=end - start, marks=marks, chars=chars, quoted=quoted, placeholder=bool(_PLACEHOLDER.match(value)) or not value)

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls(parts=parts)
        for p in parts:
            # Doubled constants grow without end; beyond this all lengths are alike.
            out.length = min(out.length + p.length, 1 << 30)
            out.marks |= p.marks
            if len(out.chars) < _MANY_CHARS:
                out.chars |= p.chars
            out.quoted |= p.quoted
            out.placeholder &= p.placeholder
        return out

    @classmethod
    def apart(cls, elements: list[Value]) -> Value:
        out = cls.joined(elements) if len(elements) > 1 else cls(parts=list(elements))
        out.elements = elements
        return out

    def score(self) -> float:
        if self.length < NAMED_LEAST or self.placeholder:
            return -1.0
        score = 0.1 * (self.marks & 7).bit_count() + (0.1 if self.length >= 16 else 0.0) + (0.1 if len(self.chars) >= _MANY_CHARS else 0.0)
        if self.marks & 8:
            score -= 0.3
        # Prose behind a colon is not a literal: bare values need a digit.
        return score if self.quoted else score - 0.1 if self.marks & 1 else -1.0

    def give(self) -> list[tuple[int, int]]:
        """All literals that were not given before."""
        out, stack = [], [self]
        while stack:
            value = stack.pop()
            if not value.given:
                value.given = True
                out += value.spans
                stack += value.parts
        return out


_MANY_CHARS = 8


def unescaped(raw: str) -> tuple[str, list[int]]:
    """The text that a literal stands for, and the places in it that took two characters."""
    parts, places, at, length = [], [], 0, 0
    for m in _ESCAPE.finditer(raw):
        parts += [raw[at : m.start()], _BLANKS.get(m[1], m[1])]
        length += m.start() - at
        places.append(length)
        length, at = length + 1, m.end()
    return "".join([*parts, raw[at:]]), places


def _inner_spans(raw: str, start: int) -> list[tuple[int, int]]:
    """Spans of pairs inside a literal that starts at ``start``; each level of nesting needs other quotes or twice the escapes, so levels are few."""
    text, places = unescaped(raw)
    return [(start + a + bisect_left(places, a), start + b + bisect_left(places, b)) for a, b in named_spans(text)]


class _Lexer:
    """One pass over a text."""

    def __init__(self, text: str):
        self.text = text
        self.constants: dict[str, Value] = {}
        self.found: dict[tuple[int, int], None] = {}

    def term(self, m: re.Match) -> tuple[Value, bool]:
        """(value of a term, whether it is a quoted literal); pairs inside a literal are read here."""
        for k in _LITERALS:
            if m[k] is not None:
                start, end = m.span(k)
                if _SIGN.search(self.text, start, end):
                    self.found |= dict.fromkeys(_inner_spans(m[k], start))
                return Value.literal(self.text, start, end, True), True
        if m[_NAME] is not None and m[_NAME] in self.constants:
            return self.constants[m[_NAME]], False
        return Value.literal(self.text, *m.span(), False), False

    def elements(self, place: int, call: bool) -> tuple[list[Value], int]:
        """Quoted literals and names of a list, parentheses or a call, and where its last literal ends; it ends before anything else, such as an inner pair."""
        out, end = [], place
        while m := _TERM.match(self.text, place):
            if _TARGET.match(self.text, place):
                break
            value, literal = self.term(m)
            if literal or m[_NAME] is not None and m[_NAME] in self.constants:
                # What a call is asked for by name is no secret.
                if not (literal and call and _IDENTIFIER.fullmatch(m[m.lastindex])):
                    out.append(value)
            if literal:
                end = m.end()
            joint = _BETWEEN.match(self.text, m.end())
            if not joint:
                break
            place = joint.end()
        return out, end

    def value(self, place: int) -> tuple[Value | None, int]:
        """(value that begins at ``place``, where to look for the next target: behind its literals, but not behind bare words)."""
        if m := _NEXT_LINE.match(self.text, place):
            place = m.end()
        parts, seen = [], place
        while True:
            if not parts and (m := _OPEN.match(self.text, place)):
                found, end = self.elements(m.end(), call=False)
                return (Value.apart(found) if found else None), end
            m = _TERM.match(self.text, place)
            if not m:
                break
            if m[_NAME] is not None and self.text.startswith("(", m.end()) and (opened := _OPEN.match(self.text, m.end())):
                found, end = self.elements(opened.end(), call=True)
                return (Value.apart([*([Value.joined(parts)] if parts else []), *found]) if found or parts else None), max(seen, end if found else seen)
            value, literal = self.term(m)
            parts.append(value)
            if literal:
                seen = m.end()
            joint = _JOIN.match(self.text, m.end())
            if not joint or not joint[0].strip() and not (literal and self.text[joint.end() : joint.end() + 1] in "\"'"):
                break
            place = joint.end()
        return (Value.joined(parts) if parts else None), seen

    def block(self, at: int, place: int) -> Value | None:
        """The indented lines of a YAML block behind the header at ``place``; ``at`` is where its key stands."""
        m = _BLOCK.match(self.text, place)
        if not m:
            return None
        line = self.text[self.text.rfind("\n", 0, at) + 1 : at]
        indent = len(line) - len(line.lstrip(" "))
        body = re.compile(rf"(?:[ ]{{{indent + 1},}}[^\n]*+(?:\n|\Z)|[ \t]*+\n)++").match(self.text, m.end())
        if not body or not body[0].strip():
            return None
        start = body.start() + len(body[0]) - len(body[0].lstrip())
        return Value.literal(self.text, start, start + len(body[0].strip()), True)

    def assign(self, name: str, value: Value | None, constant: bool = True) -> None:
        if value is None:
            return
        if constant:
            self.constants[name] = value
        by_name = name_score(name)
        if by_name > 0:
            for v in value.elements or [value]:
                if by_name + v.score() >= THRESHOLD:
                    self.found |= dict.fromkeys(v.give())

    def run(self) -> list[tuple[int, int]]:
        at, text = 0, self.text
        while m := _TARGET.search(text, at):
            at = m.end()
            if m["tag"] is not None:
                self.assign(m["tag"], Value.literal(text, *m.span("content"), True), False)
                # Pairs in the content are looked for in place.
                at = m.start("content")
                continue
            name = m["declared"] or m["name"] or m["first"] or m["key"]
            place = m.end()
            if m["sign"] == ":" and (block := self.block(m.start(), place)):
                self.assign(name, block, False)
                continue
            if m["sign"] == ":" and (typed := _TYPE.match(text, place)):
                # Either a type stands before the sign, or another pair begins here: that one is met next.
                value, _ = self.value(typed.end())
                self.assign(name, value)
                continue
            value, at = self.value(place)
            self.assign(name, value)
            at = max(at, m.end())
        return sorted(self.found)


def named_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive target name."""
    return _Lexer(text).run()


def spans_of(text: str | None, base: bool = True, named: bool = True) -> list[tuple[str, int, int, int]]:
    """All spans by start, then kind as listed."""
    if not text:
        return []
    out = base_spans(text) if base else []
    covered = [(s, e) for _, s, e, _ in out]
    if named:
        out += [("named", a, b, a) for a, b in named_spans(text) if not any(s <= a and b <= e for s, e in covered)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _batch_spans(texts: pa.Array) -> list[list[tuple[str, int, int, int]]]:
    """Spans of each text; one pass of a linear-time matcher tells which texts can have any."""
    texts = texts.cast(pa.large_string()).fill_null("")
    base = pc.match_substring_regex(texts, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}""")
    # Every pair of the lexer has one of these; what names say is left to the lexer.
    named = pc.match_substring_regex(texts, r"""[:=]|</|\(\s*["']""")
    out: list[list[tuple[str, int, int, int]]] = [[] for _ in range(len(texts))]
    for i, (b, n) in enumerate(zip(base.to_pylist(), named.to_pylist(), strict=True)):
        if b or n:
            out[i] = spans_of(texts[i].as_py(), b, n)
    return out


_SPAN = "struct<kind:string,start:int,end:int,value_start:int>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and all spans of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches):
            rows = [[dict(zip(("kind", "start", "end", "value_start"), s, strict=True)) for s in spans] for spans in _batch_spans(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<{_SPAN}>")


def masked(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    """The text with every secret replaced by its kind; overlapping secrets become one mask."""
    out, at = [], 0
    merged: list[list] = []
    for kind, _, end, value in sorted(spans, key=lambda s: s[3]):
        if merged and value < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([value, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with secrets masked in ``text`` (and ``n_chars`` following it, where there is one)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, limit=4 << 20, size_of="text"):
            at = names.index("text")
            texts, columns = batch.column(at), list(batch.columns)
            found = _batch_spans(texts)
            hit = [i for i, spans in enumerate(found) if spans]
            if hit:
                changed = texts.to_pylist()
                for i in hit:
                    changed[i] = masked(changed[i], found[i])
                columns[at] = pa.array(changed, texts.type)
                if "n_chars" in names:
                    old = columns[names.index("n_chars")]
                    lengths = old.to_pylist()
                    for i in hit:
                        lengths[i] = len(changed[i])
                    columns[names.index("n_chars")] = pa.array(lengths, old.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans, their digest, and all spans as text."""
    found = find_secrets(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "named")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("named").alias("n_named"),
    )

"""Java declarations and calls as rows, by a tokenizer and a brace-matching scanner in Arrow batches.

A file that cannot be read gives one failure row and never fails the job. Types, methods and calls come from one pass, so store
the result before using it more than once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\')'
    r"|(?P<word>[\w$]+)|(?P<sign>->|::|\.\.\.|[^\s\w])",
    re.DOTALL,
)
_KINDS = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD"}
_CONTROL = frozenset("if for while switch catch synchronized try return throw new this super assert do else case yield instanceof".split())
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    start: int
    end: int


class JavaError(ValueError):
    pass


def tokenize(source: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m or (m.lastgroup == "sign" and m.group() in "\"'"):
            raise JavaError(f"line {line}: unreadable text")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m.group(), line, at, m.end()))
        line += m.group().count("\n")
        at = m.end()
    return out


class Scanner:
    """Walks the tokens of one file; ``types``, ``methods`` and ``calls`` are lists of rows."""

    def __init__(self, source: str) -> None:
        self.source, self.tokens = source, tokenize(source)
        self.pair = self._pairs()
        self.package, self.imports, self.types, self.methods, self.calls = "", [], [], [], []
        self._members(self._header(), len(self.tokens), None)

    def _pairs(self) -> dict[int, int]:
        pair, stack = {}, []
        for k, t in enumerate(self.tokens):
            if t.kind == "sign" and t.text in _OPEN:
                stack.append(k)
            elif t.kind == "sign" and t.text in _CLOSE:
                if not stack or _OPEN[self.tokens[stack[-1]].text] != t.text:
                    raise JavaError(f"line {t.line}: unexpected {t.text}")
                pair[stack[-1]] = k
                pair[k] = stack.pop()
        if stack:
            raise JavaError(f"line {self.tokens[stack[-1]].line}: unclosed {self.tokens[stack[-1]].text}")
        return pair

    def _is(self, k: int, text: str) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].text == text and self.tokens[k].kind != "text"

    def _word(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) and self.tokens[k].kind == "word" else ""

    def _until(self, k: int, sign: str) -> int:
        while k < len(self.tokens) and not self._is(k, sign):
            k += 1
        return k

    def _header(self) -> int:
        k = 0
        while self._word(k) in ("package", "import"):
            end = self._until(k, ";")
            words = [t.text for t in self.tokens[k + 1 : end] if t.text != "static"]
            if self._word(k) == "package":
                self.package = "".join(words)
            else:
                self.imports.append("".join(words))
            k = end + 1
        return k

    def _generic(self, k: int) -> int | None:
        """The index of the sign that closes type arguments opened at ``k``, or None if ``<`` compares."""
        depth = 0
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if not depth:
                    return k
            elif not (t.kind == "word" or t.text in (",", ".", "?", "&", "[", "]", "@")):
                return None
            k += 1
        return None

    def _parts(self, start: int, end: int) -> list[tuple[int, int]]:
        """Ranges between the commas that stand outside brackets and type arguments."""
        parts, first, k = [], start, start
        while k < end:
            if self._is(k, "<") and (self._word(k - 1)[:1].isupper() or self._is(k - 1, ".")) and (close := self._generic(k)) and close < end:
                k = close
            elif self.tokens[k].text in _OPEN and self.tokens[k].kind == "sign":
                k = self.pair[k]
            elif self._is(k, ","):
                parts.append((first, k))
                first = k + 1
            k += 1
        return [*parts, (first, end)] if first < end else parts

    def _members(self, k: int, end: int, owner: dict | None) -> None:
        """Declarations from ``k`` up to ``end``, of a file or of a type's body."""
        if owner and owner["kind"] == "ENUM":
            stop = k
            while stop < end and not self._is(stop, ";"):
                stop = self.pair[stop] + 1 if self.tokens[stop].text in _OPEN and self.tokens[stop].kind == "sign" else stop + 1
            self._calls(k, stop, owner["fqn"], None, declared=True)
            k = stop
        while k < end:
            first = k
            while k < end and (self._is(k, "@") and self._word(k + 1) != "interface" or self._word(k) in _MODIFIERS or self._word(k) == "non"):
                if self._is(k, "@"):
                    k += 2
                    while self._is(k, "."):
                        k += 2
                    k = self.pair[k] + 1 if self._is(k, "(") else k
                else:
                    k += 3 if self._word(k) == "non" else 1
            if k >= end:
                break
            if self._is(k, ";"):
                k += 1
            elif self._is(k, "{"):
                if owner is None:
                    raise JavaError(f"line {self.tokens[k].line}: block outside a type")
                self._calls(k + 1, self.pair[k], owner["fqn"], None)
                k = self.pair[k] + 1
            elif self._is(k, "@") or (self._word(k) in _KINDS and self._word(k + 1) and (self._word(k) != "record" or self._is(k + 2, "(") or self._is(k + 2, "<"))):
                k = self._type(k, end, owner)
            elif owner is None:
                raise JavaError(f"line {self.tokens[k].line}: unexpected {self.tokens[k].text}")
            else:
                k = self._member(first, k, end, owner)

    def _type(self, k: int, end: int, owner: dict | None) -> int:
        annotation = self._is(k, "@")
        kind = "ANNOTATION" if annotation else _KINDS[self._word(k)]
        k += 2 if annotation else 1
        name = self._word(k)
        if not name:
            raise JavaError(f"line {self.tokens[min(k, len(self.tokens) - 1)].line}: a type without a name")
        outer = f"{owner['fqn']}." if owner else f"{self.package}." if self.package else ""
        made = {"fqn": outer + name, "name": name, "kind": kind, "super": None, "interfaces": []}
        k += 1
        if self._is(k, "<"):
            k = (self._generic(k) or k) + 1
        if kind == "RECORD":
            k = self.pair[k] + 1
        clause = None
        found: dict[str, list[str]] = {"extends": [], "implements": [], "permits": []}
        while k < end and not self._is(k, "{"):
            if self._word(k) in found:
                clause = self._word(k)
                stop = k + 1
                while stop < end and not self._is(stop, "{") and self._word(stop) not in found:
                    stop += 1
                found[clause] = [re.split(r"[<@]", "".join(t.text for t in self.tokens[a:b]))[0] for a, b in self._parts(k + 1, stop)]
                k = stop
            else:
                k += 1
        if not self._is(k, "{"):
            raise JavaError(f"type {name} has no body")
        made["super"] = self._resolve(found["extends"][0]) if found["extends"] else None
        made["interfaces"] = [self._resolve(n) for n in found["implements"]] if kind in ("CLASS", "INTERFACE") else []
        self.types.append(made)
        self._members(k + 1, self.pair[k], made)
        return self.pair[k] + 1

    def _resolve(self, name: str) -> str:
        """By import, else in the same package; a dotted name stays."""
        if "." in name:
            return name
        known = next((i for i in self.imports if i.endswith(f".{name}")), None)
        return known or (f"{self.package}.{name}" if self.package else name)

    def _member(self, first: int, k: int, end: int, owner: dict) -> int:
        """A method, a constructor or a field; returns the index after it."""
        at = k
        while at < end and not (self.tokens[at].kind == "sign" and self.tokens[at].text in "(;={"):
            if self._is(at, "<") and (close := self._generic(at)):
                at = close
            at += 1
        if at >= end:
            raise JavaError(f"line {self.tokens[k].line}: unfinished member")
        if self._is(at, "{") and owner["kind"] == "RECORD":  # a compact constructor
            self._calls(at + 1, self.pair[at], owner["fqn"], None)
            return self.pair[at] + 1
        if not self._is(at, "("):
            stop = at
            while stop < end and not self._is(stop, ";"):
                stop = self.pair[stop] + 1 if self.tokens[stop].kind == "sign" and self.tokens[stop].text in _OPEN else stop + 1
            self._calls(at, stop, owner["fqn"], None)
            return stop + 1
        name, close = self._word(at - 1), self.pair[at]
        body = close + 1
        while body < end and not self._is(body, "{") and not self._is(body, ";"):
            body += 1
        if not name or body >= end:
            raise JavaError(f"line {self.tokens[at].line}: unreadable member")
        last = self.pair[body] if self._is(body, "{") else body
        constructor = at - 1 == k and name == owner["name"] or (self._is(k, "<") and self._generic(k) == at - 2 and name == owner["name"])
        if not constructor:
            kinds = [self._parameter(a, b) for a, b in self._parts(at + 1, close)]
            kinds = [t for t in kinds if t]
            self.methods.append((owner["fqn"], name, f"{name}({','.join(kinds)})", len(kinds), self.tokens[first].line, self.tokens[last].line))
        if self._is(body, "{"):
            self._calls(body + 1, last, owner["fqn"], None if constructor else name)
        return last + 1

    def _parameter(self, start: int, end: int) -> str:
        """The type of a parameter as it is written, without annotations, ``final`` and the name."""
        words, k = [], start
        while k < end:
            if self._is(k, "@"):
                k += 2
                k = self.pair[k] + 1 if self._is(k, "(") else k
                continue
            if self._word(k) != "final":
                words.append(self.tokens[k].text)
            k += 1
        return "" if words[-1:] == ["this"] else "".join(words[:-1])

    def _calls(self, k: int, end: int, owner: str, method: str | None, declared: bool = False) -> None:
        """Calls between two indices; ``declared`` skips enum constants, which look like calls."""
        depth = 0
        while k < end:
            t = self.tokens[k]
            if t.kind == "sign":
                depth += (t.text in _OPEN) - (t.text in _CLOSE)
            if t.kind == "word" and self._is(k + 1, "(") and t.text not in _CONTROL and not t.text[0].isdigit():
                close = self.pair[k + 1]
                created, back = False, k - 1
                while self._is(back, ".") and self._word(back - 1):
                    back -= 2
                created = self._word(back) == "new" or self._is(back, "@")
                if not created and (self._is(close + 1, "{") or self._word(close + 1) == "throws") and not (declared and depth == 0):
                    body = self._until(close, "{")  # a method of an anonymous or local class
                    self._calls(body + 1, self.pair[body], owner, t.text)
                    k = self.pair[body] + 1
                    continue
                if not created and not (declared and depth == 0):
                    self.calls.append((t.line, self._receiver(k), owner, method, t.text, len(self._parts(k + 2, close))))
            k += 1

    def _receiver(self, k: int) -> str:
        """What stands before the dot of a call, as it is written; empty if there is none."""
        if not self._is(k - 1, "."):
            back = k - 1
            if self._is(back, ">"):  # explicit type arguments
                while back >= 0 and not self._is(back, "<"):
                    back -= 1
            if back == k - 1 or not self._is(back - 1, "."):
                return ""
            k = back
        last = k - 2
        first = last
        while first >= 0:
            if self.tokens[first].kind == "sign" and self.tokens[first].text in _CLOSE:
                first = self.pair[first]
                if self._word(first - 1) and self._word(first - 1) not in ("return", "throw", "else", "case"):
                    first -= 1
            if self._is(first - 1, "."):
                first -= 2
            else:
                if self._word(first - 1) == "new":
                    first -= 1
                break
        return self.source[self.tokens[first].start : self.tokens[last].end]


ROWS = "row string, fqn string, simple_name string, package_name string, kind string, super_class string, interfaces array<string>, imports array<string>, name string, signature string, arity int, start_line int, end_line int, receiver string, enclosing_method string, ord int, reason string"
_NAMES = [c.split(" ")[0] for c in ROWS.split(", ")]


def scan_source(source: str | None) -> list[dict]:
    """Rows of one file: 'type', 'method', 'call', or one 'failure'."""
    try:
        s = Scanner(source or "")
    except (JavaError, IndexError, KeyError, RecursionError) as broken:
        return [{"row": "failure", "ord": 0, "reason": str(broken) or type(broken).__name__}]
    out = [{"row": "type", "fqn": t["fqn"], "simple_name": t["name"], "package_name": s.package, "kind": t["kind"], "super_class": t["super"], "interfaces": t["interfaces"], "imports": s.imports, "ord": k} for k, t in enumerate(s.types)]
    out += [{"row": "method", "fqn": f, "name": n, "signature": g, "arity": a, "start_line": x, "end_line": y, "ord": k} for k, (f, n, g, a, x, y) in enumerate(s.methods)]
    return out + [{"row": "call", "start_line": x, "receiver": r, "fqn": f, "enclosing_method": m, "name": n, "arity": a, "ord": k} for k, (x, r, f, m, n, a) in enumerate(s.calls)]


def parse_java(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, ROWS) of every file; ``keys`` name string or integer columns that identify it.

    Scanning costs far more than moving a file, so files are dealt out over a fixed number of partitions, which is not coalesced.
    """
    kinds = dict(files.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + ROWS
    types = {"ord": pa.int32(), "arity": pa.int32(), "start_line": pa.int32(), "end_line": pa.int32(), "interfaces": pa.list_(pa.string()), "imports": pa.list_(pa.string())}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, rows = [], []
            for k, text in enumerate(batch[content]):
                found = scan_source(text.as_py())
                where += [k] * len(found)
                rows += found
            at = pa.array(where, pa.int32())
            own = [batch[k].take(at) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in _NAMES)], names=[*keys, *_NAMES])

    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select(*keys, F.col(content)).repartition(spread, *keys).mapInArrow(scan, schema)

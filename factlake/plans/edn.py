"""Reader for EDN text, the notation of queries, rules and transactions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone


class Keyword(str):
    """A keyword, kept with its colon: ``Keyword(":user/name")``. Equal to the same string."""

    __slots__ = ()


class Symbol(str):
    """A symbol such as ``?x``, ``count`` or ``$``."""

    __slots__ = ()


class Form(list):
    """A parenthesised list; vectors are plain lists."""


@dataclass(frozen=True)
class Tagged:
    tag: str
    value: object


_TOKEN = re.compile(
    r"""[\s,]*(?:;[^\n]*[\s,]*)*(?P<tok>"(?:\\.|[^"\\])*"|\#\{|\#_|\#[A-Za-z][\w./-]*|[()\[\]{}]|\\(?:newline|space|tab|return|.)|[^\s,()\[\]{}";]+)""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
_END = {"(": ")", "[": "]", "{": "}", "#{": "}"}


class EdnError(ValueError):
    pass


def _hashable(x: object) -> object:
    return tuple(_hashable(y) for y in x) if isinstance(x, list) else x


def _atom(tok: str) -> object:
    if tok[0] == '"':
        return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), tok[1:-1])
    if tok[0] == ":":
        return Keyword(tok)
    if tok in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[tok]
    if tok[0] == "\\":
        return {"newline": "\n", "space": " ", "tab": "\t", "return": "\r"}.get(tok[1:], tok[1:])
    if re.fullmatch(r"[+-]?\d+[NM]?", tok):
        return int(tok.rstrip("NM"))
    if re.fullmatch(r"[+-]?\d+/\d+", tok):
        a, b = tok.split("/")
        return int(a) / int(b)
    if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?", tok):
        return float(tok.rstrip("M"))
    return Symbol(tok)


def instant(text: str) -> datetime:
    """An ``#inst`` literal, in UTC unless it names an offset."""
    full = text + "-01-01"[min(len(text) - 4, 6) :] if len(text) < 10 else text
    d = datetime.fromisoformat(full.replace("Z", "+00:00"))
    return d if d.tzinfo else d.replace(tzinfo=timezone.utc)


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def token(self) -> str | None:
        m = _TOKEN.match(self.text, self.at)
        if not m:
            if self.text[self.at :].strip(" \t\r\n,") and not re.fullmatch(r"[\s,]*(;[^\n]*[\s,]*)*", self.text[self.at :]):
                raise EdnError(f"unreadable at {self.at}: {self.text[self.at : self.at + 20]!r}")
            return None
        self.at = m.end()
        return m["tok"]

    def many(self, end: str) -> list:
        out = []
        while True:
            tok = self.token()
            if tok is None:
                raise EdnError(f"no closing {end}")
            if tok == end:
                return out
            if tok == "#_":
                self.value(self.token())
            else:
                out.append(self.value(tok))

    def value(self, tok: str | None) -> object:
        if tok is None:
            raise EdnError("nothing to read")
        if tok in _END:
            found = self.many(_END[tok])
            if tok == "(":
                return Form(found)
            if tok == "[":
                return found
            if tok == "#{":
                return {_hashable(x) for x in found}
            if len(found) % 2:
                raise EdnError("a map needs pairs")
            return {_hashable(k): v for k, v in zip(found[::2], found[1::2], strict=True)}
        if tok in ")]}":
            raise EdnError(f"unexpected {tok}")
        if tok == "#_":
            self.value(self.token())
            return self.value(self.token())
        if tok[0] == "#":
            value = self.value(self.token())
            return instant(value) if tok == "#inst" else value if tok == "#uuid" else Tagged(tok[1:], value)
        return _atom(tok)


def read(text: str) -> object:
    """The one value of ``text``."""
    r = _Reader(text)
    out = r.value(r.token())
    if r.token() is not None:
        raise EdnError("more than one value")
    return out

"""Reading one JSON value out of text that is not quite JSON."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any

_DECODER = json.JSONDecoder()
_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")
_NAMED = {"true": True, "false": False, "null": None}


class _Broken:
    """One object, also after pickling."""

    def __reduce__(self) -> str:
        return "BROKEN"


BROKEN = _Broken()


def deep_value(text: str, i: int) -> tuple[Any, int]:
    """The JSON value that begins at ``i`` and where it ends, however deep it is: open objects and lists are on a list, not on the call stack."""
    blank = lambda k: _BLANK.match(text, k).end()
    open_: list[tuple[Any, str | None]] = []  # objects and lists around, each with its name in the one around it
    name: str | None = None
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            value: Any = {} if c == "{" else []
            i = blank(i + 1)
            closed = text[i : i + 1] == ("}" if c == "{" else "]")
            if not closed:
                open_.append((value, name))
                name = None
        elif c == '"':
            value, i = scanstring(text, i + 1)
            closed = None
        elif m := _SCALAR.match(text, i):
            word, i, closed = m[0], m.end(), None
            value = _NAMED[word] if word in _NAMED else float(word) if m[1] or m[2] or not word.lstrip("-").isdigit() else int(word)
        else:
            raise ValueError("no value")
        if closed:
            i += 1
        while closed is not False:
            if not open_:
                return value, i
            around = open_[-1][0]
            if isinstance(around, dict):
                around[name] = value
            else:
                around.append(value)
            i = blank(i)
            c = text[i : i + 1]
            if c == ",":
                i = blank(i + 1)
                break
            if c != ("}" if isinstance(around, dict) else "]"):
                raise ValueError("neither comma nor end")
            i += 1
            value, name = open_.pop()
        if isinstance(open_[-1][0], dict):
            if text[i : i + 1] != '"':
                raise ValueError("no name")
            name, i = scanstring(text, i + 1)
            i = blank(i)
            if text[i : i + 1] != ":":
                raise ValueError("no colon")
            i = blank(i + 1)


def _value(text: str, i: int = 0) -> tuple[Any, int]:
    try:
        return _DECODER.raw_decode(text, i)
    except RecursionError:
        return deep_value(text, i)


def loose_json(text: str | None, nested: int = 3) -> Any:
    """The first JSON value in ``text``, or BROKEN.

    What comes before the first brace, bracket or quoted member and what follows the value is
    ignored. Members without the braces around them (``"a": {...}, "b": ...``) are read as their
    object. A string that holds JSON is read on, ``nested`` times at most. Any depth is read. Text that breaks off
    inside its value, text without a value, blank text and null give BROKEN.
    """
    if text is None:
        return BROKEN
    starts = [i for i in (text.find(c) for c in '{["') if i >= 0]
    if not starts:
        return BROKEN
    i = min(starts)
    try:
        value, end = _value(text, i)
        if text[i] != '"':
            return value
        rest = text[end:].lstrip()
        if not rest.startswith(":"):
            return loose_json(value, nested - 1) if nested else BROKEN
        members: dict[str, Any] = {}
        while True:
            body = rest[1:].lstrip()
            members[value], end = _value(body)
            rest = body[end:].lstrip()
            if not rest.startswith(",") or not rest[1:].lstrip().startswith('"'):
                return members
            body = rest[1:].lstrip()
            value, end = _value(body)
            rest = body[end:].lstrip()
            if not rest.startswith(":"):
                return members if rest else BROKEN
    except ValueError:
        return BROKEN

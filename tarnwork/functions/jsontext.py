"""JSON texts of any depth, read and written on the Python side.

The reader of the standard library gives up some thousand levels down. Texts
that nest deeper are read and written here with a stack of their own.
"""

from __future__ import annotations

import json
import re
import sys
from contextlib import contextmanager
from functools import cache
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _scalar(text: str, i: int, number) -> tuple[object, int]:
    if text.startswith('"', i):
        return scanstring(text, i + 1, True)
    for word, v in _WORDS.items():
        if text.startswith(word, i):
            return v, i + len(word)
    m = _NUMBER.match(text, i)
    if not m:
        raise ValueError(f"no value at {i}")
    whole, part, power = m.groups()
    return (number(m[0]) if part or power else int(whole)), m.end()


def deep_read(text: str, parse_float=float):
    """Like ``json.loads``, for any depth; ValueError for what is no JSON."""
    skip = lambda i: _SPACE.match(text, i).end()
    holders: list = []  # (container, key of the value that is being read)

    def key_at(i: int) -> tuple[str, int]:
        if not text.startswith('"', i):
            raise ValueError(f"no name at {i}")
        key, i = scanstring(text, i + 1, True)
        i = skip(i)
        if not text.startswith(":", i):
            raise ValueError(f"no colon at {i}")
        return key, skip(i + 1)

    i = skip(0)
    while True:
        mark = text[i : i + 1]
        if mark in ("{", "["):
            value = {} if mark == "{" else []
            i = skip(i + 1)
            if not text.startswith("}" if mark == "{" else "]", i):
                key, i = key_at(i) if mark == "{" else (None, i)
                holders.append((value, key))
                continue
            i += 1
        else:
            value, i = _scalar(text, i, parse_float)
        while True:  # the value is complete: hand it up
            i = skip(i)
            if not holders:
                if i != len(text):
                    raise ValueError(f"more text at {i}")
                return value
            holder, key = holders[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            if text.startswith(",", i):
                i = skip(i + 1)
                if isinstance(holder, dict):
                    key, i = key_at(i)
                    holders[-1] = (holder, key)
                break
            if not text.startswith("}" if isinstance(holder, dict) else "]", i):
                raise ValueError(f"not closed at {i}")
            holders.pop()
            value, i = holder, i + 1


def parse(text: str | None, parse_float=float):
    """The JSON value in ``text``, however deep; None where there is none."""
    if text is None:
        return None
    try:
        return json.loads(text) if parse_float is float else json.loads(text, parse_float=parse_float)
    except ValueError:
        return None
    except RecursionError:
        try:
            return deep_read(text, parse_float)
        except ValueError:
            return None


@cache
def _encoder(sort_keys: bool, ensure_ascii: bool, spaced: bool):
    return json.JSONEncoder(sort_keys=sort_keys, ensure_ascii=ensure_ascii, separators=(", ", ": ") if spaced else (",", ":")).encode


def dump(v, *, sort_keys: bool = False, ensure_ascii: bool = False, spaced: bool = True, scalar=None) -> str:
    """JSON of a value, however deep; ``scalar`` may write scalars its own way (or give None)."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    if scalar is None:
        try:
            return _encoder(sort_keys, ensure_ascii, spaced)(v)
        except RecursionError:
            pass
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, v)]
    while todo:
        done, x = todo.pop()
        if done:
            out.append(x)
        elif isinstance(x, dict):
            names = sorted(x) if sort_keys else list(x)
            todo.append((True, "}"))
            for n, k in reversed(list(enumerate(names))):
                todo += [(False, x[k]), (True, (comma if n else "") + json.dumps(k, ensure_ascii=ensure_ascii) + colon)]
            out.append("{")
        elif isinstance(x, list):
            todo.append((True, "]"))
            for n, y in reversed(list(enumerate(x))):
                todo += [(False, y), (True, comma)] if n else [(False, y)]
            out.append("[")
        else:
            own = scalar(x) if scalar else None
            out.append(json.dumps(x, ensure_ascii=ensure_ascii) if own is None else own)
    return "".join(out)


@contextmanager
def depth_of(text: str):
    """Room for calls as deep as ``text`` may nest; they take no machine stack."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 4 * (text.count("[") + text.count("{") + text.count("\\u")) + 1_000))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)

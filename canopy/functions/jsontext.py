"""Strict JSON parsing and tree flattening, run inside Arrow batches.

Arbitrary depth has no built-in expression, so these few functions are
the Python part of the JSON operators; everything around them stays in the JVM.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator


class _Invalid:
    def __reduce__(self):  # one object in every Python worker too
        return "INVALID"


#: What :func:`parse` gives for text that is not JSON (``None`` is JSON ``null``).
INVALID = _Invalid()


def _no_constant(name: str):
    raise ValueError(name)


_STRICT = json.JSONDecoder(parse_constant=_no_constant)
_BIG_INTS = json.JSONDecoder(parse_constant=_no_constant, parse_int=float)
_ENCODE = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode
_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}
_CLOSE = {"{": "}", "[": "]"}


def _scalar(text: str, at: int):
    """(value, end) of the scalar at a place of a text."""
    c = text[at : at + 1]
    if c == '"':
        return json.decoder.scanstring(text, at + 1, True)
    if c in _WORDS and text.startswith(_WORDS[c][0], at):
        return _WORDS[c][1], at + len(_WORDS[c][0])
    m = _NUMBER.match(text, at)
    if not m:
        raise ValueError(at)
    whole = m[1] is None and m[2] is None and len(m[0]) < 4000
    return (int if whole else float)(m[0]), m.end()


def _deep(text: str):
    """The same grammar as the decoder's, with a stack of its own: any depth is read."""
    skip = lambda i: _BLANK.match(text, i).end()
    boxes: list[tuple[str, dict | list]] = []
    names: list[str | None] = []

    def name(i):
        if text[i : i + 1] != '"':
            raise ValueError(i)
        key, i = json.decoder.scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(i)
        return key, skip(i + 1)

    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c in _CLOSE:
            box: dict | list = {} if c == "{" else []
            i = skip(i + 1)
            if text[i : i + 1] != _CLOSE[c]:
                boxes.append((c, box))
                key, i = name(i) if c == "{" else (None, i)
                names.append(key)
                continue
            v, i = box, i + 1
        else:
            v, i = _scalar(text, i)
        while True:  # a value is complete
            i = skip(i)
            if not boxes:
                if i != len(text):
                    raise ValueError(i)
                return v
            c, box = boxes[-1]
            if c == "{":
                box[names[-1]] = v
            else:
                box.append(v)
            after = text[i : i + 1]
            if after == ",":
                i = skip(i + 1)
                if c == "{":
                    names[-1], i = name(i)
                break
            if after != _CLOSE[c]:
                raise ValueError(i)
            boxes.pop(), names.pop()
            v, i = box, i + 1


def parse(text: str | None):
    """The value of RFC 8259 text; :data:`INVALID` for null, torn or otherwise broken text.

    NaN and Infinity are not JSON; of a repeated key the last one counts. Text of any
    depth is read: what the decoder's recursion can't follow goes through :func:`_deep`.
    """
    if text is None:
        return INVALID
    try:
        return _STRICT.decode(text)
    except json.JSONDecodeError:
        return INVALID
    except RecursionError:
        read = _deep
    except ValueError as e:
        if "digits" not in str(e):
            return INVALID
        read = _BIG_INTS.decode
    try:
        return read(text)
    except RecursionError:
        pass
    except ValueError:
        return INVALID
    try:
        return _deep(text)
    except ValueError:
        return INVALID


def _pieces(value) -> Iterator[str]:
    """Compact JSON text in pieces, with a stack of its own; infinity as a number that reads as such."""
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        ready, v = todo.pop()
        if ready:
            yield v
        elif isinstance(v, (dict, list)):
            pairs = [(_ENCODE(k) + ":", x) for k, x in v.items()] if isinstance(v, dict) else [("", x) for x in v]
            todo.append((True, "}" if isinstance(v, dict) else "]"))
            for i, (head, x) in reversed(list(enumerate(pairs))):
                todo += [(False, x), (True, ("," if i else "") + head)]
            yield "{" if isinstance(v, dict) else "["
        else:
            yield ("1e999" if v > 0 else "-1e999") if isinstance(v, float) and math.isinf(v) else _ENCODE(v)


def dump(value) -> str:
    """Compact JSON text; characters stay as they are, lone surrogates become ``?``."""
    try:
        return safe(_ENCODE(value))
    except (RecursionError, ValueError):
        return safe("".join(_pieces(value)))


def safe(text: str) -> str:
    """Text that UTF-8 can hold (JSON escapes can make lone surrogates)."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def fold(value, leaf: Callable, node: Callable):
    """A value folded from its scalars up, with a stack of its own.

    ``leaf(scalar)`` gives a scalar's result, ``node(container, results)`` that of a
    container from those of its children, in their order.
    """
    done: list = []
    todo = [(value, False)]
    while todo:
        v, ready = todo.pop()
        if not isinstance(v, (dict, list)):
            done.append(leaf(v))
        elif ready:
            first = len(done) - len(v)
            parts = done[first:]
            del done[first:]
            done.append(node(v, parts))
        else:
            todo.append((v, True))
            todo += [(x, False) for x in reversed(v.values() if isinstance(v, dict) else v)]
    return done[0]


def children(value) -> Iterator[tuple[str, object]]:
    """Children of a container; array elements are named by their index."""
    return iter(value.items()) if isinstance(value, dict) else ((str(i), v) for i, v in enumerate(value))


def has_leaf(value) -> bool:
    """Whether anything is left once nulls, ``{}`` and ``[]`` vanish."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, (dict, list)):
            todo.extend(v.values() if isinstance(v, dict) else v)
        elif v is not None:
            return True
    return False


def leaves(base: str, value) -> Iterator[tuple[str, object]]:
    """(path, scalar) of each leaf of ``value`` stored at ``base`` (no outer slashes)."""
    todo = [(base, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, (dict, list)):
            for k, x in children(v):
                todo.append((f"{at}/{k}".strip("/"), x))
        elif v is not None:
            yield at, v

"""JSON texts of any depth: reading, and one text for equal values."""

from __future__ import annotations

import json
import re

_REAL = re.compile(r"\d[.eE]")


def read_json(text: str) -> object:
    """Like json.loads, at any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return deep_json(text)


def deep_json(text: str) -> object:
    """A parser with its own stack for texts nested deeper than the built-in one goes."""
    scan, space = json.JSONDecoder().raw_decode, json.decoder.WHITESPACE
    i, stack, done = space.match(text, 0).end(), [], False
    result: object = None

    def put(v: object) -> None:
        nonlocal result, done
        if not stack:
            result, done = v, True
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(v)
        else:
            stack[-1][0][stack[-1][1]] = v

    def member(i: int) -> int:
        key, i = scan(text, i)
        i = space.match(text, i).end()
        if not isinstance(key, str) or text[i:i + 1] != ":":
            raise ValueError("no member")
        stack[-1][1] = key
        return space.match(text, i + 1).end()

    while not done:
        c = text[i:i + 1]
        if c == "[" or c == "{":
            stack.append([[] if c == "[" else {}, None])
            i = space.match(text, i + 1).end()
            if text[i:i + 1] != ("]" if c == "[" else "}"):
                if c == "{":
                    i = member(i)
                continue
        else:
            v, i = scan(text, i)
            put(v)
        while stack:  # close, or go to the next element
            i = space.match(text, i).end()
            c = text[i:i + 1]
            if c == ("]" if isinstance(stack[-1][0], list) else "}"):
                v = stack.pop()[0]
                put(v)
                i += 1
            elif c == ",":
                i = space.match(text, i + 1).end()
                if isinstance(stack[-1][0], dict):
                    i = member(i)
                break
            else:
                raise ValueError("no delimiter")
    if space.match(text, i).end() != len(text):
        raise ValueError("text after the value")
    return result


def _whole(text: str) -> int | float:
    x = float(text)
    return int(x) if x.is_integer() else x


def scalar(v: object) -> str:
    """The text of a string, number, boolean or null; whole numbers are alike however they are written."""
    return json.dumps(int(v) if isinstance(v, float) and v.is_integer() else v, ensure_ascii=False)


def canonical(v: object) -> str:
    """One text for equal JSON values: members in order, whole numbers alike however they are written."""
    if not isinstance(v, (list, dict)):
        return scalar(v)
    try:
        text = json.dumps(v, sort_keys=True, ensure_ascii=False)
        if _REAL.search(text):
            text = json.dumps(json.loads(text, parse_float=_whole), sort_keys=True, ensure_ascii=False)
        return text
    except RecursionError:
        return _deep_canonical(v)


def _deep_canonical(v: object) -> str:
    out: list[str] = []
    work: list[object] = [(v,)]  # texts, and values to be written in tuples
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        (x,) = x
        if isinstance(x, list):
            parts = [p for y in x for p in (", ", (y,))][1:]
            work += reversed(["[", *parts, "]"])
        elif isinstance(x, dict):
            parts = [p for k in sorted(x) for p in (", ", f"{json.dumps(k, ensure_ascii=False)}: ", (x[k],))][1:]
            work += reversed(["{", *parts, "}"])
        else:
            out.append(scalar(x))
    return "".join(out)

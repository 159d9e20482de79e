"""What a response that was cut off, or is broken further on, still holds: whole objects, and where the first error stands.

Objects whose members are all strings, numbers and literals are passed over by one pattern. All others, and what isn't
whole, go token by token through a stack of brackets. The parse of what is whole stays Spark's.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALAR = r"(?:-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)"
_GAP = r"[ \t\n\r]*+"
_TEXT = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_MEMBER = rf"{_TEXT}{_GAP}:{_GAP}(?:{_TEXT}|{_SCALAR}){_GAP}"
#: An object without brackets inside; a token: bracket, comma or colon, a string with its end, or a run of other characters.
_FLAT = re.compile(rf"\{{{_GAP}(?:{_MEMBER}(?:,{_GAP}{_MEMBER})*+)?+\}}")
_TOKEN = re.compile(rf'{_GAP}(?:([{{}}\[\],:])|("(?:[^"\\]|\\.)*+(")?)|([^ \t\n\r{{}}\[\],:"]++))', re.DOTALL)
_GOOD_TEXT, _GOOD_SCALAR = re.compile(_TEXT), re.compile(_SCALAR)
#: An escape, or what can't stand in a string.
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|([\\\x00-\x1f])')


def _bad_place(text: str, start: int, end: int) -> int:
    """Where the first thing stands that can't be in the string from ``start`` to ``end``."""
    return next(m.start() for m in _ESCAPE.finditer(text, start + 1, end) if m.group(1) is not None)


def whole_elements(text: str) -> tuple[list[tuple[int, int]], int | None]:
    """Spans of the objects and nulls that the array in ``text`` holds whole before the first error, and where the error
    stands; None if the text is one array of objects and nulls.

    The error is the first token that can't stand where it does, or the place where the text breaks off.
    """
    spans, stack, want, begun, at = [], [], "[", 0, 0  # want: the kinds of tokens that may follow
    values = lambda: "{v" if len(stack) == 1 else "{[sv"
    after = lambda: (",}" if stack[-1] == "{" else ",]") if stack else ""
    while found := _TOKEN.match(text, at):
        kind, at = found.group(1), found.end()
        if kind == "{" and len(stack) == 1 and "{" in want and (flat := _FLAT.match(text, at - 1)):
            at = flat.end()
            spans.append(flat.span())
            want = after()
            continue
        start = at - 1 if kind else found.start(2) if found.group(2) else found.start(4)
        if not kind:
            if found.group(2):
                if not found.group(3):
                    return spans, start  # a string that doesn't end
                kind = "s"
            else:
                kind = "v" if _GOOD_SCALAR.fullmatch(text, start, at) else "x"
        if kind not in want or (len(stack) == 1 and kind == "v" and text[start:at] != "null"):
            return spans, start
        if kind == "s" and not _GOOD_TEXT.fullmatch(text, start, at):
            return spans, _bad_place(text, start, at - 1)
        if kind in "{[":
            begun = start if len(stack) == 1 else begun
            stack.append(kind)
            want = "s}" if kind == "{" else values() + "]"
            continue
        if kind == ",":
            want = "s" if stack[-1] == "{" else values()
        elif kind == ":":
            want = values()
        elif kind == "s" and "v" not in want:  # a member's name
            want = ":"
        else:
            if kind in "}]":
                stack.pop()
            if len(stack) == 1:
                spans.append((start if kind == "v" else begun, at))
            want = after()
    return spans, len(text) if stack or want == "[" else None


_LEFT = T.StructType([T.StructField("elements", T.ArrayType(T.StringType())), T.StructField("at", T.IntegerType()), T.StructField("rest", T.StringType())])


@F.pandas_udf(_LEFT)
def salvage(responses: pd.Series) -> pd.DataFrame:
    """The whole elements of each response, the place of its first error (null: none), and what follows the elements."""
    rows = []
    for text in responses:
        spans, at = whole_elements(text) if text is not None else ([], None)
        rows.append(([text[a:b] for a, b in spans], at, None if text is None or at is None else text[spans[-1][1] if spans else 0 :]))
    return pd.DataFrame(rows, columns=["elements", "at", "rest"]).astype({"at": "Int32"})

"""Nearly-JSON as models answer it, mended and brought to the record's shapes.

A text is cut into tokens once for each way of reading it; a stack of open brackets says
where a token stands. Ways are tried from the one that changes least, so a text that one of
them can read is never changed by a later one."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"^\s*```(?:json)?\s*|\s*```\s*$")

#: A string ends at its first quote without a backslash, or at the end of the text.
_PLAIN = r'"(?P<body>(?:[^"\\]|\\.)*+)(?P<end>"|\\?\Z)'
#: A string ends at a quote that a sign of structure, a line end or the end follows; after
#: an escaped backslash a colon is no such sign, since no name ends in one.
_QUOTED = r'"(?P<body>(?:\\\\"(?=[ \t]*:)|[^"\\]|\\.|"(?![ \t]*(?:[:,}\]\r\n]|\Z)))*+)(?P<end>"|\\?\Z)'
_TOKENS = {quotes: re.compile(string + r"|(?P<sign>[{}\[\],])|(?P<space>\s+)|(?P<other>[^\s{}\[\],\"]+)", re.DOTALL) for quotes, string in ((False, _PLAIN), (True, _QUOTED))}
_INNER = re.compile(r'(\\.)|"', re.DOTALL)
CLOSER = {"{": "}", "[": "]"}


def mended(text: str, quotes: bool = False, brackets: bool = False, commas: bool = False, inner: bool = False, lines: bool = False) -> str:
    """``text`` without commas before a closing bracket and with open strings and brackets
    closed. quotes: quotes inside strings are escaped; brackets: a ] that closes no list is
    left out; commas: a comma is put between } or ] and { or [; inner: brackets that a
    closing bracket skips are closed before it; lines: a comma is put between a value and a
    name on the next line."""
    out: list[str] = []
    stack: list[str] = []
    last, broken = "", False  # the last token that is no space, and a line end since then

    def before_closing() -> None:
        at = len(out)
        while at and (out[at - 1].isspace() or out[at - 1] == ","):
            at -= 1
        out[at:] = [t for t in out[at:] if t != ","]

    for m in _TOKENS[quotes].finditer(text):
        token = m[0]
        if m["space"] is not None:
            broken |= "\n" in token
            out.append(token)
            continue
        if m["body"] is not None:
            if lines and broken and last and last[-1] not in "{[,:":
                out.append(",")
            body = _INNER.sub(lambda i: i[1] or '\\"', m["body"]) if quotes else m["body"]
            token = f'"{body}"'
        elif token in CLOSER:
            if commas and last in ("}", "]"):
                out.append(",")
            stack.append(CLOSER[token])
        elif token in ("}", "]"):
            if brackets and token == "]" and stack[-1:] != ["]"]:
                continue
            if inner and token not in stack:
                continue
            before_closing()
            while inner and stack[-1] != token:
                out.append(stack.pop())
            if stack:
                stack.pop()
        out.append(token)
        last, broken = token, False
    if stack:
        before_closing()
    return "".join(out) + "".join(reversed(stack))


#: The ways of reading in the order they are tried, after the text as it is.
WAYS = (
    {}, {"quotes": True}, {"quotes": True, "brackets": True}, {"quotes": True, "brackets": True, "commas": True},
    {"inner": True}, {"inner": True, "lines": True},
)


def _readings(text: str) -> Iterator[str]:
    yield text
    for way in WAYS:
        yield mended(text, **way)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def read(text: str) -> tuple[object, int]:
    """(value, number of the way that read it, 0 for the text as it is); ValueError if none
    does. Fences around the text go first."""
    for n, reading in enumerate(_readings(FENCE.sub("", text))):
        try:
            return json.loads(reading, parse_constant=_no_constant), n
        except (ValueError, RecursionError):
            continue
    raise ValueError("no JSON")


# Fields that are one text although models list their lines, and fields that
# are one text although models wrap them.
JOINED = {"FullText", "Substance", "ReactivityDescription", "StabilityDescription", "ConditionsToAvoid", "MaterialsToAvoid"}
WRAPPED = {"Colour", "Odour", "PhysicalState"}
INFO = "AdditionalInfo"


def wrapped_text(value: object) -> str | None:
    """The text of a string, of a list's strings by lines, or of what an object has as
    FullText, itself or in its additional information; null if there is none."""
    if isinstance(value, str):
        return value if value.strip() else None
    if isinstance(value, list):
        return "\n".join(x for x in value if isinstance(x, str) and x.strip()) or None
    if isinstance(value, dict):
        info = value.get(INFO)
        return wrapped_text(value.get("FullText")) or (wrapped_text(info.get("FullText")) if isinstance(info, dict) else None)
    return None


def shaped(value: object, info: bool = False) -> object:
    """A record's value with the fields of JOINED and WRAPPED as texts. Directly inside
    additional information (``info``) FullText stays a list."""
    if isinstance(value, list):
        return [shaped(v, info) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for k, v in value.items():
        if not info and k in JOINED and isinstance(v, list) and v and all(isinstance(x, str) for x in v):
            v = "\n".join(x for x in v if x)
        elif not info and k in WRAPPED and isinstance(v, dict):
            v = wrapped_text(v) or v
        out[k] = shaped(v, k == INFO)
    return out


def _answer(text: str | None) -> tuple[str | None, int | None]:
    try:
        value, way = read(text or "")
    except ValueError:
        return None, None
    return (json.dumps(shaped(value), ensure_ascii=False), way) if isinstance(value, dict) else (None, None)


def answered_record(text: Column) -> Column:
    """struct(json, way): the record that a model's answer holds, mended and with texts
    where the schema has texts, and the way that read it (0: as it is). Both are null for
    null, for what no way reads and for anything but an object."""

    @F.pandas_udf("json string, way int")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [_answer(t) for t in texts]
        return pd.DataFrame({"json": [j for j, _ in found], "way": pd.array([w for _, w in found], dtype="Int32")})

    return of(text)

"""JSON trees: leaves, text, pruning, flattening and repair.

``json_leaves`` is one native expression that keeps key order; the others are small per-row
helpers."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import repair


def leaves(value: object, path: str = "") -> Iterator[tuple[str, str, object]]:
    """(path, key, value) of every leaf, in document order."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, re.sub(r"(\[\d+\])+$", "", path).rpartition(".")[2], value


#: Levels below the root that ``json_leaves`` walks down.
DEPTH = 12
LEAF = "struct<path:string,key:string,value:string,type:string>"
_ENTRY = "array<struct<path:string,key:string,text:string,type:string>>"


def _children(text: Column, path: Column, key: Column, kind: Column) -> Column:
    """The entries of an object or array given as JSON text, in document order; each has
    its own text and what it is. The texts come from one reading, the types from another."""
    of = lambda schema: F.from_json(text, schema)
    type_of = lambda v: F.when(v.isNull(), "VOID").otherwise(F.schema_of_variant(v))
    child = lambda p, k, t, v: F.struct(p.alias("path"), k.alias("key"), t.alias("text"), type_of(v).alias("type"))
    names = F.map_keys(of("map<string,string>"))
    under = lambda k: F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k))
    objects = F.transform(F.arrays_zip(names.alias("k"), F.map_values(of("map<string,string>")).alias("t"), F.map_values(of("map<string,variant>")).alias("v")), lambda e: child(under(e["k"]), e["k"], e["t"], e["v"]))
    numbered = F.arrays_zip(of("array<string>").alias("t"), of("array<variant>").alias("v"))
    items = F.transform(numbered, lambda e, n: child(F.concat(path, F.lit("["), n.cast("string"), F.lit("]")), key, e["t"], e["v"]))
    return F.when(F.startswith(kind, F.lit("OBJECT")), objects).when(F.startswith(kind, F.lit("ARRAY")), items)


def _leaves(text: Column, path: Column, key: Column, kind: Column, depth: int) -> Column:
    name = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    own = F.array(F.struct(path.alias("path"), key.alias("key"), F.when(kind != "VOID", text).alias("value"), name.alias("type")))
    inner = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    if not depth:
        # what lies deeper is one leaf, its JSON text
        return own
    below = F.transform(_children(text, path, key, kind), lambda e: _leaves(e["text"], e["path"], e["key"], e["type"], depth - 1))
    return F.when(inner, F.flatten(below)).otherwise(own)


def json_leaves(text: Column, depth: int = DEPTH) -> Column:
    """The leaves (path, key, value, type) of a JSON text in document order, without Python;
    null for what is no JSON and for null. Empty objects and arrays have no leaves; numbers
    keep their digits; what lies deeper than ``depth`` is one leaf with its JSON text."""
    root = F.try_parse_json(text)
    kind = F.when(root.isNull(), F.lit(None)).otherwise(F.schema_of_variant(root))
    # a text alone has quotes around it
    plain = F.when(kind == "STRING", root.cast("string")).otherwise(text)
    return F.when(root.isNotNull(), _leaves(plain, F.lit(""), F.lit(""), kind, depth))


def pruned(value: object) -> object:
    """Without nulls, blank strings, empty lists and empty objects, from the leaves up."""
    if isinstance(value, dict):
        kept = {k: p for k, v in value.items() if (p := pruned(v)) is not None}
        return kept or None
    if isinstance(value, list):
        return [p for v in value if (p := pruned(v)) is not None] or None
    return None if isinstance(value, str) and not value.strip() else value


def text_of(value: object) -> str:
    """All strings and numbers of a tree, keys aside, compatibility-normalized."""
    parts = (x if isinstance(x, str) else json.dumps(x) for _, _, x in leaves(value) if x is not None and not isinstance(x, bool))
    return unicodedata.normalize("NFKC", " ".join(x for x in parts if x))


def flattened(value: object) -> dict[str, str]:
    """Leaf values by short key (the first wins) and by full path; arrays of strings
    joined by new lines, arrays of objects left out."""
    short: dict[str, str] = {}
    full: dict[str, str] = {}

    def walk(v: object, path: str, key: str) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, k)
        elif isinstance(v, list):
            if v and all(isinstance(x, str) for x in v):
                walk("\n".join(v), path, key)
        elif v is not None:
            text = v if isinstance(v, str) else json.dumps(v)
            short.setdefault(key, text)
            full[path] = text

    walk(value, "", "")
    return short | full


def repaired(text: str) -> str | None:
    """JSON out of nearly-JSON, null if no way of ``repair`` reads it."""
    try:
        return json.dumps(repair.read(text)[0], ensure_ascii=False)
    except ValueError:
        return None


def _per_row(text: Column, f: Callable[[object], object], kind: str = "string") -> Column:
    def one(t: str | None) -> object:
        try:
            return None if t is None else f(json.loads(t))
        except ValueError:
            return None

    return F.pandas_udf(lambda s: pd.Series([one(t) for t in s], dtype=object), kind)(text)


def prune_json(text: Column) -> Column:
    return _per_row(text, lambda v: json.dumps(pruned(v) or {}, ensure_ascii=False))


def walk_text(text: Column) -> Column:
    return _per_row(text, text_of)


def flatten_json(text: Column) -> Column:
    return _per_row(text, lambda v: json.dumps(flattened(v), ensure_ascii=False))


def repair_json(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else repaired(t)), "string")(text)

"""Nested JSON as rows, and JSON with its secrets withheld."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from lectern.functions.text import SECRET_NAMES

NODE = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
#: Rows in a batch.
BATCH = 50_000
#: Values inside strings are read as JSON once more so many times at most: what a page carries is JSON in JSON.
UNWRAP = 3


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "string" if isinstance(value, str) else "number"


def _step(key) -> str:
    """A name in a path: ~ and / are written ~0 and ~1."""
    return str(key).replace("~", "~0").replace("/", "~1")


def read(text: str | None):
    """(value, whether it is JSON) of a text."""
    try:
        return json.loads(text), True
    except (TypeError, ValueError, RecursionError):
        return None, False


def walk(text: str | None, unwrap: int = UNWRAP) -> Iterator[tuple]:
    """(place, path, parent, name, kind, value) of every value in a text of JSON, each after what holds it, in the order written. A string
    that holds an object or a list of JSON is that, below its own path. What is not JSON has nothing."""
    root, fine = read(text)
    if not fine:
        return
    todo, place = [("", None, None, root, unwrap)], 0
    while todo:
        path, parent, name, value, left = todo.pop()
        kind = _kind(value)
        atom = None if kind in ("object", "array", "null") else value if kind == "string" else json.dumps(value)
        yield place, path, parent, name, kind, atom
        place += 1
        if kind == "string" and left and value.lstrip()[:1] in ("{", "["):
            inner, fine = read(value)
            if fine and isinstance(inner, (dict, list)):
                value, kind, left = inner, _kind(inner), left - 1
        if kind == "object":
            todo += [(f"{path}/{_step(k)}", path, k, v, left) for k, v in reversed(value.items())]
        elif kind == "array":
            todo += [(f"{path}/{k}", path, None, v, left) for k, v in reversed(list(enumerate(value)))]


def nodes(rows: DataFrame, key: str, column: str = "json") -> DataFrame:
    """key, place, path, parent, name, kind, value of every value in a column of JSON, whatever its depth and order of keys; see walk()."""
    kept = [f for f in rows.schema.fields if f.name == key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            found: list[tuple] = []
            texts = b.column(column)

            def out() -> pa.RecordBatch:
                columns = list(zip(*found, strict=True)) or [()] * 6
                arrays = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:])]
                return pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), *arrays], [key, *NODE.fieldNames()])

            for k in range(b.num_rows):
                for node in walk(texts[k].as_py()):
                    at.append(k)
                    found.append(node)
                    if len(found) >= BATCH:
                        yield out()
                        at.clear()
                        found.clear()
            if found:
                yield out()

    return rows.select(key, F.col(column).cast("string").alias(column)).mapInArrow(run, T.StructType([*kept, *NODE.fields]))


@udtf(returnType=NODE)
class JsonNodes:
    """json_nodes(text): the values of one JSON text, for SQL."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from walk(text)


# Parts of a name, without anything but letters and digits, that say that a value is a secret, and a name that is none.
SECRET_PARTS = tuple("password passwd cookie authorization bearer sessionid token saml oauth secret credential otp mfa session authheader accesskey signature".split())
NOT_SECRET = ("currentsessiondownloadverified",)
REDACTED = "<REDACTED>"
_BEARER = re.compile(r"\bauthorization\s*:\s*bearer\s+[^\s,;]+", re.I)
_NAMED = re.compile(rf"\b({SECRET_NAMES})\b\s*[:=]\s*(?:bearer\s+)?([^\s,;&]+)", re.I)
_URL = re.compile(r"(https?://)(?:[^\s/@<>\"']*@)?([^\s?#<>\"']*)[^\s<>\"']*", re.I)


def is_secret(name: str) -> bool:
    bare = re.sub("[^a-z0-9]", "", name.lower())
    return bare not in NOT_SECRET and any(part in bare for part in SECRET_PARTS)


def _sanitized(text: str) -> str:
    """What functions.text.sanitize_text() makes of a text."""
    return _URL.sub(r"\1\2", _NAMED.sub(rf"\1={REDACTED}", _BEARER.sub(f"Authorization: {REDACTED}", text)))


def withheld(text: str | None) -> str | None:
    """A text of JSON, keys sorted, in which every value under a name of a secret, at any depth, is withheld unless it is false or null, and every
    other string sanitised; null for what is not JSON, which may hold anything."""
    root, fine = read(text)
    if not fine:
        return None
    top = [root]
    todo: list[tuple] = [(top, 0, None)]
    while todo:
        holder, at, name = todo.pop()
        value = holder[at]
        if name is not None and is_secret(name):
            if value is not None and value is not False:
                holder[at] = REDACTED
        elif isinstance(value, dict):
            todo += [(value, k, k) for k in value]
        elif isinstance(value, list):
            todo += [(value, k, None) for k in range(len(value))]
        elif isinstance(value, str):
            holder[at] = _sanitized(value)
    try:
        return json.dumps(top[0], sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return None


@F.arrow_udf(T.StringType())
def redact(text: pa.Array) -> pa.Array:
    """withheld() of each text."""
    return pa.array([withheld(x) for x in text.to_pylist()], pa.string())


def forbidden(rows: DataFrame, key: str, column: str = "json") -> DataFrame:
    """key, refused: whether a request's JSON has a name of a secret anywhere. A request that is not JSON is refused too."""
    bare = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    bad = F.exists(F.array(*map(F.lit, SECRET_PARTS)), lambda part: bare.contains(part)) & ~bare.isin(*NOT_SECRET)
    seen = nodes(rows, key, column).groupBy(F.col(key).alias("_key")).agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("bad"))
    return rows.join(seen, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("bad", F.lit(True)).alias("refused"))

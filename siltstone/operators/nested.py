"""JSON texts in a column: their fields in the order first seen, what they hold, and a flat table of them.

Every object is read into pairs of key and variant, in the order of the text (variants themselves sort keys), level by level;
plain texts by Python's reader, in Arrow batches. Names of nested fields are joined by ``_``; a key that a row holds twice, or two fields of one name, keep the later value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.names import quoted
from siltstone.operators.query import ROW

#: Levels of objects that are opened; deeper ones are null, as arrays are.
DEPTH = 3
#: Columns that a flat table may have.
MOST_COLUMNS = 5_000


def _kind(s: Column) -> Column:
    """object, array, null, boolean, text, whole or number, by a variant's schema."""
    return (
        F.when(s.isNull() | (s == "VOID"), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "BOOLEAN", "boolean")
        .when(s == "BIGINT", "whole").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number").otherwise("text")
    )


def _looks(raw: Column) -> Column:
    """A kind by the value's text alone, where Spark makes no variant of an object, as one below it holds a key twice."""
    return (
        F.when(raw.isNull(), "null").when(raw.startswith("{"), "object").when(raw.startswith("["), "array").when(raw.isin("true", "false"), "boolean")
        .when(raw.rlike(r"^-?\d{1,18}$"), "whole").when(raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").otherwise("text")
    )


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it: inside lambdas Spark works each mention out anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _level(text: Column, name: Column, left: int) -> Column:
    """Fields of the object ``text``: structs of name, kind, text. It is read once for its variants, and once more if texts of objects in it are needed."""

    def scalar(kind: Column, own: Column) -> Column:
        return F.when(kind.isin("boolean", "text", "whole", "number"), own)

    def pairs(typed: Column, kinds: Column, raw: Column) -> Column:
        def known(e: Column, i: Column) -> Column:
            kind = F.get(kinds, i)
            return F.struct(e["key"].alias("key"), kind.alias("kind"), scalar(kind, e["value"].cast("string")).alias("text"), F.get(raw, i)["value"].alias("raw"))

        def untyped(e: Column) -> Column:
            return _bound(_looks(e["value"]), lambda kind: F.struct(e["key"].alias("key"), kind.alias("kind"), scalar(kind, e["value"]).alias("text"), e["value"].alias("raw")))

        return F.when(kinds.isNotNull(), F.transform(typed, known)).otherwise(F.transform(raw, untyped))

    def field(e: Column) -> Column:
        named = F.concat(name, e["key"])
        leaf = F.array(F.struct(named.alias("name"), e["kind"].alias("kind"), e["text"].alias("text")))
        return F.when(e["kind"] == "object", _level(e["raw"], F.concat(named, F.lit("_")), left - 1)).otherwise(leaf) if left > 1 else leaf

    def opened(typed: Column, kinds: Column) -> Column:
        again = kinds.isNull() | F.array_contains(kinds, "object") if left > 1 else kinds.isNull()
        return _bound(F.when(again, F.map_entries(F.from_json(text, "map<string,string>"))), lambda raw: F.flatten(F.transform(pairs(typed, kinds, raw), field)))

    typed = F.map_entries(F.from_json(text, "map<string,variant>"))
    return _bound(typed, lambda t: _bound(F.transform(F.transform(t, lambda e: F.schema_of_variant(e["value"])), _kind), lambda k: opened(t, k)))


_PLAIN = re.compile(r"-?(?!0\.00)(0|[1-9][0-9]{0,5})\.[0-9]{0,5}[1-9]")  # without exponent as a double, too


class _Decimal(str):
    """A number with a point, as written."""


@lru_cache(100_000)
def _decimal(text: str) -> _Decimal:
    if not _PLAIN.fullmatch(text):
        raise ValueError("written by Spark in another form")
    return _Decimal(text)


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key twice")
    return found


_KINDS = {str: "text", int: "whole", _Decimal: "number", bool: "boolean", list: "array", dict: "object", type(None): "null"}
_LONG = range(-(2**63), 2**63)


def _walk(x: dict, prefix: str, left: int, names: list, kinds: list, texts: list) -> None:
    for k, v in x.items():
        kind = type(v)
        if kind is dict and left > 1:
            _walk(v, f"{prefix}{k}_", left - 1, names, kinds, texts)
            continue
        if kind is int and v not in _LONG:
            raise ValueError("no whole number to Spark")
        names.append(prefix + k)
        kinds.append(_KINDS[kind])
        texts.append(v if kind is str else str(v) if kind is int or kind is _Decimal else str(v).lower() if kind is bool else None)


def _plain_leaves(depth: int) -> Callable[[Column], Column]:
    """:func:`leaves` of the texts that Python's reader and Spark's are known to take alike; null for all others: keys twice,
    numbers that Spark writes in another form, code point escapes, deep or very long texts, broken ones."""

    @F.arrow_udf("array<struct<name:string,kind:string,text:string>>")
    def plain(texts: pa.Array) -> pa.Array:
        decoder = json.JSONDecoder(object_pairs_hook=_once, parse_float=_decimal, parse_constant=_decimal)
        ends, nulls, out = [0], [], ([], [], [])
        for text in texts.to_pylist():
            begin = len(out[0])
            try:
                if text is None or len(text) > 1_000_000 or "\\u" in text or text.count("{") + text.count("[") > 100:
                    raise ValueError
                x = decoder.decode(text)
                if type(x) is not dict:
                    raise ValueError
                _walk(x, "", depth, *out)
                nulls.append(False)
            except ValueError:
                for column in out:
                    del column[begin:]
                nulls.append(True)
            ends.append(len(out[0]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in out], ["name", "kind", "text"]), mask=pa.array(nulls, pa.bool_()))

    return plain


def leaves(c: Column, depth: int = DEPTH) -> Column:
    """All fields of a JSON object, in the order of the text: array of (name, kind, text). Null for null, broken texts and values that are no object.

    Kinds: text, whole, number, boolean, null, array, object (one below ``depth`` levels); the last three have no text.
    In an object above one that holds a key twice, texts that look like numbers or truth values are taken for such.
    Plain texts are read in batches by a helper, all others by Spark's own expressions, which are slower and give the same.
    """
    text = c.cast("string")
    return F.coalesce(_plain_leaves(depth)(text), _bound(text, lambda t: _level(t, F.lit(""), depth)))


def _once_each(x: Column) -> Column:
    """Leaves with each name once: where it stands first, with the kind and text that it has last."""

    def last(all_: Column, names: Column, back: Column) -> Column:
        kept = F.filter(all_, lambda e, i: F.array_position(names, e["name"]) == i + 1)
        return F.when(F.size(F.array_distinct(names)) == F.size(names), all_).otherwise(F.transform(kept, lambda e: F.get(back, (F.array_position(back["name"], e["name"]) - 1).cast("int"))))

    return _bound(x, lambda a: last(a, a["name"], F.reverse(a)))


def _met(df: DataFrame, column: str, depth: int, once: bool = False) -> DataFrame:
    """ROW, place (from 0 in each row), name, kind, text of all fields of all rows; ``once``: a name that a row holds twice by its later value."""
    rows = df.select(F.col(ROW), leaves(F.col(quoted(column)), depth).alias("x"))
    return rows.select(F.col(ROW), F.posexplode(_once_each(F.col("x")) if once else F.col("x")).alias("place", "x")).select(ROW, "place", "x.*")


def fields(df: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """What the objects of a column hold: name, position (order first seen, from 0), kinds, n (rows with the field), nulls, distinct values, least and greatest number.

    ``df`` has row numbers. ``n`` counts a field that a row holds twice once; arrays and objects too deep have no values. Two columns are read.
    """
    value = F.when(F.col("kind").isin("whole", "number"), F.col("text").cast("double"))
    # one row for each value, by sums of fixed width: a row's number and place are met once, so they need no struct
    values = _met(df, column, depth, once=True).groupBy("name", "kind", "text").agg(F.count("*").alias("n"), F.min(ROW).alias("row"), F.min_by("place", ROW).alias("place"))
    out = values.groupBy("name").agg(
        F.min(F.struct("row", "place")).alias("first"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "null", F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(F.col("text").isNotNull()).alias("distinct"), F.min(value).alias("low"), F.max(value).alias("high"),
    )
    # few rows, one for each name: numbered without a partition
    first = out.agg(F.array_sort(F.collect_list("first")).alias("all"))
    return out.crossJoin(F.broadcast(first)).select("name", (F.array_position("all", F.col("first")) - 1).cast("int").alias("position"), "kinds", "n", "nulls", "distinct", "low", "high")


def _type(kinds: set[str]) -> str:
    """The column type that holds all values of these kinds."""
    kinds = kinds - {"null", "array", "object"}
    if kinds == {"boolean"}:
        return "boolean"
    if kinds and kinds <= {"whole", "number"}:
        return "bigint" if kinds == {"whole"} else "double"
    return "string"


def flat_names(df: DataFrame, column: str, depth: int = DEPTH) -> list[tuple[str, str]]:
    """Names and types of the columns of :func:`flat`, in the order first seen. Needs no distinct counts, so fields are met by partial aggregation alone."""
    found = _met(df, column, depth).groupBy("name").agg(F.min(F.struct(ROW, "place")).alias("first"), F.collect_set("kind").alias("kinds"))
    rows = found.orderBy("first").limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"the objects have over {MOST_COLUMNS:,} fields")
    return [(r["name"], _type(set(r["kinds"]))) for r in rows]


def flat(df: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """The objects of a column as a table, a column for each field: whole numbers, numbers, truth values, else text; empty texts are null.

    Columns stand in the order first seen; mixed kinds become text. Arrays, objects too deep and rows that hold no object are null.
    """
    names = flat_names(df, column, depth)
    if not names:
        raise ValueError("no fields were found")
    rows = df.select(F.reverse(leaves(F.col(quoted(column)), depth)).alias("__x")).select("__x", F.col("__x")["name"].alias("__n"))

    def value(name: str, kind: str) -> Column:
        text = F.nullif(F.get("__x", (F.array_position("__n", name) - 1).cast("int"))["text"], F.lit(""))  # the later of two comes first
        return (text if kind == "string" else text.try_cast(kind)).alias(name)

    return rows.select(*(value(n, k) for n, k in names))


def schema(df: DataFrame, column: str) -> str:
    """One type that holds every value of the column, keys sorted, as Spark writes it; broken texts are left out."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(quoted(column)))).alias("s")).first()["s"]

"""Declarative row and column filters, compiled to Columns so that Catalyst pushes them into the scan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of a dotted path, None where the schema lacks it."""
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def object_id(value: str) -> bool:
    """Whether a string is an id of 24 hexadecimal digits."""
    return bool(re.fullmatch(r"[0-9a-fA-F]{24}", value))


def _ids(path: str, kind: T.DataType | None, value):
    """Criteria name ids by their digits: where an id column holds bytes, values of 24 digits become those; a list only if all of its values are such."""
    if path.split(".")[-1] != "_id" or not isinstance(kind, T.BinaryType):
        return value
    known = lambda v: isinstance(v, str) and object_id(v)
    if isinstance(value, (list, tuple)):
        return [bytes.fromhex(v) for v in value] if value and all(map(known, value)) else value
    return bytes.fromhex(value) if known(value) else value


def _one(df: DataFrame, c: Mapping, prefix: str, missing: str) -> Column | None:
    path, op, value = prefix + c["field"], str(c.get("operator", "eq")).lower(), c.get("value")
    kind = field_type(df.schema, path)
    value = _ids(path, kind, value)
    at = F.lit(None) if kind is None else F.col(path)
    strict = missing == "reject"
    if strict and kind is not None and not isinstance(value, (list, tuple)) and value is not None:
        if isinstance(kind, NUMBERS) != (isinstance(value, (int, float)) and not isinstance(value, bool)):
            at, value = at.cast("string"), str(value)  # unlike types compare as strings
    if op in ("in", "nin"):
        values = list(value or ())
        if not values:
            return F.lit(False) if strict and op == "in" else None  # otherwise the criterion is skipped
        out = at.isin(values) if op == "in" else at.isNull() | ~at.isin(values)
    elif op in ORDERED:
        out = ORDERED[op](at, F.lit(value))
    elif op == "regex":
        try:
            re.compile(value)
        except re.error:
            return F.lit(False)
        out = at.cast("string").rlike(value)
    elif op == "ne":
        out = ~at.eqNullSafe(F.lit(value))
    else:
        out = at.eqNullSafe(F.lit(value))
    return out & at.isNotNull() if strict and value is not None else out


def row_filter(df: DataFrame, criteria: Iterable[Mapping] | None, prefix: str = "", missing: str = "pass") -> Column:
    """All criteria hold. `missing="pass"`: ne and nin hold for a missing value, as in a document store; "reject": none does.

    The predicate is null where a missing value decides; a filter takes that as false, and without coalesce() it reaches the scan."""
    parts = [p for c in criteria or () if (p := _one(df, c, prefix, missing)) is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def fields(columns: Sequence[str], key: str | Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), always: Sequence[str] = ()) -> list[str]:
    """Columns that stay, in their order: the key and `always`; of the rest those included, or else all not excluded."""
    keys = {key} if isinstance(key, str) else set(key)
    if not include and not exclude:
        return list(columns)
    return [c for c in columns if c in keys or c in always or (c in include if include else c not in exclude)]


def column_filter(df: DataFrame, key: str | Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), always: Sequence[str] = ()) -> DataFrame:
    return df.select(*fields(df.columns, key, include, exclude, always))


def image_filter(changes: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), always: Sequence[str] = (), key: str | Sequence[str] = (), doc: str = "doc") -> DataFrame:
    """The column filter on the post-image of a changelog, never on its envelope."""
    kept = fields(changes.schema[doc].dataType.names, key, include, exclude, always)
    image = F.when(F.col(doc).isNotNull(), F.struct(*[F.col(f"{doc}.{c}") for c in kept]))
    return changes.withColumn(doc, image)


def change_filter(changes: DataFrame, criteria: Iterable[Mapping] | None, doc: str = "doc", on_exit: str = "keep") -> DataFrame:
    """The row filter on post-images. Deletes and control rows always pass; with on_exit="delete", a change that leaves the filter becomes a delete."""
    ok = F.coalesce(row_filter(changes, criteria, prefix=f"{doc}."), F.lit(False)) | ~F.col("op").isin("insert", "update", "replace")
    if on_exit == "keep":
        return changes.filter(ok)
    gone = ~ok & F.col("op").isin("update", "replace")
    return changes.filter(ok | gone).withColumns({"op": F.when(gone, F.lit("delete")).otherwise(F.col("op")), doc: F.when(~gone, F.col(doc))})

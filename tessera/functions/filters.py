"""Metadata filter expressions (JSON tree) compiled to one Spark ``Column``.

The compiled predicate is an ordinary Catalyst expression over typed
top-level columns, so it is pushed to the Parquet scan of the index.
Supported operators: ``$eq $ne $gte $in $and``, and as an extension ``$gt $lt
$lte $nin $or $exists``. Anything else raises.

Missing keys: ``$eq``, the comparisons and ``$in`` are null on a missing key (a
WHERE drops the row; no operator negates a sub-filter, so null acts as false),
``$ne`` and ``$nin`` are true. Plain comparisons keep the predicate
translatable to a Parquet filter.
"""

from __future__ import annotations

import json
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The filter operators of the service's filter language.
FILTER_OPERATORS = ("$eq", "$ne", "$gte", "$in", "$and")
# Further operators of such languages.
MORE_OPERATORS = ("$gt", "$lt", "$lte", "$nin", "$or", "$exists")
_COMPARE = {"$gte": operator.ge, "$gt": operator.gt, "$lt": operator.lt, "$lte": operator.le}

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class FilterError(ValueError):
    pass


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _key_column(key: str, schema: T.StructType) -> tuple[Column, T.DataType]:
    names = {f.name: f.dataType for f in schema.fields}
    if key in names:
        return F.col(key), names[key]
    if "extra" in names:
        return F.col("extra").getItem(key), T.StringType()
    raise FilterError(f"unknown metadata key {key!r}")


def _operand(c: Column, dtype: T.DataType, value) -> tuple[Column, Column]:
    """Align column and literal types: numbers compare as double, the rest as text."""
    if _is_number(value):
        if isinstance(dtype, _NUMERIC):
            return c.cast("double"), F.lit(float(value))
        return c.try_cast("double"), F.lit(float(value))
    if isinstance(value, bool):
        return c.cast("boolean"), F.lit(value)
    if isinstance(dtype, T.StringType):
        return c, F.lit(str(value))
    if isinstance(dtype, T.TimestampType):
        return c, F.lit(str(value)).cast("timestamp")
    return c.cast("string"), F.lit(str(value))


def compile_filter(flt, schema: T.StructType, non_filterable=()) -> Column:
    """Compile a filter (dict or JSON text) against the index ``schema``."""
    if flt is None:
        return F.lit(True)
    if isinstance(flt, str):
        try:
            flt = json.loads(flt)
        except json.JSONDecodeError as e:
            raise FilterError(f"filter is not valid JSON: {e}") from e
    if not isinstance(flt, dict) or not flt:
        raise FilterError("filter must be a non-empty JSON object")
    parts = []
    for key, cond in flt.items():
        if key in ("$and", "$or"):
            if not isinstance(cond, list) or not cond:
                raise FilterError(f"{key} takes a non-empty list")
            join = operator.and_ if key == "$and" else operator.or_
            parts.append(reduce(join, [compile_filter(x, schema, non_filterable) for x in cond]))
            continue
        if key.startswith("$"):
            raise FilterError(f"unsupported operator {key!r}; supported: {FILTER_OPERATORS + MORE_OPERATORS}")
        if key in non_filterable:
            raise FilterError(f"metadata key {key!r} is non-filterable in this index")
        c, dtype = _key_column(key, schema)
        if not isinstance(cond, dict):
            cond = {"$eq": cond}  # shorthand {"k": v}
        for op, val in cond.items():
            if op == "$eq":
                l, r = _operand(c, dtype, val)
                parts.append(l == r)
            elif op == "$ne":
                l, r = _operand(c, dtype, val)
                parts.append(~l.eqNullSafe(r))
            elif op in _COMPARE:
                if not _is_number(val) and not isinstance(val, str):
                    raise FilterError(f"{op} takes a number")
                l, r = _operand(c, dtype, val)
                parts.append(_COMPARE[op](l, r))
            elif op in ("$in", "$nin"):
                if not isinstance(val, list) or not val:
                    raise FilterError(f"{op} takes a non-empty list")
                if all(_is_number(v) for v in val):
                    l, _ = _operand(c, dtype, val[0])
                    among = l.isin([float(v) for v in val])
                else:
                    l, _ = _operand(c, dtype, str(val[0]))
                    among = l.isin([str(v) for v in val])
                parts.append(among if op == "$in" else l.isNull() | ~among)
            elif op == "$exists":
                if not isinstance(val, bool):
                    raise FilterError("$exists takes true or false")
                parts.append(c.isNotNull() if val else c.isNull())
            else:
                raise FilterError(f"unsupported operator {op!r}; supported: {FILTER_OPERATORS + MORE_OPERATORS}")
    return reduce(lambda a, b: a & b, parts)

"""Arrow UDFs that are made when called, so that modules can be imported without a session."""

from __future__ import annotations

import functools
import hashlib
import json
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def vectorized(kind: str):
    """Marks a function of pandas Series as a UDF of the type; `call.function` is the function itself."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return call.udf()(*columns)

        call.function, call.udf = f, lambda: F.pandas_udf(f, kind)
        return call

    return wrap


#: Rows whose results are Python objects at once.
AT_ONCE = 256


def listed(kind: str):
    """Marks a function that gives a row's list of structs as tuples, from the row's values, as a UDF of the type.

    Results of a few rows at a time become Arrow; a batch of them as dicts would take hundreds of bytes for each struct.
    """

    def wrap(f):
        def made():
            element = to_arrow_type(DataType.fromDDL(kind))

            def batches(*arrays):
                found = []
                for at in range(0, max(1, len(arrays[0])), AT_ONCE):
                    rows = [f(*r) for r in zip(*(a.slice(at, AT_ONCE).to_pylist() for a in arrays), strict=True)]
                    flat = [x for r in rows for x in r]
                    structs = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], c.type) for k, c in enumerate(element)], fields=list(element))
                    found.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), structs))
                return pa.concat_arrays(found)

            return F.arrow_udf(batches, f"array<{kind}>", F.ArrowUDFType.SCALAR)

        @functools.wraps(f)
        def call(*columns):
            return call.udf()(*columns)

        call.function, call.udf = f, made
        return call

    return wrap


#: Characters of a text up to which what is made of it may be kept.
LONG = 4096


def short(size: int):
    """Keeps the last results for short texts; long ones are made anew, so what is kept is bounded in bytes."""

    def wrap(f):
        kept = functools.lru_cache(size)(f)
        return functools.wraps(f)(lambda s: kept(s) if s is None or len(s) <= LONG else f(s))

    return wrap


def digest(fields: dict) -> str:
    """The SHA-256 of fields as JSON: names sorted, no spaces, UTF-8."""
    return hashlib.sha256(json.dumps(fields, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

"""Event ids that sort by time: 48 bits of milliseconds, 80 random bits, in Crockford's base 32."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"  # fixed value: the alphabet of the format


def format_ulid(millis: int, noise: int) -> str:
    value = (millis << 80) | noise
    return "".join(_DIGITS[value >> shift & 31] for shift in range(125, -5, -5))


@F.pandas_udf(T.StringType())
def _ulids(millis: pd.Series) -> pd.Series:
    out, last, noise = [], None, 0
    for m in millis.fillna(0).astype("int64"):
        # Within one millisecond of one batch ids ascend, as far as 80 bits go.
        noise = noise + 1 if m == last and noise + 1 < 1 << 80 else int.from_bytes(os.urandom(10), "big") >> 1
        last = m
        out.append(format_ulid(int(m), noise))
    return pd.Series(out, dtype=object)


_fresh = _ulids.asNondeterministic()


def ulid(at: Column) -> Column:
    """A new id for each row, from its time."""
    return _fresh(F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at))

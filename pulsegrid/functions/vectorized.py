"""Vectorised functions that can be defined before there is a session."""

from __future__ import annotations

from pyspark.sql import functions as F


def vectorized(kind: str):
    """Like ``pandas_udf``, but the result type is parsed when the function is applied to columns."""

    def wrap(fn):
        def apply(*columns):
            return F.pandas_udf(fn, kind)(*columns)

        apply.__doc__ = fn.__doc__
        return apply

    return wrap

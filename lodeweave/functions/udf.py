"""Pandas UDFs that are made when they are first used, as their types can't be parsed before there is a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def lazy_pandas_udf(returns: str) -> Callable:
    def of(f: Callable) -> Callable[..., Column]:
        made: list = []

        @wraps(f)
        def call(*columns: Column | str) -> Column:
            if not made:
                made.append(F.pandas_udf(f, returns))
            return made[0](*columns)

        return call

    return of

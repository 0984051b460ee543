"""Columns that are made once in a session: an expression of hundreds of functions takes a second to write down."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def kept(make: Callable) -> Callable:
    """``make`` (of hashable arguments, giving columns), called once for the same arguments as long as Spark runs."""

    @wraps(make)
    def of(*args):
        made = SparkContext._active_spark_context.__dict__.setdefault("_numerant_columns", {})
        if (key := (make.__module__, make.__qualname__, args)) not in made:
            made[key] = make(*args)
        return made[key]

    return of

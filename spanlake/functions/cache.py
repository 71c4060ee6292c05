"""Reuse of built column expressions.

Building a large expression from Python costs one Py4J round trip per node;
the finished ``Column`` objects reference columns only by name, so they can be
reused for every frame of the same shape. Cached per SparkContext.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def per_context(fn):
    cache: dict[tuple, object] = {}

    @functools.wraps(fn)
    def wrapper(*args):
        key = (id(SparkContext._active_spark_context), args)
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]

    return wrapper

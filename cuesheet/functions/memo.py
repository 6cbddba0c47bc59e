"""Reuse of large column expressions: building them costs thousands of gateway calls."""

from __future__ import annotations

import functools

from pyspark import SparkContext


def per_context(build):
    """Cache ``build(*hashable args)`` for the life of the current Spark context."""
    cache: dict = {}

    @functools.wraps(build)
    def wrapper(*args, **kwargs):
        key = (id(SparkContext._gateway), args, tuple(sorted(kwargs.items())))
        if key not in cache:
            cache[key] = build(*args, **kwargs)
        return cache[key]

    return wrapper

"""Helpers of the tests."""

from __future__ import annotations

from contextlib import contextmanager


@contextmanager
def settings(spark, **values):
    """Session settings for a while; names come with their dots, as keys of a dict."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

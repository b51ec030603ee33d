"""Data-preparation operators on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; nothing here parses,
plans or stores data itself.  Row order never comes from the input: operators
that depend on it ask for ``order_by``.
"""

from millrace.session import configure, release_scratch

__all__ = ["configure", "release_scratch"]

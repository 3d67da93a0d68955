"""SQL of the queries: what its text shares."""

from __future__ import annotations

import re

from lexmill.sources.tables import WHITE

_trim = re.compile(r"@trim\(((?:[^()]|\([^()]*\))*)\)")


def expanded(sql: str) -> str:
    """SQL with each ``@trim(x)`` written out: without white space of any script at the ends."""
    return _trim.sub(lambda m: f"trim({m[1]}, '{WHITE}')", sql)

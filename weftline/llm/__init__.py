"""Operators of a training-data pipeline, with their queries and SQL.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

from weftline.llm import queries as _q

queries = _q.queries
oracle_sql = _q.oracle_sql

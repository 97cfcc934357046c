"""The named queries and their SQL."""

from netloom.plans import captures, claims, framed, samples, timing, views

_PARTS = (claims, timing, views, samples, captures, framed)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}

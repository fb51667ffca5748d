"""All queries of the library with their SQL, by name."""

from __future__ import annotations

from railyard.queries import build, chains, demand, feed, jobs, network, plans, streets

PARTS = (feed, build, network, chains, demand, plans, streets, jobs)
QUERIES = {name: f for part in PARTS for name, f in part.Q.queries.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.Q.oracles.items()}

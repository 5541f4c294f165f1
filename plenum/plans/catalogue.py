"""Every query by name, and the SQL that must agree with it."""

from __future__ import annotations

from plenum.plans import clustered, density, joins, meetings, networks, records, shares, sources, streams, texts, times  # noqa: F401  they enter their queries
from plenum.plans.registry import ORACLES, QUERIES  # noqa: F401

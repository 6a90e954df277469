"""The queries of the library and their SQL."""

from __future__ import annotations

from lectern.plans import corpus, facts, markup, records, search, star, text

_PLANS = (text, search, corpus, records, star, facts, markup)
QUERIES: dict = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in _PLANS for k, v in p.ORACLES.items()}

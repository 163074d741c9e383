"""All core queries and their SQL."""

from __future__ import annotations

from tarn.queries import analyses, domain, evidence, features, pairhand, relational, streams

MODULES = [features, relational, domain, evidence, pairhand, analyses, streams]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}

"""All registered queries and their SQL twins, gathered from the query modules."""

from __future__ import annotations

from detframe.queries import augment, convert, detection, greedy, instances, layouts, live, metrics, records, sampling, similarity, suppression, tracking

MODULES = (detection, greedy, suppression, metrics, instances, records, sampling, augment, tracking, similarity, convert, layouts, live)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

"""All registered queries and their check SQL."""

from courtflow.catalog import base
from courtflow.catalog import positions, analytics, ball, events, players, calibrated, records  # noqa: F401


def queries():
    return base.QUERIES


def checks():
    return {name: base.check_sql(*parts) for name, parts in base.CHECKS.items()}

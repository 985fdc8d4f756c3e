"""The registered queries and the SQL each one is checked against."""

from importlib import import_module

MODULES = ["features", "detection", "reports", "sources", "anomaly", "streams", "sequences"]


def all_queries():
    """(queries, checking SQL) by name."""
    for name in MODULES:
        import_module(f"contract.{name}")
    from contract.registry import ORACLES, QUERIES

    return QUERIES, ORACLES

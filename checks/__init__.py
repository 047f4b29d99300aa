"""Registered queries and the SQL they are checked against."""

from importlib import import_module

MODULES = ["sources", "scalars", "structure", "repair", "usage", "rules", "retrieval", "gold", "compose", "streaming"]


def load_all():
    from checks import registry

    for name in MODULES:
        import_module(f"checks.q_{name}")
    return registry.QUERIES, registry.ORACLES

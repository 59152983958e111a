"""Composed plans and the registry of named queries."""


def load_all():
    """Import every query module so the registry is complete."""
    from tarmac.plans import q_clean, q_features, q_metrics, q_monitor, q_scoring  # noqa: F401
    from tarmac.plans import q_io, q_learn  # noqa: F401
    from tarmac.plans.registry import QUERIES
    return QUERIES

"""Import every query module so the registry is filled."""

from hepark.plans import registry
from hepark.plans import q_features, q_fitting, q_hist, q_io, q_roc, q_sampling, q_scaling, q_scoring  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)

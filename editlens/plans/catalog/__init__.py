"""Registered jobs, one module per area of the operator inventory."""

from . import evaluation, features, labeling, models, relational, retrieval, sources, statistics, text  # noqa: F401

"""Imports every query module, so that the catalog is complete."""

from tabulon.plans import queries_features, queries_models, queries_profile, queries_tables  # noqa: F401
from tabulon.plans.catalog import QUERIES, SQL  # noqa: F401

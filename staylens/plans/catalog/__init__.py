"""Registered queries, one module per operator family (import order = registry order)."""

from staylens.plans.catalog import discovery  # noqa: F401
from staylens.plans.catalog import reports  # noqa: F401
from staylens.plans.catalog import prep  # noqa: F401
from staylens.plans.catalog import integration  # noqa: F401
from staylens.plans.catalog import retrieval  # noqa: F401
from staylens.plans.catalog import sentiment  # noqa: F401
from staylens.plans.catalog import forecast  # noqa: F401
from staylens.plans.catalog import segments  # noqa: F401
from staylens.plans.catalog import audit  # noqa: F401

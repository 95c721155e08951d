"""Query bindings; importing this package fills the registry."""

from sievework.plans import business, features, learning, preparation, profiles, relational, series  # noqa: F401
from sievework.plans.registry import ORACLES, QUERIES  # noqa: F401

"""Registered queries; importing the modules fills the registry."""

from evenkeel.plans import changes, compare, landing, matching, rows  # noqa: F401
from evenkeel.plans.base import ORACLES, QUERIES  # noqa: F401

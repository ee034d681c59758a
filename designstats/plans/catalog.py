"""Imports every query module, so that the registry is complete."""

from designstats.plans import (  # noqa: F401
    q_estimate,
    q_frame,
    q_matching,
    q_models,
    q_replicate,
    q_structures,
)
from designstats.plans.registry import ORACLES, QUERIES  # noqa: F401

"""Drivers that run the operators over stored layers."""

from adlake.plans import stages
from adlake.plans.full import run_full
from adlake.plans.increment import propagate, run_increment

__all__ = ["propagate", "run_full", "run_increment", "stages"]

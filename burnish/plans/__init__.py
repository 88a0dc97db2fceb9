"""Chains of operators: recipes that can be replayed, and sessions that can be undone."""

from burnish.plans.recipe import ACTIONS, Recipe, Step, apply_step
from burnish.plans.session import PrepSession

__all__ = ["ACTIONS", "PrepSession", "Recipe", "Step", "apply_step"]

"""Tables that jobs write between their steps, in the folder that all executors share."""

from orrery.plans.fixpoint import written

__all__ = ["written"]

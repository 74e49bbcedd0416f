"""Sending the package to workers that cannot import it."""

from themeloom.functions.shipping import ship

__all__ = ["ship"]

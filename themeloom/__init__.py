"""Thematic analysis of open-text answers as Spark DataFrame functions."""

from themeloom.options import Options

__all__ = ["Options"]

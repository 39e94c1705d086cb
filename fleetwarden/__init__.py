"""Predictive-maintenance analytics expressed as Spark DataFrame operators."""

from fleetwarden.tables import Tables

__all__ = ["Tables"]

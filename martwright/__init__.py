"""Tabular onboarding, data quality and reporting marts as Spark DataFrame operators."""

from martwright.session import get_session, pin_utc, shared_folder, stage

__all__ = ["get_session", "pin_utc", "shared_folder", "stage"]

"""Inputs that several test modules share."""

from test_sources import CATALOG, FORM, MODULE, files  # noqa: F401

"""Imports every module that registers queries."""

from checks import association, columns, drift, ml, prepare, series, text  # noqa: F401

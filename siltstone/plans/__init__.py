"""Registered queries and the engine object."""

from . import catalog, extras, stored  # noqa: F401

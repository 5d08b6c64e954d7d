"""Functions of the pipe language; importing this fills the registry."""

from sluice.functions import collections, conditions, dates, json, maths, strings  # noqa: F401
from sluice.functions.registry import UnknownFunction, build, supported_functions

__all__ = ["UnknownFunction", "build", "supported_functions"]

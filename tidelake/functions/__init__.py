"""Column helpers for semantics that differ between the documented SQL dialect and Spark's functions."""

from tidelake.functions.scalar import *  # noqa: F403
from tidelake.functions.time import *  # noqa: F403

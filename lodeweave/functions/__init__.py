"""Scalar functions as Column expressions; all built-in unless said otherwise."""

from .text import *  # noqa: F403
from .vector import *  # noqa: F403

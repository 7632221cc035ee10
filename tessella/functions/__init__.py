"""Column functions over series (arrays of doubles) and their summaries, and the same as array kernels."""

from .columns import *  # noqa: F403

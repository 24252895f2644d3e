"""Column-level building blocks: every function takes and returns Spark columns."""

from scarpline.functions.scalars import *  # noqa: F401,F403

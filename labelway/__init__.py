"""labelway: two-level label routing as Spark jobs."""

from labelway.config import HierConfig

__all__ = ["HierConfig"]

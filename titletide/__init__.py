"""titletide: mention and market analytics on Spark DataFrames."""

from titletide.config import Settings

__all__ = ["Settings"]

"""tickerlake: social-post and market-bar signal analytics on Spark.

Every operator is a function from DataFrames to a DataFrame. None of them
triggers an action; Catalyst plans and executes the whole chain. The only
functions that act are the writers in ``tickerlake.sources.lake`` and the
streaming starters in ``tickerlake.streaming``.
"""

__all__ = ["__version__"]

__version__ = "0.1.0"

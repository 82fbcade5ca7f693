"""weir: data pipelines and analytics on Spark DataFrames.

Nothing here imports ``weir.llm``; that subpackage builds on the rest, never the other way round.
"""

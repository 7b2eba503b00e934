"""Training-data operators on Spark DataFrames: de-duplication, filtering, extraction, tokenising and mixing.

Nothing outside this subpackage imports it.
"""

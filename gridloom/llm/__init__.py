"""Training-data operators on Spark DataFrames.

Each module holds one operator with its own interface; ``queries`` holds the thin
queries registered by the entry module. Nothing outside this package imports it.
"""

"""Order-book and market-microstructure analytics on Spark.

functions  column functions on one book row, one book and its predecessor, or one grid row
operators  DataFrame -> DataFrame: state along ticks, grids, targets, sessions
plans      whole pipelines: feature table, research, validation, models
sources    ticks, binary logs, decoders, partitioned store, registry
streaming  the same state as Structured Streaming
"""

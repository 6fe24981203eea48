"""driftmap: climate-attribution and training-data operators on Spark DataFrames."""

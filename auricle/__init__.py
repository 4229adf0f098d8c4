"""auricle: audio-file inspection and analytics on Spark DataFrames."""

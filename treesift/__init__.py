"""Path expressions, field formats and encoders over Spark DataFrames."""

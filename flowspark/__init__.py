"""flowspark: micro-batch analytics, keyed state and stream operators expressed on Spark DataFrames."""

"""Still-image codec operators over Spark DataFrames."""

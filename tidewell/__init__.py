"""tidewell: product-listing search, ranking and evaluation on PySpark DataFrames."""

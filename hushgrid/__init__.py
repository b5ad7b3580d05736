"""hushgrid: sensitive-text analytics and corpus preparation on Spark DataFrames."""

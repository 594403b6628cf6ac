"""Code-mixed text analytics and corpus preparation on Spark DataFrames."""

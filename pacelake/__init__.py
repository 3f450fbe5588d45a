"""Training-history analytics for many athletes, on Spark DataFrames."""

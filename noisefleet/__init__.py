"""Environmental noise analytics for fleets of sound level meters, on Spark DataFrames."""

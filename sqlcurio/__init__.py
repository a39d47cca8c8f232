"""Question-to-SQL corpus curation and training-data preparation on Spark DataFrames."""

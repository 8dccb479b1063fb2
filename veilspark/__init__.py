"""Finding and hiding secrets and personal data in text at scale, on Spark DataFrames."""

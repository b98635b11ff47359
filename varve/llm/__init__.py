"""Training-data operators: ten stages of text corpus preparation on Spark."""

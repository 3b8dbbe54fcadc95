"""Data preparation, exploration, charting and modelling operators on Spark DataFrames."""

"""Headline-technique analytics and text-corpus operators on PySpark DataFrames."""

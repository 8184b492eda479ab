"""Spark-native web-corpus engine: crawl, parse, chunk, encode, search and answer as DataFrames."""

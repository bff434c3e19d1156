"""xylem: an XML query engine on Spark DataFrames.

Documents become rows of a node table, XPath 1.0 becomes joins, windows and
aggregates over it, and Catalyst chooses how to run them.
"""

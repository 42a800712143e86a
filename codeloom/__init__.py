"""codeloom: a Spark-native analytics engine for code graphs, sessions and text corpora.

Sub-packages
------------
functions   column-level scalar functions (names, paths, keys, hashes)
sources     readers and parsers that turn raw material into DataFrames
operators   relational operators: graph, search, diff, snapshot, nested records
plans       query plans over the driver tables, with their SQL equivalents
streaming   Structured Streaming twins of the stateful operators
llm         operators for training-data pipelines; nothing else imports it
"""

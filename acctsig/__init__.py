"""acctsig — account-signal analytics on Spark.

Finds automated accounts in (accounts, posts) data with DataFrame
expressions, aggregations, joins and window functions, first-match rules
and an MLlib gradient-boosted-tree ensemble.

Sub-packages:
  functions  fixed pattern lists and Column -> Column text helpers
  sources    readers (JSON documents, label files, Parquet) and sinks
  operators  feature, rule, learning and evaluation operators
  plans      the registered queries, their SQL oracles and the batch jobs
  streaming  the per-post rules on Structured Streaming
"""

__version__ = "0.1.0"

"""loomgate: a Spark-first engine for verification workloads.

Everything is a DataFrame in and a DataFrame out.  The subpackage ``llm``
(training-data operators) is optional: nothing here imports it.
"""

"""warraq: corpus engineering and analytics on Spark DataFrames.

Layout: ``functions`` (Column expressions and Arrow UDFs), ``operators``
(DataFrame -> DataFrame), ``sources`` (scans and sinks), ``plans`` (the
registered queries with their SQL oracles), ``streaming`` (incremental runs)
and ``llm`` (training-data operators; nothing else imports it).
"""

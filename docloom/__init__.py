"""docloom: corpus analytics as Spark plans.

Sub-packages: ``sources`` (readers), ``functions`` (column builders and Arrow kernels), ``operators``
(DataFrame -> DataFrame), ``plans`` (named queries over the test tables and their SQL), ``streaming`` and,
optionally, ``llm`` (training-data operators; nothing outside imports it).
"""

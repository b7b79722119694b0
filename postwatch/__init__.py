"""Job-alert analytics as Spark DataFrame operators.

Packages: ``sources`` (scans), ``sinks`` (writes), ``functions`` (column expressions), ``operators``
(DataFrame in, DataFrame out), ``plans`` (whole pipelines) and ``streaming`` (the same on a stream).
"""

"""Footfall: user-behaviour analytics on event logs, as Spark DataFrame jobs.

Layers, from the bottom up:

* ``schema``     column names, fixed values and ``StructType``s
* ``functions``  Column expressions (rates, event-time windows, variants, z-test)
* ``sources``    readers, writers, temp views, intermediate tables
* ``operators``  DataFrame -> DataFrame steps (users, funnel, retention, ...)
* ``plans``      whole analyses composed from operators, and the batch job
"""

__version__ = "0.1.0"

"""Cloud-cost analytics over FOCUS billing tables, written as Spark DataFrame operators.

Every operator takes DataFrames and returns a lazy DataFrame that covers all
datasets and all entities in one job.  Layout:

* ``schema``      canonical billing schema and FOCUS column names
* ``session``     session settings the operators rely on
* ``sources``     readers, normalization, canonical table, provenance
* ``functions``   reusable column expressions and window helpers
* ``operators``   quality, spend, panel, anomaly, forecast, opportunity, ...
* ``plans``       compositions: summary and full decision run
"""

__version__ = "0.1.0"

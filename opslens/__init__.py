"""opslens: database-operations analytics over fleet telemetry, on PySpark.

Reports live in :mod:`opslens.plans`, the column functions and relational
operators they are made of in :mod:`opslens.functions` and
:mod:`opslens.operators`, readers and writers in :mod:`opslens.sources`, and the
continuous jobs in :mod:`opslens.streaming`.
"""

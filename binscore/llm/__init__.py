"""Operators of a training-data pipeline: one module per operator, the
``opN_*`` queries in ``queries.py``.  Nothing else in the library imports
this subpackage."""

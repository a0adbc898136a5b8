"""Sylvatica: a Spark-native engine for botanical keys, trait claims and field evidence.

Every operator is a function from DataFrames to a DataFrame.  Nothing here collects rows to the
driver except the ``validate_*`` wrappers, which raise on the first few violations.
"""

__version__ = "0.1.0"

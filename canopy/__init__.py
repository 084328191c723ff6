"""canopy: a PySpark-native engine for JSON trees, their change feeds and their metrics.

Every operator takes and returns DataFrames; nothing here needs a particular
table layout beyond the columns named in each operator's docstring.
"""

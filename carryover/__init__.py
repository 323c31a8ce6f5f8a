"""Carryover: Spark-native consolidation of personal-knowledge records.

Every operator takes and returns DataFrames (or Columns); nothing here starts an
action on its own unless its docstring says so.
"""

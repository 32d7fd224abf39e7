"""Operators for preparing training data, one module per operator.

Nothing else in the library imports this subpackage. Unless a function says
otherwise it takes DataFrames, keeps texts where they are read, and returns a
DataFrame; tables that several steps read are written to the folder that
``spark.checkpoint.dir`` names.
"""

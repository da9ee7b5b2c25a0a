"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it, except the guarded registration in
``__spark_entry__``.  Each module holds one operator with a general interface;
``queries`` derives the registered result columns from it.
"""

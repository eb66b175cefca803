"""Operators for building language-model training data.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when it is present.  Each module holds one operator, with a general interface
over any table that has the named columns.
"""

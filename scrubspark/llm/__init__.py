"""Training-data operators: thirteen corpus operators, their registered queries and SQL.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""

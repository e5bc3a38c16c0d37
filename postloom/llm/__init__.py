"""Training-data operators: one module per operator, queries in ``catalog``.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries
only when it is present.
"""

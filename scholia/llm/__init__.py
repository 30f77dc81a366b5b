"""Training-data operators: each module holds one operator and the thin query registered for it.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only where it can be imported.
"""

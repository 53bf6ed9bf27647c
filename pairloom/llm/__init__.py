"""Training-data pipeline operators.

Nothing else in the package imports this subpackage: it can be deleted and
the rest of the engine keeps working.  ``queries.py`` holds the registered
queries and, where SQL can express them, their SQL twins.
"""

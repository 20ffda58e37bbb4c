"""A corpus engine on PySpark: term matching, reversible rendering, search, diffs, symbol graphs."""

"""tarnlake: a PySpark-native analytics engine.

Relational operators, function families, sources and block statistics are
declared as DataFrame and SQL plans, so that Catalyst picks the physical form.
"""

__version__ = "0.1.0"

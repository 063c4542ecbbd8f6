"""strandloom: a PySpark-native analytics engine for capture-probe design data.

Operators are plain functions from DataFrame(s) to DataFrame; nothing is run
until the caller runs an action, except where an operator must iterate or must
know a size before it may broadcast (each such operator says so).
"""

__version__ = "0.1.0"

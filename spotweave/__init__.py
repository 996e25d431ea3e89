"""spotweave: a PySpark-native analytics engine for spatial molecule data.

Every operator takes DataFrames and returns DataFrames; Catalyst plans them.
"""

__version__ = "0.1.0"

"""gridsieve: raster-patch anomaly analytics on PySpark DataFrames.

Every operator is a function from DataFrames to a DataFrame.  Pixels live in a
long table ``(aoi, row, col, <channels>)``, patches in a table with one array
column per channel, scores in a table with one row per patch.
"""

__version__ = "0.1.0"

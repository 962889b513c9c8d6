"""tripweave: trajectory and route analytics over a road network, on Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame.  Nothing here collects rows to the
driver, and no operator needs a Python worker: all expressions run inside the JVM.
"""

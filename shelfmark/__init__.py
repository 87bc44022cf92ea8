"""shelfmark: recommendation and tagging jobs for content catalogues on Spark.

Every operator takes DataFrames and returns a DataFrame.  Nothing is executed
until the caller writes or collects the result, except where a docstring says
so (iterative clustering, snapshot writers).
"""

"""sieveworks: screening, reconciliation and corpus preparation on Spark DataFrames.

Every operator is a plain function from DataFrames to a DataFrame. Columns are
named by parameters, nothing is collected that grows with the data, and all
intermediate results that outlive a job are written to the session's shared
checkpoint folder.
"""

__version__ = "0.1.0"

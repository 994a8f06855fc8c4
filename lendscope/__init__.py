"""lendscope: credit-risk analytics as distributed Spark DataFrame operators.

Every operator takes DataFrames plus column names and returns DataFrames.
Fitted state (bin edges, WoE tables, coefficients) is itself a small
DataFrame or a small driver-side object whose size is bounded by the number
of features and bins, never by the number of rows.
"""

__version__ = "0.1.0"

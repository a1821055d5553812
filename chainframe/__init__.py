"""chainframe: blockchain time-series analytics as plain PySpark DataFrame operators.

Every public function takes DataFrames and returns DataFrames; nothing is collected
to the driver. Planning, execution, shuffles and state are Spark's own.
"""

__version__ = "0.1.0"

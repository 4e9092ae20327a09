"""seqlab — sessionization, sequence and experiment-inference operators on Spark.

Every public operator is a function ``DataFrame -> DataFrame`` built from
Spark's own expressions; nothing routes rows through the driver.
"""
__version__ = "0.1.0"

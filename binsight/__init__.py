"""binsight: Spark-native analytics over `area x category x date x weight` observations.

Every public operator is a function from DataFrame(s) and plain parameters to a
DataFrame, built from Spark SQL expressions, joins, windows and pyspark.ml.
"""

__version__ = "0.1.0"

"""Building blocks as Spark SQL expression text.

Each function takes SQL expressions (``str``) and returns one, for use in ``F.expr``, ``selectExpr`` or
``spark.sql``. A scan combines thousands of expression nodes; as text they are parsed in one JVM call.
"""

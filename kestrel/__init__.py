"""kestrel: a PySpark-native engine for preparing, indexing and searching text collections.

Every operator is a plain function ``DataFrame -> DataFrame`` built from the public
DataFrame / SQL / Structured Streaming API.  Python runs inside tasks only where a
column expression cannot say the same thing (Arrow-batched pandas UDFs, ``mapInPandas``).
"""

__version__ = "0.1.0"

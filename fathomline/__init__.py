"""fathomline: a Spark-native engine for distributed fibre-sensing data.

Every operator is a function from DataFrame to DataFrame, to be used with
``DataFrame.transform``; the packages are ``operators`` (relational and signal
operators), ``functions`` (column expressions), ``sources`` (readers and
writers), ``plans`` (multi-operator jobs), ``streaming`` and ``queries`` (the
registered queries with their reference SQL).
"""

__version__ = "0.1.0"

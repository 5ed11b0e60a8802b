"""Spark-native engine for typed, versioned, linked records.

Every read is a lazy DataFrame that Catalyst plans; writes are Parquet segments
published by an atomic manifest rename.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

"""Second-hand listing analytics on Spark.

Every operator is a plain function from DataFrames to DataFrames (or from
Columns to Columns), so Catalyst sees one declarative plan and nothing is
collected to the driver except single pages of at most 51 rows.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from lapak.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["build_session", "checkpoint_dir", "cut_lineage"]

# Functions that run in Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""cairn: business, cohort and statistical analytics as Spark DataFrame jobs.

Every public function takes Spark DataFrames (or a SparkSession plus table
paths) and returns a lazy DataFrame.  Reductions happen on the executors;
only bounded results (one row per test, per bucket, per month) ever reach a
closed-form step.
"""

import sys

from pyspark import cloudpickle

# Ship this package's functions (mapInPandas / pandas_udf bodies) to the
# Python workers by value, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from cairn.session import checkpoint_dir, get_session  # noqa: E402

__all__ = ["checkpoint_dir", "get_session"]

"""groundwork: evidence-grounded analytics and corpus preparation on PySpark."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

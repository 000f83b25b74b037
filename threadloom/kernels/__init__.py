"""NumPy kernels behind Arrow functions, for what Spark has no operator for."""

import sys

from pyspark.cloudpickle import register_pickle_by_value


def ship(module_name: str) -> None:
    """Send a module's functions to executors by value, so that they need not have this package."""
    register_pickle_by_value(sys.modules[module_name])

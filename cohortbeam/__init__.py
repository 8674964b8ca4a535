"""cohortbeam: Spark-native cohort analytics, bulk scoring and evaluation.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) built from Spark SQL expressions, so Catalyst plans and
optimizes the whole pipeline. Python runs only inside Arrow-batched model
calls (``operators.scoring``) and image decoding (``operators.images``).
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value inside UDF closures, so
    Python workers (local or on executors) need no installed copy of it."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()

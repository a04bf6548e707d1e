"""ripple — incident-cascade analytics as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function (use with
``df.transform``) built from column expressions, windows, joins and
aggregations, so Catalyst plans it and the work scales with the cluster.
"""

from ripple.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

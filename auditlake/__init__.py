"""Billing-claim audit analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame..., Params -> DataFrame``.  See the README for the
operator index and for the scale rules the package follows.
"""

from auditlake.params import BundleRule, Params

__all__ = ["BundleRule", "Params"]

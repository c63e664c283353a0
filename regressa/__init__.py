"""Spark-native regression analytics.

Every operator takes and returns PySpark DataFrames; statistics that later
steps reuse (medians, modes, category lists, scaler moments, coefficients)
are fitted once with a distributed aggregation and carried as small,
bounded Python values.
"""

from regressa.config import RegressionParams
from regressa.session import get_session, ensure_checkpoint_dir

__all__ = ["RegressionParams", "get_session", "ensure_checkpoint_dir"]

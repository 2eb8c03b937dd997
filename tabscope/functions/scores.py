"""Score and task rules over the columns of a profile or a ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_TYPES = ["integer", "float", "numeric"]
CLASS_TYPES = ["boolean", "categorical"]
REJECTED_TYPES = ["datetime", "unknown"]

# --- fixed values ----------------------------------------------------------------------------
MAX_CLASSES = 50
LOG_FLOOR = 1e-12
# ---------------------------------------------------------------------------------------------


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def share_of_rows(n_rows: Column, share: float) -> Column:
    """share * rows, rounded down."""
    return F.floor(F.lit(share) * n_rows.cast("double"))


def type_score(semantic_type: Column) -> Column:
    return (
        F.when(semantic_type.isin(NUMERIC_TYPES), 2.0)
        .when(semantic_type.isin(CLASS_TYPES), 1.5)
        .when(semantic_type == "text", 0.3)
        .when(semantic_type.isin(REJECTED_TYPES), -1.0)
        .otherwise(0.0)
    )


def quality_score(semantic_type: Column, n_rows: Column, n_unique: Column, missing_ratio: Column,
                  is_unique: Column, is_constant: Column) -> Column:
    """Fitness of a column as a target; a constant or unique column gets its penalty alone."""
    missing_part = (
        F.when(missing_ratio > 0.6, -3.0)
        .when(missing_ratio > 0.3, -1.5)
        .when(missing_ratio > 0.1, -0.5)
        .otherwise(0.5)
    )
    many = F.greatest(F.lit(20), share_of_rows(F.greatest(n_rows, F.lit(1)), 0.05))
    distinct_part = (
        F.when(semantic_type.isin(NUMERIC_TYPES), F.when(n_unique >= many, 2.0).when(n_unique >= 10, 1.0).otherwise(-0.5))
        .when(semantic_type.isin(CLASS_TYPES),
              F.when(n_unique == 2, 2.0).when(n_unique.between(3, MAX_CLASSES), 1.0).otherwise(-0.5))
        .otherwise(-0.2)
    )
    return F.when(is_constant, -10.0).when(is_unique, -4.0).otherwise(missing_part + distinct_part)


def regression_score(std: Column, missing_ratio: Column, n_unique: Column, monotonicity: Column, n_rows: Column) -> Column:
    varies = F.when(F.coalesce(std, F.lit(0.0)) > 0, 1.0).otherwise(0.0)
    spread = F.log2(F.lit(1.0) + n_unique)
    unique = n_unique / F.greatest(n_rows, F.lit(1))
    return varies * (1 - missing_ratio) * spread * (1 - monotonicity) * (1 + unique)


def classification_score(n_unique: Column, n_rows: Column, missing_ratio: Column, dominance: Column,
                         entropy: Column) -> Column:
    most = F.greatest(F.lit(2), F.least(F.lit(MAX_CLASSES), share_of_rows(F.greatest(n_rows, F.lit(1)), 0.3)))
    fits = F.when((n_unique >= 2) & (n_unique <= most), 1.0).otherwise(0.0)
    return fits * (1 - missing_ratio) * (1 - dominance) * (0.5 + 0.5 * entropy)


def task_by_statistics(kind: Column, is_boolean: Column, n_unique: Column, n_rows: Column, integer_share: Column) -> Column:
    """Categorical, boolean and nearly discrete integer columns are classes; the rest is regression."""
    few = n_unique <= F.greatest(F.lit(20), share_of_rows(F.greatest(n_rows, F.lit(1)), 0.05))
    discrete = few & (F.coalesce(integer_share, F.lit(0.0)) >= 0.95)
    return (
        F.when((kind == "categorical") | is_boolean, "classification")
        .when((kind == "numeric") & discrete, "classification")
        .otherwise("regression")
    )


def task_by_type(numeric_like: Column) -> Column:
    return F.when(numeric_like, "regression").otherwise("classification")

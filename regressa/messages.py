"""User-facing texts.

Fixed values: the validation and preprocessing texts equal the reference's, so
that logs read the same; the other texts are our own. ``{}`` fields are filled with ``str.format`` (driver side) or
``format_string`` (Spark side, ``%`` fields).
"""

# Validation (V1-V8)
EMPTY_TABLE = "Dataset is empty"
TARGET_NOT_FOUND = "Target column '{target}' not found"
TARGET_ALL_NULL = "Target column is entirely null"
TARGET_LOW_VALID = "Target has only %.1f%% valid values"
TARGET_NOT_NUMERIC = "Target column '{target}' is not numeric and cannot be converted"
NO_FEATURES = "No feature columns found"
FEW_ROWS = "Dataset is very small (%d rows). Results may be unreliable."
HIGH_CARDINALITY = "Column '{column}' has very high cardinality (%.1f%% unique values)"

# Preprocessing log (C14)
STEP_SAMPLED = "Sampled {n:,} rows from {total:,}"
STEP_DROPPED = "Dropped rows with missing values"
STEP_FILLED_MODE = "Filled missing values in '{column}' with mode"
STEP_FILLED_MEDIAN = "Filled missing values in '{column}' with median"
STEP_ONE_HOT = "One-hot encoded {k} categorical columns"
STEP_LABEL = "Label encoded '{column}'"

NOTE_RANDOM_INSTEAD = "Search method '{method}' runs as random search"

# Recommendations (I9): (title, detail, kind) by R2 band, then by model family. Own wording.
REC_LOW_R2 = ("Weak fit", "Most of the target's spread is left over: look for further inputs, or for "
              "a model that bends", "warning")
REC_MODERATE_R2 = ("Partial fit", "Derived inputs or several models together may explain more", "info")
REC_GOOD_R2 = ("Strong fit", "The inputs account for most of the target's spread", "success")
REC_TREE = ("Tree model", "Follows steps and interactions without being told of them", "info")
REC_REGULARIZED = ("Penalised model", "Shrinks weights that the data hardly support", "info")

# Interpretation (I10). Own wording.
INTERPRET_VARIANCE = "%.1f%% of the spread of {target} is explained"
INTERPRET_MAE = "A prediction misses by %.2f on average"
INTERPRET_RMSE = "Large misses included, the typical error is %.2f"

"""Job parameters (one frozen dataclass instead of a YAML/JSON config file)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values that must equal the reference's defaults.
ALL_MODELS = (
    "linear",
    "ridge",
    "lasso",
    "elastic_net",
    "random_forest",
    "gradient_boosting",
    "svr",
)
MISSING_MODES = ("auto", "drop", "impute")
ENCODINGS = ("onehot", "one_hot_encoding", "label", "label_encoding", "target")
TUNING_METHODS = ("grid", "random", "bayesian")


@dataclass(frozen=True)
class RegressionParams:
    test_size: float = 0.2
    random_state: int = 42
    # Rows above which the opt-in capped sample (C1) applies; the Spark engine
    # does not need it, so ``sample_large_data`` is off by default.
    max_rows_for_analysis: int = 50_000
    sample_large_data: bool = False
    cv_folds: int = 5
    models_to_include: tuple[str, ...] = ALL_MODELS
    scoring_metric: str = "r2"
    handle_missing: str = "auto"
    encode_categorical: str = "onehot"
    scale_features: bool = True
    hyperparameter_tuning: bool = True
    tuning_method: str = "random"
    tuning_iterations: int = 50
    # Spark-side knobs.
    key_columns: tuple[str, ...] = ()
    target_smoothing: float = 10.0
    rank_buckets: int | None = None
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        if not 0.0 < self.test_size < 1.0:
            raise ValueError("test_size must be in (0, 1)")
        if self.cv_folds < 2:
            raise ValueError("cv_folds must be >= 2")
        unknown = set(self.models_to_include) - set(ALL_MODELS)
        if unknown:
            raise ValueError(f"unknown models: {sorted(unknown)}")
        if self.handle_missing not in MISSING_MODES:
            raise ValueError(f"handle_missing must be one of {MISSING_MODES}")
        if self.encode_categorical not in ENCODINGS:
            raise ValueError(f"encode_categorical must be one of {ENCODINGS}")

    def with_(self, **kw) -> "RegressionParams":
        return replace(self, **kw)

"""Model + metadata sink (S9) and source (S10), on any Hadoop-compatible
path (Spark ML persistence, JSON and Parquet written by Spark).

Layout under ``<dir>``: ``model/`` (Spark ML model, or the SVR's arrays as
one JSON row), ``cuts/`` (bins of a boosted model), ``preprocessor/`` (fills, category lists, scaler, feature
names as one JSON row), ``mappings/`` (label/target encoder tables),
``metadata/`` (type, features, target, metrics, steps, config and the
version hash: md5 over the metadata and the coefficients, kept in one place).
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from datetime import datetime, timezone

import numpy as np
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import (GBTRegressionModel, LinearRegressionModel,
                                   RandomForestRegressionModel)
from pyspark.sql import SparkSession

from regressa.operators import clean, encode
from regressa.plans import boosting, forest, gram, models

_LOADERS = {"LinearRegressionModel": LinearRegressionModel,
            "RandomForestRegressionModel": RandomForestRegressionModel,
            "GBTRegressionModel": GBTRegressionModel}


def _json_row(spark: SparkSession, payload: dict, path: str):
    spark.createDataFrame([(json.dumps(payload, default=str),)], "payload string") \
        .coalesce(1).write.mode("overwrite").json(path)


def _read_json_row(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(path).first()["payload"])


def _preprocessor_state(pre: models.Preprocessor) -> tuple[dict, object]:
    enc = pre.encoder
    state = {
        "target": pre.target, "input_features": pre.input_features,
        "fill": None if pre.fill is None else {"values": pre.fill.values, "steps": pre.fill.steps,
                                               "widen": pre.fill.widen_integral,
                                               "spare": pre.fill.spare},
        "drop_nulls": pre.drop_nulls, "feature_names": pre.feature_names, "steps": pre.steps,
        "scaler": None if pre.scaler is None else pre.scaler.stats,
        "target_mean": pre.target_mean, "target_std": pre.target_std,
        "encoder": None,
    }
    mapping = None
    if isinstance(enc, encode.OneHotModel):
        state["encoder"] = {"kind": "onehot", "categories": enc.categories}
    elif isinstance(enc, encode.MixedOneHotModel):
        state["encoder"] = {"kind": "onehot_mixed", "categories": enc.narrow.categories,
                            "widths": enc.wide.widths, "heavy": enc.wide.heavy}
        state["vector_scales"] = pre.vector_scales
        mapping = enc.wide.mapping
    elif isinstance(enc, encode.LabelModel):
        state["encoder"] = {"kind": "label", "columns": enc.columns,
                            "broadcastable": enc.broadcastable, "heavy": enc.heavy}
        mapping = enc.mapping
    elif isinstance(enc, encode.TargetModel):
        state["encoder"] = {"kind": "target", "columns": enc.columns,
                            "global_mean": enc.global_mean, "smoothing": enc.smoothing,
                            "broadcastable": enc.broadcastable, "heavy": enc.heavy}
        mapping = enc.mapping
    return state, mapping


def save_model(path: str, spark: SparkSession, pre: models.Preprocessor, fitted: models.FittedModel,
               metrics: dict | None = None, config=None) -> str:
    """Returns the version hash."""
    state, mapping = _preprocessor_state(pre)
    _json_row(spark, state, f"{path}/preprocessor")
    if mapping is not None:
        mapping.write.mode("overwrite").parquet(f"{path}/mappings")
    m = fitted.model
    if isinstance(m, models.SvrModel):
        coefs = m.coef
        _json_row(spark, {"kind": "svr", "feature_names": m.feature_names, "kernel": m.kernel,
                          "omega": None if m.omega is None else m.omega.tolist(),
                          "phase": None if m.phase is None else m.phase.tolist(),
                          "coef": m.coef.tolist(), "intercept": m.intercept,
                          "converged": m.converged}, f"{path}/model")
        model_class = "SvrModel"
    elif isinstance(m, gram.LinearModel):
        coefs = m.coefficients.toArray()
        _json_row(spark, {"kind": "linear", "coef": coefs.tolist(), "intercept": m.intercept}, f"{path}/model")
        model_class = "LinearModel"
    elif isinstance(m, forest.ForestModel):
        m.packed.write.mode("overwrite").parquet(f"{path}/model")
        coefs, model_class = m.featureImportances.toArray(), "ForestModel"
    elif isinstance(m, boosting.BoostedModel):
        m.trees.write().overwrite().save(f"{path}/model")
        _json_row(spark, {"cuts": m.cuts}, f"{path}/cuts")
        coefs, model_class = m.featureImportances.toArray(), "BoostedModel"
    else:
        m.write().overwrite().save(f"{path}/model")
        model_class = type(m).__name__
        coefs = (m.coefficients.toArray() if hasattr(m, "coefficients")
                 else m.featureImportances.toArray())
    meta = {
        "model_type": fitted.name, "model_class": model_class, "params": fitted.params,
        "feature_names": fitted.feature_names, "target": pre.target,
        "metrics": metrics or {}, "preprocessing_steps": pre.steps,
        "config": dataclasses.asdict(config) if config is not None else {},
        "created_at": datetime.now(timezone.utc).isoformat(),
    }
    digest = hashlib.md5(json.dumps(meta, sort_keys=True, default=str).encode()
                         + np.asarray(coefs, dtype="float64").tobytes()).hexdigest()
    meta["model_hash"] = digest
    _json_row(spark, meta, f"{path}/metadata")
    return digest


def load_model(path: str, spark: SparkSession):
    """``(preprocessor, fitted_model, metadata)``."""
    meta = _read_json_row(spark, f"{path}/metadata")
    st = _read_json_row(spark, f"{path}/preprocessor")
    enc = None
    e = st.get("encoder")
    if e and e["kind"] == "onehot":
        enc = encode.OneHotModel(e["categories"])
    elif e and e["kind"] == "onehot_mixed":
        enc = encode.MixedOneHotModel(encode.OneHotModel(e["categories"]), encode.OneHotVectorModel(
            spark.read.parquet(f"{path}/mappings"), e["widths"], e.get("heavy", {})))
    elif e and e["kind"] == "label":
        enc = encode.LabelModel(spark.read.parquet(f"{path}/mappings"), e["columns"],
                                e["broadcastable"], e.get("heavy", {}))
    elif e and e["kind"] == "target":
        enc = encode.TargetModel(spark.read.parquet(f"{path}/mappings"), e["columns"],
                                 e["global_mean"], e["smoothing"], e["broadcastable"],
                                 e.get("heavy", {}))
    fill = None
    if st.get("fill"):
        fill = clean.FillModel(st["fill"]["values"], st["fill"]["steps"], st["fill"]["widen"],
                               st["fill"].get("spare", {}))
    scaler = None
    if st.get("scaler"):
        scaler = encode.ScalerModel({k: tuple(v) for k, v in st["scaler"].items()})
    pre = models.Preprocessor(st["target"], st["input_features"], fill, st["drop_nulls"], enc,
                              scaler, st["feature_names"], st["steps"], st["target_mean"],
                              st["target_std"], st.get("vector_scales", {}))
    if meta["model_class"] == "SvrModel":
        s = _read_json_row(spark, f"{path}/model")
        m = models.SvrModel(s["feature_names"], s["kernel"],
                            None if s["omega"] is None else np.array(s["omega"]),
                            None if s["phase"] is None else np.array(s["phase"]),
                            np.array(s["coef"]), s["intercept"], s.get("converged", False))
    elif meta["model_class"] == "LinearModel":
        s = _read_json_row(spark, f"{path}/model")
        m = gram.LinearModel(DenseVector(s["coef"]), s["intercept"])
    elif meta["model_class"] == "ForestModel":
        m = forest.read_model(spark, f"{path}/model", len(meta["feature_names"]))
    elif meta["model_class"] == "BoostedModel":
        m = boosting.BoostedModel(_read_json_row(spark, f"{path}/cuts")["cuts"],
                                  GBTRegressionModel.load(f"{path}/model"))
    else:
        m = _LOADERS[meta["model_class"]].load(f"{path}/model")
    return pre, models.FittedModel(meta["model_type"], meta["feature_names"], m,
                                   meta.get("params", {})), meta


def save_package(output_dir: str, result, params) -> str:
    """Workflow stage 7: the best model with its preprocessing and metrics."""
    spark = result.comparison.sparkSession
    best = result.comparison.where(f"Model = '{result.best_name}'").first().asDict()
    save_model(f"{output_dir}/model", spark, result.preprocessor, result.best_model, best, params)
    result.comparison.coalesce(1).write.mode("overwrite").json(f"{output_dir}/comparison")
    return output_dir

"""Numeric transforms (normalize, standardize, log, sqrt, scale) as fit + apply.

``fit`` is one aggregation over the named columns; ``transform`` is a pure
projection with the fitted constants inlined, so it also runs on a streaming
DataFrame. Nulls (and NaN) are ignored when fitting and stay null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washframe.functions.columns import q, value_of
from washframe.operators.stats import fit_stats
from washframe.report import StepLog

KINDS = ("normalize", "standardize", "log", "sqrt", "scale")


@dataclass
class TransformModel:
    kind: str
    params: dict[str, dict[str, float]]
    feature_range: tuple[float, float] = (0.0, 1.0)
    columns: list[str] = field(default_factory=list)

    def expression(self, name: str, v: Column) -> Column:
        p = self.params[name]
        v = v.cast("double")
        if self.kind in ("normalize", "scale"):
            a, b = self.feature_range
            unit = (v - F.lit(p["min"])) / F.lit(p["range"])
            return unit if (a, b) == (0.0, 1.0) else unit * F.lit(b - a) + F.lit(a)
        if self.kind == "standardize":
            return (v - F.lit(p["mean"])) / F.lit(p["scale"])
        if self.kind == "log":
            return F.ln(v + F.lit(p["shift"])) if p["shift"] else F.ln(v)
        if self.kind == "sqrt":
            return F.sqrt(v + F.lit(p["shift"])) if p["shift"] else F.sqrt(v)
        raise ValueError(f"no transformation named {self.kind!r}")

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[
            self.expression(c, value_of(df, c)).alias(c) if c in self.params else q(c)
            for c in df.columns])


def fit_transform_model(df: DataFrame, columns: list[str], kind: str,
                        feature_range=(0, 1)) -> TransformModel:
    if kind not in KINDS:
        raise ValueError(f"no transformation named {kind!r}")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    a, b = (float(feature_range[0]), float(feature_range[1]))
    if kind == "scale" and a >= b:
        raise ValueError(f"the scale range must rise: {feature_range}")
    which = {"normalize": ("min", "max"), "scale": ("min", "max"),
             "standardize": ("mean", "std_pop"), "log": ("min",), "sqrt": ("min",)}[kind]
    st = fit_stats(df, columns, which=which)
    params: dict[str, dict[str, float]] = {}
    for c in columns:
        s = st[c]
        if kind in ("normalize", "scale"):
            lo, hi = s["min"], s["max"]
            rng = (hi - lo) if lo is not None else None
            params[c] = {"min": lo if lo is not None else 0.0,
                         "range": rng if rng else 1.0}     # zero range: scale 1 (x - min = 0)
        elif kind == "standardize":
            params[c] = {"mean": s["mean"] if s["mean"] is not None else 0.0,
                         "scale": s["std_pop"] if s["std_pop"] else 1.0}
        elif kind == "log":
            m = s["min"]
            params[c] = {"shift": abs(m) + 1.0 if m is not None and m <= 0 else 0.0}
        else:
            m = s["min"]
            params[c] = {"shift": abs(m) if m is not None and m < 0 else 0.0}
    return TransformModel(kind, params, (a, b) if kind == "scale" else (0.0, 1.0), list(columns))


def normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    return fit_transform_model(df, columns, "normalize").transform(df)


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0."""
    return fit_transform_model(df, columns, "standardize").transform(df)


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """ln(x); when min <= 0 the column is first shifted by |min| + 1."""
    return fit_transform_model(df, columns, "log").transform(df)


def sqrt_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """sqrt(x); when min < 0 the column is first shifted by |min|."""
    return fit_transform_model(df, columns, "sqrt").transform(df)


def min_max_scale(df: DataFrame, columns: list[str], feature_range=(0, 1)) -> DataFrame:
    """Min-max to ``feature_range`` (a, b); a >= b is an error."""
    return fit_transform_model(df, columns, "scale", feature_range).transform(df)


def apply_transformation(df: DataFrame, columns: list[str], transformation_type: str,
                         params: dict | None = None, log: StepLog | None = None) -> DataFrame:
    """Dispatch by name; unknown names raise. One log entry per call."""
    feature_range = (params or {}).get("feature_range", (0, 1))
    model = fit_transform_model(df, columns, transformation_type, feature_range)
    if log is not None:
        log.add({"sqrt": "square_root", "log": "log_transform", "scale": "min_max_scale"}
                .get(transformation_type, transformation_type), columns=columns)
    return model.transform(df)

"""Fitted segmentations as a versioned Parquet table, for use in later sessions.

A version holds everything that turns a raw company into a segment: column
roles, medians, fences, age repairs, scaling, text weights and centres, one
parameter a row (part, name, position, value, text).  Numbers are stored as
doubles, so a loaded model labels every row as the fitted one did.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions.resolve import Roles
from firmlens.operators import kmeans as km
from firmlens.operators import vectors as ve
from firmlens.operators.text import TfIdf
from firmlens.plans.pipelines import Prepared, assign_segment
from firmlens.session import bounded_collect, local_rows

PARAMETER = "part string, name string, position int, value double, text string"
# Bumped when the meaning of a part changes; a model of another format is refused.
FORMAT = 1
# K x d centres and a vocabulary; more parameters than this are no such model.
MAX_PARAMETERS = 1_000_000


@dataclass(frozen=True)
class StoredModel:
    """Preparation and centres of one stored version."""

    prepared: Prepared
    fit: km.Fit
    as_of_year: int
    version: int

    def assign(self, new_rows: DataFrame) -> DataFrame:
        """``new_rows`` prepared and labelled (``cluster``) as the stored model does."""
        return assign_segment(new_rows, self.prepared, self.fit, self.as_of_year)


def _parameters(prepared: Prepared, fit: km.Fit, as_of_year: int) -> list[tuple]:
    rows: list[tuple] = []

    def put(part: str, values: dict | list, text: bool = False) -> None:
        pairs = values.items() if isinstance(values, dict) else [(str(i), v) for i, v in enumerate(values)]
        rows.extend((part, n, i, None if text else float(v), v if text else None) for i, (n, v) in enumerate(pairs))

    put("meta", {"format": FORMAT, "as_of_year": as_of_year, "group": fit.group, "rounds": fit.rounds, "inertia": fit.inertia})
    for kind in ("numeric", "text", "category"):
        put(f"role.{kind}", getattr(prepared.roles, kind), text=True)
    put("feature", prepared.numeric, text=True)
    put("median", prepared.medians)
    for side in ("q1", "q3", "iqr", "lower", "upper"):
        put(f"fence.{side}", {c: f[side] for c, f in prepared.fences.items()})
    put("age", list(prepared.ages) if prepared.ages else [])
    put("scaler", {"kind": prepared.scaler.kind}, text=True)
    put("scaler.column", prepared.scaler.cols, text=True)
    put("scaler.centre", prepared.scaler.centre)
    put("scaler.scale", prepared.scaler.scale)
    if prepared.tfidf:
        put("term", prepared.tfidf.vocabulary, text=True)
        put("term.weight", prepared.tfidf.weights)
    for i, centre in enumerate(np.asarray(fit.centres, float)):
        put(f"centre.{i}", [float(v) for v in centre])
    put("members", [float(v) for v in fit.n])
    put("spread", [float(v) for v in fit.spread])
    return [*rows, ("meta", "parameters", 5, float(len(rows) + 1), None)]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Stored versions, oldest first; none if nothing was stored at ``path`` yet."""
    try:
        found = spark.read.parquet(path).select("version").distinct().collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r["version"] for r in found)


def save_model(spark: SparkSession, path: str, prepared: Prepared, fit: km.Fit, as_of_year: int) -> int:
    """Store a fitted segmentation as the next version and return its number.

    A version is written once, as one file, and never changed: of two sessions that store at the same time one gets an
    error instead of replacing the other's model.
    """
    version = max(versions(spark, path), default=0) + 1
    rows = local_rows(spark, _parameters(prepared, fit, as_of_year), PARAMETER)
    rows.coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/version={version}")
    return version


def parameters(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of one version (the newest by default)."""
    held = versions(spark, path)
    wanted = version if version is not None else max(held, default=None)
    if wanted not in held:
        raise ValueError(f"no version {wanted} at {path}")
    return spark.read.parquet(path).where(F.col("version") == wanted).drop("version")


def load_model(spark: SparkSession, path: str, version: int | None = None) -> StoredModel:
    """A stored version (the newest by default), checked to be whole."""
    version = version if version is not None else max(versions(spark, path), default=None)
    rows = bounded_collect(parameters(spark, path, version), MAX_PARAMETERS, "parameters")
    parts: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["position"])):
        parts.setdefault(r["part"], {})[r["name"]] = r["text"] if r["value"] is None else r["value"]
    meta = parts["meta"]
    if meta["format"] != FORMAT:
        raise ValueError(f"format {meta['format']:.0f} of {path} is not {FORMAT}")
    if meta["parameters"] != len(rows):
        raise ValueError(f"version {version} at {path} holds {len(rows)} of {meta['parameters']:.0f} parameters")

    def listed(part: str) -> list:
        return list(parts.get(part, {}).values())

    sides = {side: parts.get(f"fence.{side}", {}) for side in ("q1", "q3", "iqr", "lower", "upper")}
    roles = Roles(*(parts.get(f"role.{kind}", {}) for kind in ("numeric", "text", "category")))
    scaler = ve.Scaler(listed("scaler.column"), listed("scaler.centre"), listed("scaler.scale"), parts["scaler"]["kind"])
    tfidf = TfIdf(listed("term"), listed("term.weight")) if "term" in parts else None
    prepared = Prepared(
        None, listed("feature"), roles, {c: {side: v[c] for side, v in sides.items()} for c in sides["lower"]}, parts.get("median", {}),
        scaler, tfidf, tuple(listed("age")) or None)
    centres = np.array([listed(f"centre.{i}") for i in range(len(listed("members")))])
    fit = km.Fit(centres, np.array(listed("members")), meta["inertia"], np.array(listed("spread")), int(meta["group"]), int(meta["rounds"]))
    return StoredModel(prepared, fit, int(meta["as_of_year"]), version)

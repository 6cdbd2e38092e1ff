"""Validating and scoring loan applications in batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import FeatureContract, LeakageError, load_contract
from ..functions import columns as fx
from ..operators import attribution
from ..operators.features import RAW_INPUT_COLUMNS, build_feature_matrix
from .model import INPUT_GROUPS, INPUTS, ScoringModel

# What an application must hold, what it may leave out, and its bounds.
REQUIRED = ("revenue", "dti_n", "loan_amnt", "fico_n", "purpose", "home_ownership_n", "addr_state", "zip_code")
NUMBERS = ("revenue", "dti_n", "loan_amnt", "fico_n")
DEFAULTS = {"experience_c": 1, "emp_length": "10+ years"}
OPTIONAL_TEXT = ("title", "desc")


@dataclass(frozen=True)
class ValidatedApplications:
    accepted: DataFrame
    rejected: DataFrame


def _errors(df: DataFrame) -> Column:
    found = []
    for c in REQUIRED:
        found.append(F.when(F.col(c).isNull(), F.lit(f"{c}: required")))
    for c in (*NUMBERS, "experience_c"):
        if c in df.columns:
            found.append(F.when(F.col(c).isNotNull() & fx.numeric(df, c).isNull(), F.lit(f"{c}: not a number")))
    revenue, amount = fx.numeric(df, "revenue"), fx.numeric(df, "loan_amnt")
    found.append(F.when(revenue < 0, F.lit("revenue: must be >= 0")))
    found.append(F.when(amount <= 0, F.lit("loan_amnt: must be > 0")))
    if "experience_c" in df.columns:
        years = fx.numeric(df, "experience_c")
        found.append(F.when(years != F.floor(years), F.lit("experience_c: not a whole number")))
    return F.array_compact(F.array(*found))


def with_errors(df: DataFrame, contract: FeatureContract | None = None, *, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Applications with defaults filled in and an ``errors`` array, empty when acceptable.

    The schema is closed: an unknown or banned column refuses the whole batch, because no
    row of it can be trusted to be an application. ``keep`` names key columns let through.
    """
    contract = contract or load_contract()
    outside = [c for c in df.columns if c not in RAW_INPUT_COLUMNS and c not in keep]
    if outside:
        raise LeakageError(f"applications hold fields that are not accepted: {sorted(outside)}")
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise KeyError(f"applications lack required fields: {missing}")
    filled = {
        c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in DEFAULTS.items()
    }
    texts = {c: F.lit(None).cast("string") for c in OPTIONAL_TEXT if c not in df.columns}
    return df.withColumns({"errors": _errors(df), **filled, **texts})


def validate_applications(
    df: DataFrame, contract: FeatureContract | None = None, *, keep: tuple[str, ...] = ("id",)
) -> ValidatedApplications:
    checked = with_errors(df, contract, keep=keep)
    fine = F.size("errors") == 0
    return ValidatedApplications(checked.where(fine).drop("errors"), checked.where(~fine))


def score_batch(
    applications: DataFrame,
    model: ScoringModel,
    *,
    version: int,
    stage: str,
    explain: bool = False,
    top_n: int = attribution.TOP_CONTRIBUTIONS,
) -> DataFrame:
    """Probability, risk band, version and stage per application; top contributors on request.

    Uses the feature expressions of training. ``id`` is carried when present.
    """
    keys = tuple(c for c in ("id",) if c in applications.columns)
    features = build_feature_matrix(applications, keep=keys)
    scored = model.score(features)
    label = {
        "default_probability": F.col("score"),
        "risk_band": fx.risk_band(F.col("score")),
        "model_version": F.lit(version),
        "model_stage": F.lit(stage),
    }
    out = scored.withColumns(label)
    if not explain:
        return out.select(*keys, *label)
    # The scored rows already hold the model inputs, so rows are scored and explained in one go.
    explained = attribution.attribute_rows(out, model.tree_tables(), INPUTS, INPUT_GROUPS, keep=[*keys, *label])
    return attribution.top_contributions(explained, top_n)

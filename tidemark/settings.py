"""Run settings. Every field can be overridden with a ``TIDEMARK_<FIELD>`` variable."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

# Thresholds and cut-off dates the results depend on.
SEED = 42
ROC_AUC_MIN = 0.67
PSI_THRESHOLD = 0.20
LATENCY_P95_MS = 300.0
TRAIN_END = "2015-12-31"
VALID_END = "2016-12-31"


@dataclass(frozen=True)
class Settings:
    seed: int = SEED
    roc_auc_min: float = ROC_AUC_MIN
    psi_threshold: float = PSI_THRESHOLD
    latency_p95_ms: float = LATENCY_P95_MS
    train_end: str = TRAIN_END
    valid_end: str = VALID_END
    model_name: str = "default-classifier"
    root: str = "data"

    @classmethod
    def from_env(cls, environ: Mapping[str, str] | None = None) -> Settings:
        environ = os.environ if environ is None else environ
        given = {}
        for f in fields(cls):
            raw = environ.get(f"TIDEMARK_{f.name.upper()}")
            if raw is not None:
                given[f.name] = type(f.default)(raw)
        return cls(**given)

    def __post_init__(self) -> None:
        if not self.train_end < self.valid_end:
            raise ValueError(f"train_end {self.train_end} must lie before valid_end {self.valid_end}")

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    @property
    def raw_csv(self) -> str:
        return self.path("raw", "loans.csv")

    @property
    def raw_parquet(self) -> str:
        return self.path("raw", "loans_raw.parquet")

    @property
    def sample_csv(self) -> str:
        return self.path("sample", "loans_sample.csv")

    @property
    def features_dir(self) -> str:
        return self.path("features")

    @property
    def reports_dir(self) -> str:
        return self.path("reports")

    @property
    def models_dir(self) -> str:
        return self.path("models")

    @property
    def ledger_dir(self) -> str:
        return self.path("ledger")

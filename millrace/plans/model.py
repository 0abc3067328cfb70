"""Intents, runtime contexts and extraction plans: immutable values, canonical JSON, fingerprints, replay checks."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime, timezone
from typing import Any

SOURCES = ("postgresql", "mysql", "sqlserver", "derby", "parquet", "csv")
TARGETS = ("parquet", "csv", "s3", "gcs")
MODES = ("full", "incremental")
STRATEGIES = ("single_pass", "range_chunking", "offset_chunking", "time_window")
SCHEDULING = ("round_robin", "greedy", "work_stealing")
PLAN_VERSION = "1.0"
_SECRET = ("password", "passwd", "secret", "token", "connection_string", "key")


class ValidationError(ValueError):
    """An intent, a context or a configuration that can't be used; the message lists every fault."""


class PlanCorruption(Exception):
    """A stored plan doesn't have its fingerprint."""


class UnsupportedPlan(Exception):
    """A stored plan is of another version."""


class NotRecommended(Exception):
    """The verdict advises against the run."""


@dataclass(frozen=True)
class Constraints:
    max_duration_seconds: int | None = None
    max_workers: int | None = None
    max_source_connections: int | None = None
    priority: int = 0


@dataclass(frozen=True)
class Intent:
    """What to extract. source_config names the table's place; secrets in it never enter a hash or a plan."""

    source_type: str
    source_config: dict[str, Any]
    object_name: str
    key: str | None = None
    mode: str = "full"
    incremental_key: str | None = None
    incremental_value: Any = None
    target_type: str = "parquet"
    target_config: dict[str, Any] = field(default_factory=dict)
    constraints: Constraints = field(default_factory=Constraints)

    def __post_init__(self):
        faults = []
        for name, value, known in (("source_type", self.source_type, SOURCES), ("target_type", self.target_type, TARGETS), ("mode", self.mode, MODES)):
            if value not in known:
                faults.append(f"{name} must be one of {', '.join(known)}")
        if self.mode == "incremental" and not self.incremental_key:
            faults.append("incremental mode needs incremental_key")
        if self.constraints.max_workers is not None and not 1 <= self.constraints.max_workers <= 64:
            faults.append("max_workers must be between 1 and 64")
        if faults:
            raise ValidationError("; ".join(faults))

    def hash(self) -> str:
        body = asdict(self)
        del body["constraints"]
        for part in ("source_config", "target_config"):
            body[part] = {k: v for k, v in body[part].items() if not any(s in k.lower() for s in _SECRET)}
        return hashlib.sha256(canonical_json(body).encode()).hexdigest()

    @property
    def object_key(self) -> str:
        return f"{self.source_type}::{self.object_name}"


@dataclass(frozen=True)
class RuntimeContext:
    """What the user says of the environment; None: no opinion."""

    max_connections: int | None = None
    max_memory_mb: int | None = None
    network: str | None = None
    load: str | None = None
    concurrent: int | None = None
    maintenance: bool | None = None
    priority: str | None = None
    target_minutes: int | None = None
    egress_mb: float | None = None
    window_minutes: int | None = None
    disk_gb: float | None = None

    _CHOICES = {"network": ("good", "degraded", "poor"), "load": ("low", "normal", "high"), "priority": ("low", "normal", "critical")}
    _LEAST = {"max_connections": 1, "max_memory_mb": 1, "concurrent": 0, "target_minutes": 1, "window_minutes": 1}

    @classmethod
    def build(cls, declared: dict[str, Any] | None = None, **flags: Any) -> RuntimeContext | None:
        """From a parsed file and flags, flags winning; None if nothing is set; all faults in one error."""
        given = {**(declared or {}), **{k: v for k, v in flags.items() if v is not None}}
        names = {f.name for f in fields(cls)}
        faults = [f"unknown field {k}" for k in sorted(set(given) - names)]
        for k, v in given.items():
            if v is None or k not in names:
                continue
            if k in cls._CHOICES and v not in cls._CHOICES[k]:
                faults.append(f"{k} must be one of {', '.join(cls._CHOICES[k])}")
            elif k in cls._LEAST and (isinstance(v, bool) or not isinstance(v, int) or v < cls._LEAST[k]):
                faults.append(f"{k} must be a whole number of at least {cls._LEAST[k]}")
            elif k == "maintenance" and not isinstance(v, bool):
                faults.append("maintenance must be true or false")
            elif k in ("egress_mb", "disk_gb") and (isinstance(v, bool) or not isinstance(v, (int, float)) or v <= 0):
                faults.append(f"{k} must be a positive number")
        if faults:
            raise ValidationError("; ".join(faults))
        kept = {k: v for k, v in given.items() if v is not None}
        return cls(**kept) if kept else None

    def to_dict(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if v is not None}


@dataclass(frozen=True)
class CostRates:
    compute_rate: float = 0.0
    egress_rate: float = 0.0
    connection_rate: float = 0.0
    currency: str = "USD"

    def __post_init__(self):
        bad = [n for n in ("compute_rate", "egress_rate", "connection_rate") if not math.isfinite(getattr(self, n)) or getattr(self, n) < 0]
        if bad:
            raise ValidationError("; ".join(f"{n} must be a finite number of at least 0" for n in bad))

    @property
    def is_zero(self) -> bool:
        return not (self.compute_rate or self.egress_rate or self.connection_rate)


@dataclass(frozen=True)
class Chunk:
    chunk_id: str
    kind: str = "full_table"
    lo: Any = None
    hi: Any = None
    est_rows: int = 0
    est_bytes: int = 0


@dataclass(frozen=True)
class Plan:
    intent_hash: str
    object_name: str
    key: str | None
    strategy: str
    chunks: tuple[Chunk, ...]
    workers: int = 1
    worker_bounds: tuple[int, int] = (1, 16)
    scheduling: str = "round_robin"
    est_rows: int = 0
    est_bytes: int = 0
    est_throughput: float = 0.0
    est_seconds: float = 0.0
    output: dict[str, Any] = field(default_factory=dict)
    rule: dict[str, Any] | None = None
    schema_hash: str | None = None
    plan_version: str = PLAN_VERSION
    plan_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    def __post_init__(self):
        lo, hi = self.worker_bounds
        faults = [m for bad, m in ((self.workers < 1, "workers must be 1 or more"), (not self.chunks, "a plan needs a chunk"), (not 1 <= lo <= hi, "worker bounds must be 1 <= low <= high"), (self.strategy not in STRATEGIES, "unknown strategy"), (self.scheduling not in SCHEDULING, "unknown scheduling")) if bad]
        if faults:
            raise ValidationError("; ".join(faults))

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Plan:
        d = dict(d)
        d["chunks"] = tuple(Chunk(**c) for c in d["chunks"])
        d["worker_bounds"] = tuple(d["worker_bounds"])
        return cls(**d)

    def dispatch(self) -> list[Chunk]:
        """Largest first under work stealing, else plan order."""
        return sorted(self.chunks, key=lambda c: -c.est_rows) if self.scheduling == "work_stealing" else list(self.chunks)

    def fingerprint(self) -> str:
        return fingerprint(self.to_dict())

    def same_work(self) -> str:
        """Fingerprint without what differs between two plans of the same work."""
        body = self.to_dict()
        del body["plan_id"], body["created_at"]
        return fingerprint(body)

    def with_workers(self, n: int) -> Plan:
        return replace(self, workers=n)

    def summary(self) -> str:
        lines = [f"{self.object_name}: {self.strategy}, {len(self.chunks)} chunks, {self.workers} workers, {self.scheduling}", f"about {self.est_rows:,} rows in {self.est_seconds:,.1f} s at {self.est_throughput:,.0f} rows/s"]
        if self.est_seconds > 1800:
            lines.append("longer than 30 minutes: a snapshot of the source stays open that long")
        return "\n".join(lines)


def _plain(x: Any) -> Any:
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else 0.0
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def canonical_json(body: dict[str, Any]) -> str:
    """One text for equal values: sorted keys, no white space, floats to six digits, list order kept."""
    return json.dumps(_plain(body), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def fingerprint(body: dict[str, Any]) -> str:
    return hashlib.sha256(canonical_json(body).encode()).hexdigest()


def load_plan(text: str, expected: str, force: bool = False) -> Plan:
    """A stored plan, after its fingerprint and version are checked; force skips the version."""
    try:
        body = json.loads(text)
    except json.JSONDecodeError as e:
        raise PlanCorruption(f"not a plan: {e}") from e
    if fingerprint(body) != expected:
        raise PlanCorruption("the stored plan was changed after it was recorded")
    if body.get("plan_version") != PLAN_VERSION and not force:
        raise UnsupportedPlan(f"plan version {body.get('plan_version')!r}; this engine reads {PLAN_VERSION}")
    return Plan.from_dict(body)


def run_id() -> str:
    return f"rx-{datetime.now():%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}"

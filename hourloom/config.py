"""Column names and tunables shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

SERIES = "series_id"
TS = "ts"
HOUR_TS = "hour_ts"
DATE = "date"
TARGET = "total_daily_consumption"

# Measure columns of the input layout, and how an hour combines them.
MEAN_MEASURES = ("Global_active_power", "Global_reactive_power", "Voltage", "Global_intensity")
SUM_MEASURES = ("Sub_metering_1", "Sub_metering_2", "Sub_metering_3")
MEASURES = MEAN_MEASURES + SUM_MEASURES

DAY_METADATA = ("day_of_week", "is_weekend", "month", "season")

# The daily columns the isolation forest looks at.
ISOLATION_FEATURES = (
    "total_daily_consumption",
    "avg_hourly_consumption",
    "consumption_volatility",
    "peak_consumption",
    "min_consumption",
)

ANOMALY_FLAGS = ("anomaly_iqr", "anomaly_zscore", "anomaly_isolation_forest", "anomaly_pattern")

# Columns that never enter the regression model.
EXCLUDED_FROM_MODEL = (
    "total_daily_consumption",
    "avg_hourly_consumption",
    "consumption_volatility",
    "peak_consumption",
    "min_consumption",
    "Global_reactive_power_mean",
    "Global_reactive_power_sum",
    "Voltage_mean",
    "Voltage_std",
    "Global_intensity_mean",
    "Global_intensity_max",
    "Sub_metering_1",
    "Sub_metering_2",
    "Sub_metering_3",
)

# Columns measured on the predicted day itself; a leak-free model must not see them.
SAME_DAY_COLUMNS = (
    "Sub_metering_1_sum",
    "Sub_metering_2_sum",
    "Sub_metering_3_sum",
    "n_hours",
    "voltage_avg",
    "cluster",
    "cluster_avg_consumption",
    "anomaly_count",
    "isolation_score",
    "is_anomaly",
) + ANOMALY_FLAGS

MAX_HORIZON_DAYS = 365
INTERVAL_Z = 1.96
REFERENCE_SIGMA = 2.626


@dataclass(frozen=True)
class GapLimits:
    """Row limits of the gap filler; `max_gap` (off) refuses to interpolate longer gaps."""

    interpolate: int = 60
    hold: int = 10
    back: int = 10
    max_gap: int | None = None


@dataclass(frozen=True)
class AnomalyConfig:
    iqr_threshold: float = 2.5
    zscore_threshold: float = 3.0
    pattern_threshold: float = 2.5
    consensus: int = 2
    contamination: float = 0.05
    trees: int = 100
    sample_size: int = 256
    seed: int = 42
    profile_slots: int = 24


@dataclass(frozen=True)
class KMeansConfig:
    restarts: int = 20
    max_iter: int = 500
    tol: float = 1e-4
    seed: int = 42
    start_rows: int = 4096
    partitions: int | None = None


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 20
    depth: int = 8
    min_leaf: int = 2
    max_bins: int = 64
    memory_mb: int = 256
    seed: int = 42
    partitions: int | None = None


# The studied settings; needs a driver and executors with room for 200 deep trees.
REFERENCE_FOREST = ForestConfig(trees=200, depth=15)


@dataclass(frozen=True)
class BoostingConfig:
    rounds: int = 200
    depth: int = 5
    step: float = 0.1
    max_bins: int = 64
    seed: int = 42


@dataclass(frozen=True)
class SeasonalConfig:
    """Order grid of the seasonal series model."""

    max_p: int = 2
    max_d: int = 1
    max_q: int = 2
    period: int = 7
    default_order: tuple[int, int, int] = (1, 1, 1)

    def orders(self) -> list[tuple[int, int, int]]:
        return [
            (p, d, q)
            for p in range(self.max_p + 1)
            for d in range(self.max_d + 1)
            for q in range(self.max_q + 1)
        ]


@dataclass(frozen=True)
class RunConfig:
    """Everything an end-to-end training run needs."""

    gaps: GapLimits = field(default_factory=GapLimits)
    anomaly: AnomalyConfig = field(default_factory=AnomalyConfig)
    kmeans: KMeansConfig = field(default_factory=KMeansConfig)
    forest: ForestConfig = field(default_factory=ForestConfig)
    clusters: int = 5
    test_size: float = 0.2
    leak_free: bool = True

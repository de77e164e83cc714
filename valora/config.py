"""Parameters of the valuation. Published ones are marked; the others are this engine's own choice."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    evidence_days: int = 365  # published: half-open window before the cutoff
    min_cases: int = 5  # published for the formal gate; also used as the least number of comparables
    case_cap: int = 20
    include_at: int = 15  # published: cases in 12 months
    reference_at: int = 8  # published
    divergence: float = 0.15  # published
    fresh_cutoff_days: int = 90  # published, inclusive
    fresh_case_days: int = 180  # published, inclusive
    verdict_n: int = 200  # published
    verdict_edge: float = 0.01  # published: one percentage point
    low_power_n: int = 30
    ridge_lambda: float = 1.0  # published range 1 to 10
    lambdas: tuple = (1.0, 3.0, 10.0)  # grid within the published range
    weights: dict = field(default_factory=lambda: {"area": 0.30, "floor": 0.15, "age": 0.15, "elevator": 0.10, "orientation": 0.05, "recency": 0.25})
    age_span: float = 20.0  # years between two buildings from which their ages count as not alike
    calibration_halves: int = 2  # half-years of errors that widths are taken from
    calibration_share: float = 0.85  # published: coverage of 80 to 90 %
    calibration_least: int = 30
    area_range: tuple = (2.0, 48.0)
    price_range: tuple = (1_000.0, 100_000.0)
    unit_range: tuple = (100.0, 20_000.0)


PARAMS = Params()
#: Dates that the registered queries use on the driver's tables.
CUTOFF, AS_OF, EARLIER_AS_OF = "2000-01-01", "2001-07-01", "2001-01-01"

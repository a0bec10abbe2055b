"""Plan-time configuration. These objects hold settings, never table data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class YearWindow:
    """Inclusive range of calendar years."""

    first: int
    last: int

    def __post_init__(self) -> None:
        if self.first > self.last:
            raise ValueError(f"first year {self.first} is after last year {self.last}")
        if self.last > date.today().year:
            raise ValueError(f"last year {self.last} lies in the future")

    @property
    def n_months(self) -> int:
        return 12 * (self.last - self.first + 1)


@dataclass(frozen=True)
class LagWindow:
    """Inclusive range of month lags used as features."""

    first: int
    last: int

    def __post_init__(self) -> None:
        if self.first < 1:
            raise ValueError("lags start at one month")
        if self.first > self.last:
            raise ValueError(f"first lag {self.first} is after last lag {self.last}")

    @property
    def lags(self) -> list[int]:
        return list(range(self.first, self.last + 1))

    def from_horizon(self, horizon: int) -> list[int]:
        """Lags still known when forecasting ``horizon`` months ahead."""
        check_horizon(horizon)
        return [lag for lag in self.lags if lag >= horizon]


@dataclass(frozen=True)
class ForecastWindow:
    """Half-open test period ``[start, end)``; everything before ``start`` trains."""

    start: date
    end: date

    def __post_init__(self) -> None:
        if self.start >= self.end:
            raise ValueError(f"empty window {self.start} .. {self.end}")

    @classmethod
    def of(cls, period) -> ForecastWindow:
        if isinstance(period, cls):
            return period
        if len(period) != 2:
            raise ValueError("a test period is one start and one end")
        return cls(*(date.fromisoformat(str(day)) for day in period))


def half_years(first: date, count: int) -> list[ForecastWindow]:
    """``count`` consecutive six-month windows; ``first`` is a first of month."""

    def shifted(months: int) -> date:
        index = first.year * 12 + first.month - 1 + months
        return date(index // 12, index % 12 + 1, 1)

    return [ForecastWindow(shifted(6 * k), shifted(6 * (k + 1))) for k in range(count)]


def check_horizon(horizon: int) -> int:
    if isinstance(horizon, bool) or not isinstance(horizon, int) or horizon < 1:
        raise ValueError(f"horizon must be a positive int, got {horizon!r}")
    return horizon


# Fixed value: the one series that has a file format of its own.
ELECTRICITY = "Electricity"


def driver_name(name: str) -> str:
    """Series are known by their name in capitals, electricity by its own."""
    return ELECTRICITY if name.lower() == ELECTRICITY.lower() else name.upper()


@dataclass(frozen=True)
class JobRequest:
    """What one feature run needs, as parsed from a JSON job request."""

    driver_years: YearWindow
    price_years: YearWindow
    lags: LagWindow
    drivers: tuple[str, ...]
    target: str
    rm_codes: tuple[str, ...]
    ledger_path: str
    electricity_path: str | None = None

    def __post_init__(self) -> None:
        if not self.drivers:
            raise ValueError("at least one driver is required")
        if not self.rm_codes:
            raise ValueError("at least one material code is required")
        if len(set(self.drivers)) != len(self.drivers):
            raise ValueError("drivers are listed twice")
        if len(set(self.rm_codes)) != len(self.rm_codes):
            raise ValueError("material codes are listed twice")

    @classmethod
    def from_dict(cls, request: Mapping) -> JobRequest:
        """Parse a request, naming every absent field at once.

        Years and lags may arrive as text; driver names in any case.
        """
        # The fields of a job request.
        spans = {
            "external_driver_duration": ("start_year", "end_year"),
            "material_price_duration": ("start_year", "end_year"),
            "feature_duration": ("start_month", "end_month"),
        }
        plain = ("external_driver", "material_price_file", "target", "rm_code")
        absent = [name for name in (*spans, *plain) if request.get(name) is None]
        for name, bounds in spans.items():
            block = request.get(name) or {}
            absent += [f"{name}.{b}" for b in bounds if name not in absent and block.get(b) is None]
        drivers = [driver_name(d) for d in request.get("external_driver") or ()]
        if ELECTRICITY in drivers and request.get("electricity_file") is None:
            absent.append("electricity_file")
        if absent:
            raise ValueError(f"missing or invalid: {', '.join(absent)}")

        def bounds_of(name: str) -> tuple[int, int]:
            low, high = spans[name]
            return int(request[name][low]), int(request[name][high])

        return cls(
            driver_years=YearWindow(*bounds_of("external_driver_duration")),
            price_years=YearWindow(*bounds_of("material_price_duration")),
            lags=LagWindow(*bounds_of("feature_duration")),
            drivers=tuple(drivers),
            target=request["target"].lower(),
            rm_codes=tuple(request["rm_code"]),
            ledger_path=request["material_price_file"],
            electricity_path=request.get("electricity_file"),
        )

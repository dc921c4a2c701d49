"""The state of a view: what is selected, as a value that goes to and from flat parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from urllib.parse import parse_qsl, urlencode

METRICS = ("first_party", "party_share", "turnout", "margin", "dominant_block", "swing_compare", "delta_turnout", "volatility", "dominance_changes", "concentration", "over_performance_province", "over_performance_region", "stability_index", "custom_indicator")
MOST_COMPARED = 4


@dataclass(frozen=True)
class ViewState:
    """K07. ``group_mode`` follows the metric where that asks for one (P14): shares and swings are of raw parties, dominance
    is of blocs. A metric that isn't known counts as turnout."""

    election: str | None = None
    compare_election: str | None = None
    metric: str = "turnout"
    group_mode: str = "party_raw"
    party: str | None = None
    territorial_mode: str | None = "historical"
    provinces: tuple[str, ...] = ()
    municipality: str | None = None
    compare_municipalities: tuple[str, ...] = ()
    completeness: str = "all"
    territorial_status: str = "all"
    min_share: float | None = None
    sort: str | None = None
    page: int = 1

    def normalised(self) -> ViewState:
        metric = self.metric if self.metric in METRICS else "turnout"
        mode = "party_raw" if metric in ("party_share", "swing_compare") else "bloc" if metric == "dominant_block" else self.group_mode or "party_raw"
        return replace(self, metric=metric, group_mode=mode, compare_municipalities=self.compare_municipalities[:MOST_COMPARED])

    def params(self) -> dict[str, str]:
        """Lists joined by pipes; what is null or empty is left out."""
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        return {k: "|".join(v) if isinstance(v, tuple) else str(v) for k, v in out.items() if v is not None and v != () and v != ""}

    def query(self) -> str:
        return urlencode(self.params())

    @classmethod
    def of(cls, params: Mapping[str, str] | str) -> ViewState:
        given = dict(parse_qsl(params)) if isinstance(params, str) else dict(params)
        read = {"provinces": lambda x: tuple(x.split("|")), "compare_municipalities": lambda x: tuple(x.split("|")), "page": int, "min_share": float}
        return cls(**{f.name: read.get(f.name, str)(given[f.name]) for f in fields(cls) if given.get(f.name)}).normalised()

"""Domain parameters: which columns play key / target / category roles."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class PanelSpec:
    key: str = "player_pk"
    target: str = "gross_annual_eur"
    league: str = "league_name"
    position: str = "position"
    club: str = "club_name"
    nationality: str = "nationality"
    name: str = "short_name"
    long_name: str = "long_name"
    age: str = "age"
    overall: str = "overall"
    activity: str = "appearances"
    season: str = "season"
    foot: str = "preferred_foot"
    low: str = "predicted_low_eur"
    high: str = "predicted_high_eur"
    center: str = "predicted_center_eur"
    # eligibility: target > 0, activity >= min_activity, league in leagues
    min_activity: float = 2.0
    leagues: tuple = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD")
    # raw numeric model inputs (order is the feature order before derived ones)
    base_features: tuple = (
        "age", "overall", "international_reputation", "value_eur",
        "appearances", "minutes", "goals", "assists", "rating", "market_value_eur",
    )
    # derived features appended in this order by engineer_features
    derived_features: tuple = (
        "log_value_eur", "log_market_value", "goals_per_90", "assists_per_90",
        "goal_contributions", "age_squared", "overall_x_reputation",
        "value_per_overall", "market_to_value_ratio",
    )
    position_categories: tuple = ("Attacker", "Defender", "Goalkeeper", "Midfielder")
    admin_columns: tuple = ("id", "player_id", "player_url", "scrape_date", "fifa_update_date")

    def with_(self, **kw) -> "PanelSpec":
        return replace(self, **kw)

    @property
    def dummy_columns(self) -> list[str]:
        """pos_* dummies: alphabetical categories with the first dropped."""
        return [f"pos_{c}" for c in sorted(self.position_categories)[1:]]

    @property
    def feature_columns(self) -> list[str]:
        return (list(self.base_features) + [self.foot + "_code"] + self.dummy_columns
                + list(self.derived_features))


def default_spec() -> PanelSpec:
    return PanelSpec()

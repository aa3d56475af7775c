"""What the statistics decide about columns: plain data, made before any lazy plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field

from lathe.operators.profile import Profile
from lathe.options import Options


@dataclass(frozen=True)
class FeaturePlan:
    """Columns to drop and to derive. Names of derived columns follow from `features.date_parts`."""

    target: str
    dropped_ids: list[str] = field(default_factory=list)
    dates: dict[str, str | None] = field(default_factory=dict)  # column: format (None for typed ones)
    with_hour: list[str] = field(default_factory=list)
    dropped_constant: list[str] = field(default_factory=list)
    time_column: str | None = None
    group_column: str | None = None


def ids_to_drop(profile: Profile, options: Options) -> list[str]:
    """Id-like columns but those that the run needs for order or groups."""
    if not options.auto_drop_id_columns:
        return []
    kept = {options.time_column} | (set() if options.strict_compat else {options.group_column})
    return [c for c in profile.named("id_like") if c not in kept]


def dates_to_expand(profile: Profile, options: Options) -> dict[str, str | None]:
    if not options.auto_datetime_features:
        return {}
    protected = {options.time_column} if options.split_strategy == "time" else set()
    return {c.name: c.datetime_format for c in profile.columns if c.kind == "datetime" and c.name not in protected}

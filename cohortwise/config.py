"""Parameters of an analysis cohort."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Study calendar and observation rules.
STUDY_START = date(2017, 11, 30)
GRACE_DAYS = 28
BIWEEK = 14
STREAMS = ("active", "phone", "fitbit")
STREAM_LABELS = {"active": "Phone-Active", "phone": "Phone-Passive", "fitbit": "Fitbit-Passive"}
SURVEY_TYPES = ("PHQ8", "RSES")
PASSIVE_TYPES = {"phone": "Passive_phone", "fitbit": "Passive_Fitbit"}
RSES_MAX = 30


@dataclass(frozen=True)
class Cohort:
    """One observation window and the choices that go with it.

    ``day_offset`` gives, per stream, the number added to the day difference
    when a duration is computed. ``episodes`` maps a stream to the cut points
    and the covariate whose effect may change at them. ``members_only`` keeps
    only participants who could have been observed for the whole window. ``relevel``
    gives the level order of a covariate in the episode models.
    """

    name: str
    horizon: int
    biweeks: int
    clusters: int
    score_statistic: str
    day_offset: dict[str, int] = field(default_factory=dict)
    episodes: dict[str, tuple[tuple[int, ...], str]] = field(default_factory=dict)
    relevel: dict[str, tuple[str, ...]] = field(default_factory=dict)
    members_only: bool = False
    with_contacts: bool = True
    merge_categories: bool = True
    numeric_phone_status: bool = False

    @property
    def grace(self) -> int:
        return self.horizon + GRACE_DAYS


COHORT_1 = Cohort(
    name="cohort_1",
    horizon=301,
    biweeks=22,
    clusters=3,
    score_statistic="median",
    episodes={"phone": ((130, 240), "sex")},
    relevel={"sex": ("male", "female")},
)
COHORT_2 = Cohort(
    name="cohort_2",
    horizon=660,
    biweeks=48,
    clusters=4,
    score_statistic="mean",
    day_offset={"active": 1},
    episodes={"active": ((320,), "age_band"), "fitbit": ((450,), "children_cat")},
    members_only=True,
    with_contacts=False,
    merge_categories=False,
    numeric_phone_status=True,
    relevel={"age_band": ("30-39", "40-49", "50-59", ">60", "<30"), "children_cat": ("Yes", "No")},
)

"""Study parameters: every date, threshold and rate an operator needs, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

# Fixed values.
IDR_TO_USD = 1.0 / 14150
LOCAL_UTC_OFFSET_HOURS = 9
MIN_K_ANON = 5
MB = 1_000_000.0
GB = 1_000_000_000.0
UNKNOWN_NO_DNS = "Unknown (No DNS)"
UNKNOWN_NOT_MAPPED = "Unknown (Not Mapped)"
PEER_TO_PEER = "Peer to Peer"
ICE = "ICE (STUN/TURN)"
NO_USER = "[None]"


@dataclass(frozen=True)
class StudyParams:
    min_date: datetime
    max_date: datetime
    outage_start: datetime
    outage_end: datetime
    exploit_start: datetime
    exploit_end: datetime
    lockdown: datetime
    idr_to_usd: float = IDR_TO_USD
    k_anonymity: int = MIN_K_ANON
    # Ledger rows from this moment on are ignored when early balances are inferred.
    ledger_cutoff: datetime | None = None
    # First moment of the "before" comparison period; None means symmetric around the lockdown.
    compare_start: datetime | None = None

    @property
    def study_seconds(self) -> float:
        return (self.max_date - self.min_date).total_seconds()

    @property
    def before_start(self) -> datetime:
        return self.compare_start or self.lockdown - (self.max_date - self.lockdown)

    def with_(self, **changes) -> "StudyParams":
        return replace(self, **changes)


# The calendar of the original study.
STUDY_2019 = StudyParams(
    min_date=datetime(2019, 3, 10),
    max_date=datetime(2019, 3, 10) + timedelta(weeks=100),
    outage_start=datetime(2019, 7, 30),
    outage_end=datetime(2019, 9, 1),
    exploit_start=datetime(2020, 5, 24),
    exploit_end=datetime(2020, 6, 11),
    lockdown=datetime(2020, 4, 1),
    ledger_cutoff=datetime(2020, 3, 1),
    compare_start=datetime(2019, 8, 7),
)

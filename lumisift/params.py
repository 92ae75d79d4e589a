"""Parameters of a library query and of a run, immutable and checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import ClassVar

#: The criteria in the order in which matches are listed.
CRITERIA = (
    "noFace", "hasFace", "screenshot", "document", "blurry", "dark", "bright",
    "duplicates", "longVideo", "largeFile", "dateRange", "withPerson", "withoutPerson",
)
#: The orders, and which side inputs an order needs.
ORDERS = ("suspicion", "noPeople", "rarePeople", "similar", "biggest", "blurry", "dark", "oldest", "newest")
KEEPERS = ("sharpest", "first", "last", "none")
LENSES = ("all", "photo", "video")
#: Choices offered for a date window (months) and for a run's limit (0: none).
DATE_PRESETS, LIMIT_PRESETS = (6, 12, 36, 60), (0, 500, 2_000, 10_000)
#: The span offered for the people distance.
EPS_RANGE = (0.45, 0.75)


@dataclass(frozen=True)
class QueryParams:
    """What to look for. Times are epoch milliseconds."""

    enabled: frozenset[str] = frozenset()
    no_face_max: float = 0.35
    no_face_max_skin: float = 0.05
    has_face_min: float = 0.55
    screenshot_min: float = 0.55
    document_min: float = 0.55
    blur_min: float = 0.6
    dark_min: float = 0.6
    bright_min: float = 0.6
    dup_distance: int = 8
    dup_window: int = 80
    dup_keep: str = "sharpest"
    long_video_sec: int = 120
    large_file_mb: int = 20
    date_from: int | None = None
    date_to: int | None = None
    person_ids: tuple[int, ...] = ()
    sort: str = "suspicion"
    mode: str = "any"
    lens: str = "all"
    hide_kept: bool = True

    def __post_init__(self):
        object.__setattr__(self, "enabled", frozenset(self.enabled))
        if unknown := self.enabled - set(CRITERIA):
            raise ValueError(f"unknown criteria: {sorted(unknown)}")
        if self.mode not in ("any", "all"):
            raise ValueError(f"mode is any or all, not {self.mode}")
        if self.dup_keep not in KEEPERS:
            raise ValueError(f"unknown keeper: {self.dup_keep}")
        if self.dup_window < 1 or self.large_file_mb < 1:
            raise ValueError("dup_window and large_file_mb are 1 at least")
        if self.sort not in ORDERS:
            object.__setattr__(self, "sort", "suspicion")
        if self.lens not in LENSES:
            object.__setattr__(self, "lens", "all")

    def reset(self, *names: str) -> QueryParams:
        """Back to the defaults, of all fields or of those named."""
        return replace(self, **{f.name: f.default for f in fields(self) if f.name in names}) if names else QueryParams()

    def toggle_person(self, person: int) -> QueryParams:
        """Select or drop a person: the first one switches the criterion on, the last one switches both off."""
        chosen = tuple(p for p in self.person_ids if p != person) if person in self.person_ids else (*self.person_ids, person)
        enabled = self.enabled
        if not chosen:
            enabled = enabled - {"withPerson", "withoutPerson"}
        elif not self.person_ids and "withoutPerson" not in enabled:
            enabled = enabled | {"withPerson"}
        return replace(self, person_ids=chosen, enabled=enabled)

    def blocked(self, has_groups: bool, has_model: bool = True) -> tuple[QueryParams, dict[str, str]]:
        """Without the people criteria that can't be answered, and why."""
        reason = "no recognition model" if not has_model else "no groups" if not has_groups else "no person selected" if not self.person_ids else None
        if reason is None:
            return self, {}
        dropped = self.enabled & {"withPerson", "withoutPerson"}
        return replace(self, enabled=self.enabled - dropped), {c: reason for c in ("withPerson", "withoutPerson")}


@dataclass(frozen=True)
class RunParams:
    """How a listing and analysis run behaves."""

    max_per_run: int = 0
    older_than: int | None = None
    resume: bool = True
    page_size: int = 500
    info_chunk: int = 200
    trash_chunk: int = 100
    eps: float = 0.75
    thumb_size: int = 256
    barren_pages: int = 6
    hide_kept: bool = True
    extra: dict = field(default_factory=dict, compare=False)

    #: Older settings that are dropped; the first two were limits.
    RETIRED: ClassVar[tuple[str, ...]] = (
        "scanMaxPerPass", "analyzeMaxPerPass", "scanSinceTs", "scanStepRatio", "scanSettleMaxMs", "thumbWaitMaxMs", "autoRepairThumbs",
        "autoRepairLimit", "scanZoom", "lastTilesPerStep", "lastWaitSplit", "lastThumbRatio", "lastRunStarved",
    )

    @classmethod
    def migrate(cls, stored: dict) -> RunParams:
        """From stored settings: without a limit, the stricter of the two older ones; retired and unknown keys dropped."""
        known = {f.name for f in fields(cls)} - {"extra"}
        kept = {k: v for k, v in stored.items() if k in known}
        limits = [int(stored[k]) for k in cls.RETIRED[:2] if isinstance(stored.get(k), (int, float)) and stored[k] > 0]
        if kept.get("max_per_run") is None:
            kept["max_per_run"] = min(limits, default=0)
        return cls(**kept)

"""The four macros, targets and preferences."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Order in which macros are added up; it decides the last bits of sums of doubles.
MACROS = ("calories", "protein", "fat", "carbs")


@dataclass(frozen=True)
class Target:
    """Wanted totals of a meal."""

    calories: float
    protein: float
    fat: float
    carbs: float

    def __post_init__(self):
        for m in MACROS:
            if not self[m] == self[m] or abs(self[m]) == float("inf"):
                raise ValueError(f"the target for {m} is not a number")

    def __getitem__(self, macro: str) -> float:
        return getattr(self, macro)

    def scaled(self, gap: dict[str, float]) -> Target:
        return Target(**gap)


@dataclass(frozen=True)
class Preference:
    """How much a macro counts (0: not at all), and whether a meal may exceed it."""

    weight: float = 1.0
    overflow: str = "strict"

    def __post_init__(self):
        if self.weight < 0 or self.overflow not in ("strict", "allowed"):
            raise ValueError("weight must be 0 or more, overflow strict or allowed")

    @property
    def binding(self) -> bool:
        return self.overflow == "strict" and self.weight > 0

    @classmethod
    def from_percent(cls, percent: int) -> Preference:
        """A slider's setting of 0 to 150 in tens: above 100 the macro may overflow."""
        if not 0 <= percent <= 150 or percent % 10:
            raise ValueError("percent must be 0 to 150 in tens")
        return cls(percent / 100, "allowed" if percent > 100 else "strict")


@dataclass(frozen=True)
class Preferences:
    calories: Preference = field(default_factory=Preference)
    protein: Preference = field(default_factory=Preference)
    fat: Preference = field(default_factory=Preference)
    carbs: Preference = field(default_factory=Preference)

    def __getitem__(self, macro: str) -> Preference:
        return getattr(self, macro)

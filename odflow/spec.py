"""Plain settings: an edition of the survey and the limits of disclosure control."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Least sample persons and households of a published cell, and least persons for its detail."""

    persons: int = 5
    psus: int | None = 3
    detail: int = 20
    base: int = 5

    @classmethod
    def of(cls, has_psu: bool) -> "Limits":
        """Without household ids the person floors stand in for the household floor."""
        return cls() if has_psu else cls(20, None, 50)


@dataclass(frozen=True)
class EditionSpec:
    name: str
    wage: float
    has_psu: bool = True
    asks_commuting: bool = True

    @property
    def limits(self) -> Limits:
        return Limits.of(self.has_psu)


#: Lower bounds of the published bands of sample counts.
BANDS = (5, 20, 50, 100, 500)

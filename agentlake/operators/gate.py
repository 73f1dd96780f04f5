"""The verification gate: checks in tiers by cost over rejection rate; a tier runs whole, then may stop the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

PASS, RETRY, QUARANTINE, HARD_REJECT = "Pass", "Retry", "Quarantine", "HardReject"
_WORST = (PASS, RETRY, QUARANTINE, HARD_REJECT)


@dataclass(frozen=True)
class Finding:
    check: str
    status: str
    detail: str = ""
    #: ``exact`` findings may ask for another try; ``heuristic`` ones may only hold the branch.
    certainty: str = "exact"


@dataclass(frozen=True)
class Check:
    """``run`` gets the merge's facts and gives findings; cheap checks that often reject come first."""

    name: str
    run: Callable[[dict], list[Finding]]
    cost: float
    rejection_rate: float
    tier: int = 0


def evaluate(checks: list[Check], facts: dict) -> tuple[str, list[Finding]]:
    """(worst status, findings)."""
    by_tier: dict[int, list[Check]] = {}
    for c in checks:
        by_tier.setdefault(c.tier, []).append(c)
    order = sorted(by_tier.values(), key=lambda t: min(c.cost / max(c.rejection_rate, 1e-9) for c in t))
    found: list[Finding] = []
    for tier in order:
        for check in tier:
            found += check.run(facts)
        if any(f.status != PASS for f in found):
            break
    return max((f.status for f in found), key=_WORST.index, default=PASS), found

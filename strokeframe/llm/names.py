"""Column names that do not clash, whatever the case, as Spark does not tell cases apart."""

from __future__ import annotations

from collections.abc import Iterable


def others(columns: Iterable[str], *replaced: str) -> list[str]:
    """``columns`` without those that are named as one of ``replaced``."""
    gone = {c.lower() for c in replaced}
    return [c for c in columns if c.lower() not in gone]


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """A name that is not among ``columns`` for each of ``wanted``: the name itself, or with underscores in front."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out

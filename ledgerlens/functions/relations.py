"""Dependency relations as bits of an integer column."""

from __future__ import annotations

WW, WR, RW, WWP, WRP, RWP, PROCESS, REALTIME = (1 << i for i in range(8))
BITS = {"ww": WW, "wr": WR, "rw": RW, "wwp": WWP, "wrp": WRP, "rwp": RWP, "process": PROCESS, "realtime": REALTIME}
NAMES = {v: k for k, v in BITS.items()}
ANY_RW = RW | RWP
ANY_WR = WR | WRP
ANY_WW = WW | WWP
DATA = ANY_WW | ANY_WR

#: The relation that explains an edge with several of them, by kind of history; orders come last.
PRIORITY = {
    "list": (WW, WR, RW, WWP, WRP, RWP, REALTIME, PROCESS),
    "register": (WR, WW, RW, WWP, WRP, RWP, REALTIME, PROCESS),
    "monotonic": (WW, WR, RW, WWP, WRP, RWP, REALTIME, PROCESS),
    "predicate": (WW, WWP, WR, WRP, RW, RWP, REALTIME, PROCESS),
}


def mask(*names: str) -> int:
    out = 0
    for n in names:
        out |= BITS[n]
    return out


def names(rels: int) -> list[str]:
    return [n for n, b in BITS.items() if rels & b]


def explained(rels: int, kind: str = "list") -> int:
    """The one bit that explains an edge (0 if it has none)."""
    return next((b for b in PRIORITY[kind] if rels & b), 0)

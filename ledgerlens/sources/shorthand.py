"""Compact spelling of transactions: 'ax1rx12' appends 1 to x and reads [1 2] from x.

list: a append, r read (digits are the elements, none is null). register: w write, r read (one digit, _ is null).
"""

from __future__ import annotations

import re
from typing import Any

from .history import mop


def list_txn(text: str, **op: Any) -> dict:
    value = []
    for f, k, digits in re.findall(r"([ar])([a-z])(\d*)", text):
        value.append(mop("append", k, v=int(digits)) if f == "a" else mop("r", k, vs=[int(d) for d in digits] if digits else None))
    return {"type": "ok", "process": 0, "f": "txn", "value": value} | op


def register_txn(text: str, **op: Any) -> dict:
    value = [mop(f, k, v=None if d == "_" else int(d)) for f, k, d in re.findall(r"([wr])([a-z])(\d|_)", text)]
    return {"type": "ok", "process": 0, "f": "txn", "value": value} | op


def pair(op: dict) -> list[dict]:
    """The invocation, with reads not known yet, and the completion."""
    return [op | {"type": "invoke", "value": [mop(m.f, m.k) if m.f == "r" else m for m in op["value"]]}, op]

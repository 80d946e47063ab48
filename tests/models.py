"""Literal sequential forms of the order-dependent rules, to test against."""

from __future__ import annotations


def leaders(rows: list[tuple[int, int]], t: int) -> dict[int, int]:
    """``rows`` is ``(hash, pos)`` in order; returns follower -> leader."""
    taken: dict[int, int] = {}
    for i, (h, p) in enumerate(rows):
        if p in taken:
            continue
        for h2, p2 in rows[i + 1:]:
            if p2 not in taken and ((h ^ h2) & (2 ** 64 - 1)).bit_count() <= t:
                taken[p2] = p
    return taken


def best(files: list[dict]) -> dict:
    """Walk a group in order and keep the better file."""
    kept = files[0]
    for f in files[1:]:
        if f["size"] > kept["size"]:
            kept = f
        elif f["size"] == kept["size"]:
            if f["date"] is not None and kept["date"] is not None and f["date"] > kept["date"]:
                kept = f
    return kept


def conflicts(dests: list[str], existing: set[str]) -> list[bool]:
    seen: set[str] = set()
    out = []
    for d in dests:
        out.append(d in seen or d in existing)
        seen.add(d)
    return out


def execute(rows: list[tuple[str, bool]], existing: set[str]) -> list[str]:
    """``rows`` is ``(destination, source exists)`` in order."""
    there = set(existing)
    out = []
    for dest, has_source in rows:
        if dest in there:
            out.append("skipped")
        elif not has_source:
            out.append("failed")
        else:
            there.add(dest)
            out.append("moved")
    return out


def signed(value: int) -> int:
    return value - 2 ** 64 if value >= 2 ** 63 else value

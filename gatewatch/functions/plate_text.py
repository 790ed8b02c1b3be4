"""plates.correct for one text at a time, for SQL functions and for votes, which make texts that no column holds."""

from __future__ import annotations

import re
from itertools import product

from . import plates as P

_REGIONS = frozenset(P.REGIONS)
_LETTERS, _DIGITS = str.maketrans(*P.DIGITS_AS_LETTERS), str.maketrans(*P.LETTERS_AS_DIGITS)


def normalized(text: str | None) -> str:
    return re.sub("[^A-Z0-9]", "", (text or "").strip().upper())


def known(text: str) -> bool:
    """A well-formed plate of a known region and a number other than zero."""
    m = re.fullmatch(P.PLATE[1:-1], text)
    return bool(m and m[1] in _REGIONS and m[2].strip("0"))


def once(values) -> list[str]:
    return list(dict.fromkeys(values))


def readings(text: str) -> list[tuple[int, str]]:
    """Changes and text of every plate that undoing confusions makes of the text, the fewest changes first, then the longest."""
    m = re.fullmatch(P.SPLIT[1:-1], text)
    if not m:
        return []
    region, number, series = m.groups()
    regions = [region] if region in _REGIONS else once(r for r in (region.translate(_LETTERS), *(region if len(region) == 2 else "")) if r in _REGIONS)
    numbers = once(n.lstrip("0") for n in (number.translate(_DIGITS), number) if re.fullmatch("[0-9]+", n) and n.strip("0"))
    every = once(s for s in (series.translate(_LETTERS), series) if re.fullmatch("[A-Za-z]+", s)) if series else [""]
    made = [c for c in map("".join, product(regions, numbers, every)) if re.fullmatch(P.PLATE[1:-1], c)]
    cost = lambda c: sum(a != b for a, b in zip(text, c)) if len(c) == len(text) else abs(len(text) - len(c)) + 2
    return sorted(((cost(c), c) for c in made), key=lambda x: (x[0], -len(x[1])))


def correct(raw: str | None) -> dict:
    """original, corrected, valid, penalty, candidates."""
    text = normalized(raw)
    out = {"original": text, "corrected": text, "valid": False, "penalty": 0.0, "candidates": []}
    if not 2 <= len(text) <= 9 or not re.search("[A-Z]", text) or not re.search("[0-9]", text) or re.match("[0-9]{3}", text):
        return out
    if known(text):
        plain = re.sub("^([A-Z]{1,2})0+([1-9])", r"\1\2", text)
        return out | {"corrected": plain, "valid": True, "penalty": 0.0 if plain == text else 0.1, "candidates": [plain]}
    found = readings(text)
    if not found:
        return out
    cost, best = found[0]
    return out | {"corrected": best, "valid": cost <= 2 and cost / len(text) <= 0.40, "penalty": cost / len(text), "candidates": [c for _, c in found[:5]]}


def valid(text: str) -> bool:
    return correct(text)["valid"]

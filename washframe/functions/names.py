"""Column-name standardisation rule (pure Python over the schema, no data pass)."""

from __future__ import annotations

import re

_WORD = re.compile(r"\w+")


def standard_name(name: str) -> str:
    """The name's words (letters, digits, underscores) in lower case, joined by one
    underscore; anything else only separates. ``col_`` goes before a name that
    would be empty or start with a digit."""
    joined = "_".join(_WORD.findall(str(name))).lower()
    parts = joined.split("_")
    # inner runs of underscores are one separator; one at either end stays
    inner = [p for p in parts[1:-1] if p]
    short = "_".join([parts[0], *inner, parts[-1]]) if len(parts) > 1 else joined
    return short if short[:1] and not short[0].isdigit() else f"col_{short}"


def standard_names(names: list[str]) -> dict[str, str]:
    """Rename map; equal results get ``_2``, ``_3`` suffixes so Spark stays unambiguous."""
    return dict(zip(names, standard_name_list(names)))


def standard_name_list(names: list[str]) -> list[str]:
    """New names by position (names may repeat or differ in case only)."""
    taken: set[str] = set()
    out: list[str] = []
    for name in names:
        base = standard_name(name)
        new, k = base, 1
        while new in taken:
            k += 1
            new = f"{base}_{k}"
        taken.add(new)
        out.append(new)
    return out

"""Text helpers shared by the operators on documents."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return [w.lower() for w in WORD.findall(text)]

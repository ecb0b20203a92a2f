"""The grammar of option strings: parts between commas, each a key, then items with separators."""

from __future__ import annotations

import re
from dataclasses import dataclass

SEPARATOR = re.compile("(!=|=|:)")


@dataclass(frozen=True)
class Part:
    """``key``, then ``items``, each after the separator of the same place."""

    text: str
    key: str
    separators: tuple[str, ...]
    items: tuple[str, ...]

    def wrong(self, wanted: str) -> ValueError:
        return ValueError(f"cannot read {self.text!r}: {wanted} is wanted")


def parts(spec: str | None) -> list[Part]:
    """The parts of an option string; none for ``None`` or an empty one."""
    found = []
    for text in spec.split(",") if spec else []:
        key, *rest = SEPARATOR.split(text)
        part = Part(text, key, tuple(rest[0::2]), tuple(rest[1::2]))
        if not key or not part.items or not all(part.items):
            raise part.wrong("a key with values")
        found.append(part)
    return found


def condition(part: Part) -> tuple[str, bool, str]:
    """``key=value`` or ``key!=value`` as key, whether negated, value."""
    if part.separators not in (("=",), ("!=",)):
        raise part.wrong("key=value or key!=value")
    return part.key, part.separators[0] == "!=", part.items[0]


def swaps(part: Part) -> list[tuple[str, str, str]]:
    """``key:A=B`` (any number of pairs, ``:`` and ``=`` alike) as key, from, to."""
    if "!=" in part.separators or len(part.items) % 2:
        raise part.wrong("key:A=B")
    return [(part.key, a, b) for a, b in zip(part.items[0::2], part.items[1::2])]


def chance(part: Part) -> tuple[str, str, float]:
    """``key=value:probability``."""
    try:
        share = float(part.items[-1])
    except ValueError:
        share = -1.0
    if part.separators != ("=", ":") or not 0 <= share <= 1:
        raise part.wrong("key=value:probability")
    return part.key, part.items[0], share

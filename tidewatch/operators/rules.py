"""Rules as driver-side values: what to look for and what to do on a hit."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from tidewatch.functions.regex import group_number, optional_groups, quote, to_jvm
from tidewatch.operators.actions import Action
from tidewatch.operators.conditions import Condition

PATTERN_TYPES = ("substring", "regex", "inactivity")


@dataclass(frozen=True)
class LogRule:
    """Look for ``pattern`` in new log text. ``match_once`` keeps the first hit of each chunk."""

    name: str
    pattern: str = ""
    pattern_type: str = "substring"
    action: Action | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    condition: Condition | None = None
    extract_groups: dict[str, int | str] = field(default_factory=dict)
    match_once: bool = True
    source = "log"

    def __post_init__(self) -> None:
        if self.pattern_type not in PATTERN_TYPES:
            raise ValueError(f"pattern_type must be one of {PATTERN_TYPES}, not {self.pattern_type!r}")
        if self.pattern_type != "inactivity":
            re.compile(self.python_pattern)

    @property
    def python_pattern(self) -> str:
        return self.pattern if self.pattern_type == "regex" else re.escape(self.pattern)

    @property
    def jvm_pattern(self) -> str:
        return to_jvm(self.pattern) if self.pattern_type == "regex" else quote(self.pattern)

    def groups(self) -> dict[str, int]:
        """Extracted keys with their group numbers; unknown groups are left out."""
        resolved = {}
        for key, group in self.extract_groups.items():
            number = 0 if group == "match" else group_number(self.python_pattern, group)
            if number is not None:
                resolved[key] = number
        return resolved

    def optional(self) -> set[int]:
        return optional_groups(self.python_pattern)


@dataclass(frozen=True)
class StateRule:
    """React to a status change; None on either side stands for any status."""

    name: str
    old: str | None = None
    new: str | None = None
    action: Action | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    condition: Condition | None = None
    source = "state"


def active(rules: list[Any]) -> list[tuple[int, Any]]:
    """Rules with an action, each with its place in the full list."""
    return [(idx, rule) for idx, rule in enumerate(rules) if rule.action is not None]

"""Job definitions, as JSON or plain dicts, turned into rules and conditions. Runs on the driver."""

from __future__ import annotations

import json
from typing import Any

from tidewatch.operators import conditions as c
from tidewatch.operators.actions import Action
from tidewatch.operators.lifecycle import Spec
from tidewatch.operators.rules import LogRule, StateRule


def _loaded(value: Any) -> Any:
    return json.loads(value) if isinstance(value, str) else value


def condition_from(value: Any) -> c.Condition | None:
    """Condition tree of a definition; a class that is not built in must have been registered."""
    value = _loaded(value)
    if not value:
        return None
    fields = {k: v for k, v in value.items() if k != "class_name"}
    flags = {k: bool(fields.pop(k, False)) for k in ("persistent_pass", "persistent_fail")}
    name = value["class_name"]
    if name in ("CompositeCondition", "AndCondition", "OrCondition"):
        mode = {"AndCondition": "all", "OrCondition": "any"}.get(name) or fields.get("mode", "all")
        children = tuple(condition_from(child) for child in fields.get("conditions") or ())
        return c.Composite(mode=mode, conditions=children, **flags)
    if name == "NotCondition":
        return c.Not(condition=condition_from(fields["condition"]), **flags)
    if name == "MetadataCondition" and fields.get("within") is not None:
        fields["within"] = tuple(fields["within"])
    if name == "CooldownCondition":
        fields.pop("note", None)
    if name in SIMPLE:
        return SIMPLE[name](**fields, **flags)
    return c.Custom(kind=name, options=fields, **flags)


# The class names definitions use.
SIMPLE = {
    "AlwaysTrueCondition": c.AlwaysTrue,
    "MaxAttemptsCondition": c.MaxAttempts,
    "CooldownCondition": c.Cooldown,
    "TimeoutCondition": c.Timeout,
    "MetadataCondition": c.Metadata,
    "FileExistsCondition": c.FileExists,
    "GlobExistsCondition": c.GlobExists,
    "FileContentCondition": c.FileContent,
}


def action_from(value: Any) -> Action | None:
    value = _loaded(value)
    if not value:
        return None
    config = value.get("job_config")
    return Action(
        value["class_name"],
        text=next((value[k] for k in ("message", "reason") if value.get(k) is not None), None),
        level=value.get("level") or "info",
        job_config=config if config is None or isinstance(config, str) else json.dumps(config),
    )


def spec_from(definition: Any) -> Spec:
    """Everything that steers a job, from its definition and the attempts it starts with."""
    body = _loaded(definition)

    def given(item: dict, *names: str) -> dict:
        return {name: item[name] for name in names if item.get(name) is not None}

    logs = [
        LogRule(
            item.get("name") or "",
            action=action_from(item.get("action")),
            condition=condition_from(item.get("condition")),
            **given(item, "pattern", "pattern_type", "match_once", "extract_groups", "metadata"),
        )
        for item in body.get("log_events") or ()
    ]
    states = [
        StateRule(
            item.get("name") or "",
            *(item.get("transition") or (None, None)),
            action=action_from(item.get("action")),
            condition=condition_from(item.get("condition")),
            **given(item, "metadata"),
        )
        for item in body.get("state_events") or ()
    ]
    own = {label: condition_from(body.get(f"{label}_condition")) for label in ("start", "cancel", "finish")}
    return Spec(logs, states, **own, **given(body, "submitted", "attempts"))

"""Actions: the effect of a fired rule and the text it leaves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.render import render_from_map

# Effect and default text of each action class, and the job outcome of each effect.
EFFECTS = {
    "RestartAction": "restart",
    "FinishAction": "finish",
    "CancelAction": "cancel",
    "LogAction": "noop",
    "NewJobAction": "noop",
}
DEFAULT_TEXTS = {
    "RestartAction": "restarting job",
    "FinishAction": "finished",
    "CancelAction": "cancelled",
    "LogAction": "Event {event_name} triggered",
    "NewJobAction": "Submitting local command job",
}
OUTCOMES = {"restart": "restart", "finish": "finished", "cancel": "cancelled", "noop": "continue"}
LEVELS = ("debug", "warning", "error")

_custom: dict[str, Callable[[Action, Column], tuple[str, Column]]] = {}


@dataclass(frozen=True)
class Action:
    """``kind`` names the class; ``text`` is the message template or the reason, by default that of the class."""

    kind: str
    text: str | None = None
    level: str = "info"
    job_config: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in EFFECTS and self.kind not in _custom:
            raise ValueError(f"unknown action {self.kind!r}")
        if self.text is None or self.kind == "NewJobAction":
            object.__setattr__(self, "text", DEFAULT_TEXTS.get(self.kind, ""))

    @property
    def effect(self) -> str:
        if self.kind in _custom:
            return _custom[self.kind](self, F.lit(None).cast("map<string,string>"))[0]
        return EFFECTS[self.kind]

    def message(self, variables: Column) -> Column:
        if self.kind in _custom:
            return _custom[self.kind](self, variables)[1]
        if self.kind == "LogAction":
            return render_from_map(self.text, variables)
        return F.lit(self.text)


def register_action(name: str, builder: Callable[[Action, Column], tuple[str, Column]]) -> None:
    """Add an action class; ``builder(action, variables)`` gives its effect and message expression."""
    if name in EFFECTS:
        raise ValueError(f"{name} is built in")
    _custom[name] = builder


def effect_of(kind: Column) -> Column:
    """Effect of an action class held in a column."""
    expr = F.lit(None).cast("string")
    for name, effect in EFFECTS.items():
        expr = F.when(kind == name, effect).otherwise(expr)
    return expr


def default_text(kind: Column) -> Column:
    """Default text of an action class held in a column."""
    expr = F.lit("")
    for name, text in DEFAULT_TEXTS.items():
        expr = F.when(kind == name, text).otherwise(expr)
    return expr


def outcome_of(effect: Column) -> Column:
    """What the effect means for the job; an unknown effect lets it continue."""
    expr = F.lit("continue")
    for name, outcome in OUTCOMES.items():
        if outcome != "continue":
            expr = F.when(effect == name, outcome).otherwise(expr)
    return expr


def normal_level(level: Column) -> Column:
    lowered = F.lower(level)
    return F.when(lowered.isin(*LEVELS), lowered).otherwise(F.lit("info"))


def per_rule(rules: list, rule_idx: Column, build: Callable[[object], Column]) -> Column:
    """One expression that picks ``build(rule)`` by rule index."""
    expr = None
    for idx, rule in rules:
        value = build(rule)
        expr = F.when(rule_idx == idx, value) if expr is None else expr.when(rule_idx == idx, value)
    return expr if expr is not None else F.lit(None).cast("string")


def action_results(triggers: DataFrame, rules: list, variables: Column) -> DataFrame:
    """Add action, effect, outcome, level, status and message to triggers of ``rules`` (index, rule)."""
    idx = F.col("rule_idx")
    return triggers.select(
        "*",
        per_rule(rules, idx, lambda r: F.lit(r.action.kind)).alias("action"),
        per_rule(rules, idx, lambda r: F.lit(r.action.effect)).alias("effect"),
        per_rule(rules, idx, lambda r: F.lit(OUTCOMES[r.action.effect])).alias("outcome"),
        per_rule(rules, idx, lambda r: normal_level(F.lit(r.action.level))).alias("level"),
        F.lit("success").alias("status"),
        per_rule(rules, idx, lambda r: r.action.message(variables)).alias("message"),
    )


def job_requests(triggers: DataFrame, rules: list) -> DataFrame:
    """New jobs asked for by log triggers, one row per fired rule of that kind."""
    makers = [(idx, r) for idx, r in rules if r.action.kind == "NewJobAction" and r.source == "log"]
    wanted = triggers.filter(F.col("rule_idx").isin([idx for idx, _ in makers]))
    config = per_rule(makers, F.col("rule_idx"), lambda r: F.lit(r.action.job_config))
    return wanted.withColumn("job_config", config)

"""Verdicts from ordered rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def first_match(rules: Sequence[tuple[Column, str, Column]], default: tuple[str, Column]) -> tuple[Column, Column]:
    """(verdict, reason) of the first rule whose predicate holds."""
    verdict = reason = None
    for condition, label, text in rules:
        verdict = F.when(condition, label) if verdict is None else verdict.when(condition, label)
        reason = F.when(condition, text) if reason is None else reason.when(condition, text)
    return verdict.otherwise(default[0]), reason.otherwise(default[1])


def because(*facts: tuple[str, Column, str]) -> Column:
    """Reason text: each feature's name and value with the limit that it met."""
    return F.concat_ws(", ", *[F.format_string("%s = %.3f [%s]", F.lit(name), value.cast("double"), F.lit(limit)) for name, value, limit in facts])


def tags(rules: Sequence[tuple[Column, str, Column]], fallback: tuple[str, str] | None = None) -> Column:
    """ARRAY<STRUCT<tag, detail>> of every rule that holds, in rule order."""
    marks = [F.when(c, F.struct(F.lit(t).alias("tag"), d.alias("detail"))) for c, t, d in rules]
    found = F.filter(F.array(*marks), lambda m: m.isNotNull())
    if fallback is None:
        return found
    other = F.array(F.struct(F.lit(fallback[0]).alias("tag"), F.lit(fallback[1]).alias("detail")))
    return F.when(F.size(found) == 0, other).otherwise(found)


def joined_reasons(rules: Sequence[tuple[Column, Column]], empty: str = "") -> Column:
    """The texts of every rule that holds, joined by '; '."""
    text = F.concat_ws("; ", *[F.when(c, t) for c, t in rules])
    return F.when(text == "", F.lit(empty)).otherwise(text)


def escalated(issues: Sequence[tuple[Column, str, Column]], clean: tuple[str, Column], many: str = "WEAK") -> tuple[Column, Column]:
    """No issue gives the clean verdict, one gives its own class, several give ``many``."""
    found = tags(issues)
    count = F.size(found)
    details = F.transform(found, lambda m: m["detail"])
    verdict = F.when(count == 0, F.lit(clean[0])).when(count == 1, F.try_element_at(found, F.lit(1))["tag"]).otherwise(F.lit(many))
    reason = (
        F.when(count == 0, clean[1])
        .when(count == 1, F.try_element_at(details, F.lit(1)))
        .otherwise(F.concat_ws("; ", details))
    )
    return verdict, reason

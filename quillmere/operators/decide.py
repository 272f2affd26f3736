"""Decisions as columns: staged gates, ordered rewriting rules, scoring, and routing with its evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.functions.text import hits_any, names_second_task, ungrounded_clocks


def first_failure(stages: Sequence[tuple[str, Column]], passed: str) -> Column:
    """The name of the first stage whose condition fails; a condition that is null fails."""
    out = F.lit(passed)
    for name, fine in reversed(stages):
        out = F.when(F.coalesce(fine, F.lit(False)), out).otherwise(F.lit(name))
    return out


def rewrite(rules: Sequence[tuple[str, Column]]) -> Column:
    """The code of the first rule that holds, null if none does: what follows is decided by the order of the rules alone."""
    out = F.lit(None).cast("string")
    for code, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def verdict(valid: Column, action: tuple[Column, Column], tool: tuple[Column, Column], arguments: Column, review: Column, content: Column) -> Column:
    """invalid, wrong, manual_review or correct.  Settled arguments that differ come before those that need a reader."""
    return (
        F.when(~F.coalesce(valid, F.lit(False)), "invalid")
        .when(~action[0].eqNullSafe(action[1]), "wrong")
        .when((action[1] == "call") & ~tool[0].eqNullSafe(tool[1]), "wrong")
        .when((action[1] == "call") & ~F.coalesce(arguments, F.lit(False)), "wrong")
        .when((action[1] == "call") & F.coalesce(review, F.lit(False)), "manual_review")
        .when((action[1] != "call") & ~F.coalesce(content, F.lit(False)), "wrong")
        .otherwise("correct")
    )


def covers_all(text: Column, fields: Column, terms: dict[str, list[str]]) -> Column:
    """Whether a text hits a cue word of every field of an array; a field without cue words is never hit."""
    known = F.array_except(fields, F.array(*(F.lit(f) for f in terms)).cast("array<string>"))
    out = F.size(known) == 0
    for field, words in terms.items():
        out = out & (~F.array_contains(fields, field) | hits_any(text, words))
    return out


def content_fine(action: Column, said: Column, source: Column, multi_intent: Column, fields: Column, code: Column, terms: dict) -> Column:
    """Whether a question or a reason is about what it should be about.

    ``said`` names no clock time that its ``source`` (request and context) lacks.  A question of several intents hits a word
    for their order, any other a cue of every missing field; a reason hits a word of its refusal code and one for the limit
    of what can be done.  ``terms``: multi_intent, boundary (lists), fields, codes (dicts of lists).  Other actions: false.
    """
    grounded = F.size(ungrounded_clocks(said, source)) == 0
    about = F.lit(False)
    for name, words in terms["codes"].items():
        about = about | ((code == name) & hits_any(said, words))
    question = F.when(F.coalesce(multi_intent, F.lit(False)), hits_any(said, terms["multi_intent"])).otherwise(covers_all(said, F.coalesce(fields, F.array().cast("array<string>")), terms["fields"]))
    fine = F.when(action == "clarify", grounded & question).when(action == "refuse", grounded & about & hits_any(said, terms["boundary"]))
    return F.coalesce(fine, F.lit(False))


def route_of(request: Column, action: Column, tool: Column, query: Column, only_query: Column, routes: dict[str, str]) -> Column:
    """(route, reason) of a delegation: one listed tool with a non-blank query and nothing else, and no second task."""
    known = F.create_map(*(F.lit(x) for kv in routes.items() for x in kv))
    reason = first_failure(
        [("multi_task", ~names_second_task(request)), ("non_call", action == "call"), ("unknown_tool", tool.isin(*routes)), ("invalid_arguments", only_query), ("empty_query", F.trim(query) != "")],
        "model",
    )
    return F.struct(F.when(reason == "model", known[tool]).alias("route"), reason.alias("reason"))


def merged_route(routes: Column) -> Column:
    """The common route of the clauses of a request; null if they differ or one has none."""
    different = F.array_distinct(routes)
    return F.when((F.size(different) == 1) & ~F.exists(routes, lambda r: r.isNull()), different[0])

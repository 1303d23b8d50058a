"""Secret and personal-data scrubbing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakegraph import model
from lakegraph.functions.text import let


def _rules(secrets: bool, pii: bool) -> tuple:
    return (model.SECRET_RULES if secrets else ()) + (model.PII_RULES if pii else ())


def scrub(text: Column, *, secrets: bool = True, pii: bool = True) -> Column:
    """Text with every match replaced by its label, rule after rule."""
    for pattern, label in _rules(secrets, pii):
        text = F.regexp_replace(text, pattern, label)
    return text


def scrub_with_labels(text: Column, *, secrets: bool = True, pii: bool = True) -> Column:
    """``struct<clean, labels>``: the scrubbed text and the rules that hit, in rule order.

    Each rule sees the text the rules before it left behind, and every
    intermediate text is computed once.
    """
    rules = _rules(secrets, pii)

    def step(i: int, before: Column, hits: list[Column]) -> Column:
        if i == len(rules):
            return F.struct(before.alias("clean"), F.array_compact(F.array(*hits)).alias("labels"))
        pattern, label = rules[i]
        return let(
            F.regexp_replace(before, pattern, label),
            lambda after: step(i + 1, after, [*hits, F.when(after != before, F.lit(label))]),
        )

    return let(text, lambda t: step(0, t, []))


def scrub_labels(text: Column, *, secrets: bool = True, pii: bool = True) -> Column:
    return scrub_with_labels(text, secrets=secrets, pii=pii)["labels"]


def has_secret_hint(text: Column) -> Column:
    return text.rlike(model.SECRET_HINT)

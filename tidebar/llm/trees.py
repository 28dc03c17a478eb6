"""Trained trees as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # ("leaf", value) or ("split", feature, threshold, left, right)


def parsed(description: str) -> list[Tree]:
    """Trees of a fitted tree model's printed form."""
    lines = [x.strip() for x in description.splitlines()]
    steps = iter([x for x in lines if x.startswith(("If", "Else", "Predict"))])

    def node() -> Tree:
        step = next(steps)
        if step.startswith("Predict"):
            return ("leaf", float(step.split(":")[1]))
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", step).groups()
        left = node()
        next(steps)
        return ("split", int(feature), float(threshold), left, node())

    out = []
    for _ in range(sum(x.startswith("Tree ") for x in lines) or 1):
        out.append(node())
    return out


def value_of(tree: Tree, features: Sequence[Column]) -> Column:
    if tree[0] == "leaf":
        return F.lit(tree[1])
    _, feature, threshold, left, right = tree
    return F.when(features[feature] <= F.lit(threshold), value_of(left, features)).otherwise(value_of(right, features))


def rules_of(tree: Tree, path: tuple = ()) -> list[tuple]:
    """Every path from the root to a node below it, as a conjunction of (feature, is at most, threshold)."""
    if tree[0] == "leaf":
        return []
    _, feature, threshold, left, right = tree
    out = []
    for branch, low in ((left, True), (right, False)):
        rule = (*path, (feature, low, threshold))
        out += [rule, *rules_of(branch, rule)]
    return out


def simplified(rule: tuple) -> tuple:
    """One bound per feature and direction, in a fixed order."""
    bounds: dict[tuple, float] = {}
    for feature, low, threshold in rule:
        key = (feature, low)
        bounds[key] = threshold if key not in bounds else min(bounds[key], threshold) if low else max(bounds[key], threshold)
    return tuple((f, low, t) for (f, low), t in sorted(bounds.items()))


def holds(rule: tuple, features: Sequence[Column]) -> Column:
    out = F.lit(True)
    for feature, low, threshold in rule:
        out = out & ((features[feature] <= F.lit(threshold)) if low else (features[feature] > F.lit(threshold)))
    return out

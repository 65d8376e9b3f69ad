"""Tree ensembles as one SQL expression, so that a model can run inside a fold over an array."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel

#: A leaf's value, or (feature, threshold, tree where feature <= threshold, tree elsewhere).
Tree = float | tuple

_HEAD = re.compile(r"Tree \d+ \(weight ([^)]+)\):")
_TEST = re.compile(r"If \(feature (\d+) <= ([^)]+)\)")
_LEAF = re.compile(r"Predict: (\S+)")


@dataclass(frozen=True)
class Ensemble:
    """Weighted sum of regression trees over a list of features."""

    trees: tuple[tuple[float, Tree], ...]

    def sql(self, features: str) -> str:
        """The prediction, from the name of an array of doubles."""
        if not self.trees:
            return "0D"
        terms = ", ".join(f"{_number(weight)} * {_case(tree, features)}" for weight, tree in self.trees)
        return f"aggregate(array({terms}), 0D, (total, term) -> total + term)"

    def __len__(self) -> int:
        return len(self.trees)


def _number(value: float) -> str:
    return f"{value!r}D" if value >= 0 else f"({value!r}D)"


def _case(tree: Tree, features: str) -> str:
    if not isinstance(tree, tuple):
        return _number(float(tree))
    feature, threshold, low, high = tree
    return f"(CASE WHEN {features}[{feature}] <= {_number(float(threshold))} THEN {_case(low, features)} ELSE {_case(high, features)} END)"


def compiled(model: GBTRegressionModel | Ensemble) -> Ensemble:
    """The trees of a fitted model, read from its description; thresholds and leaves keep every digit.

    Splits are on numbers; a split on categories is an error.
    """
    if isinstance(model, Ensemble):
        return model
    trees: list[tuple[float, Tree]] = []
    lines = iter(line.strip() for line in model.toDebugString.splitlines())

    def tree() -> Tree:
        line = next(lines)
        leaf = _LEAF.fullmatch(line)
        if leaf:
            return float(leaf[1])
        test = _TEST.fullmatch(line)
        if not test:
            raise ValueError(f"not a split on a number: {line}")
        low = tree()
        if not next(lines).startswith("Else"):
            raise ValueError("a split without its second half")
        return int(test[1]), float(test[2]), low, tree()

    for line in lines:
        head = _HEAD.fullmatch(line)
        if head:
            trees.append((float(head[1]), tree()))
    return Ensemble(tuple(trees))

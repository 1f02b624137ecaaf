"""Tree ensembles, trained by Spark's own learners and then written as column expressions, so that scoring is part of a
projection and needs neither Python nor a shuffle."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _node(node, feature, leaf) -> Column:
    if node.subtreeDepth() == 0:
        return F.lit(float(leaf(node)))
    split = node.split()
    low = feature(split.featureIndex()) <= float(split.threshold())
    return F.when(low, _node(node.leftChild(), feature, leaf)).otherwise(_node(node.rightChild(), feature, leaf))


def _assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label").coalesce(1)


def forest(rows: DataFrame, names: list[str], *, trees: int = 20, depth: int = 5, seed: int = 11):
    """rows: label (0 or 1) and columns `names`. Gives a function from features (by number) to P(1)."""
    learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    model = learner.fit(_assembled(rows, names))

    def share(node) -> float:
        stats = list(node.impurityStats().stats())
        return stats[1] / max(sum(stats), 1e-9)

    def score(feature) -> Column:
        total = F.lit(0.0)
        for t in model.trees:
            total = total + _node(t._java_obj.rootNode(), feature, share)
        return total / float(trees)

    return score


def boosted(rows: DataFrame, names: list[str], *, rounds: int = 12, depth: int = 3, seed: int = 11):
    """As forest(), by gradient boosting; the score is 1 / (1 + exp(-2 margin))."""
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.3).fit(_assembled(rows, names))

    def score(feature) -> Column:
        margin = F.lit(0.0)
        for t, w in zip(model.trees, model.treeWeights, strict=True):
            margin = margin + _node(t._java_obj.rootNode(), feature, lambda n: n.prediction()) * float(w)
        return 1.0 / (1.0 + F.exp(-2.0 * margin))

    return score


def threshold(scored: DataFrame, precision: float = 0.99) -> float:
    """scored: score, label of held-out rows (bounded). The lowest score from which on the share of label 1 reaches
    `precision`; over 1 if none does."""
    rows = sorted(((r[0], r[1]) for r in scored.select("score", "label").collect()), reverse=True)
    best, hits = 1.1, 0
    for k, (score, label) in enumerate(rows):
        hits += int(label == 1)
        last = k + 1 == len(rows) or rows[k + 1][0] != score
        if last and hits >= precision * (k + 1):
            best = score
    return best

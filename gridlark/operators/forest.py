"""Tree ensembles: training with pyspark.ml, export, and scoring of imported forests in the plan."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trained(rows: DataFrame, features: list[str], label: str, trees: int = 50, depth: int = 6, seed: int = 1, weight: str | None = None) -> RandomForestClassificationModel:
    """A random forest; with weight, rows count as it says."""
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    rf = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return (rf.setWeightCol(weight) if weight else rf).fit(data)


def _node(node) -> dict:
    if node.numDescendants() == 0:
        stats = list(node.impurityStats().stats())
        return {"votes": [float(x) for x in stats]}
    split = node.split()
    return {"feature": int(split.featureIndex()), "at": float(split.threshold()), "left": _node(node.leftChild()), "right": _node(node.rightChild())}


def exported(model: RandomForestClassificationModel, features: list[str], power: float = 1.0, scale: float = 1.0, cutoff: float = 0.5) -> dict:
    """The model as a JSON-ready dictionary, with the calibration that scoring applies."""
    trees = [_node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees]
    return {"ModelType": "RandomForest", "Features": features, "FilterCutoff": cutoff, "Calibration": {"Power": power, "Scale": scale}, "Model": trees}


def probability(model: dict) -> Column:
    """Mean share of votes for the first class, calibrated: scale * p^power, within 0 and 1. A missing feature goes left."""

    def of(node: dict) -> Column:
        if "votes" in node:
            total = sum(node["votes"])
            return F.lit(node["votes"][1] / total if total else 0.0)
        x = F.col(model["Features"][node["feature"]])
        return F.when(x.isNull() | (x <= node["at"]), of(node["left"])).otherwise(of(node["right"]))

    total = F.lit(0.0)
    for tree in model["Model"]:
        total = total + of(tree)
    p = total / len(model["Model"])
    c = model["Calibration"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c["Scale"] * F.pow(p, F.lit(float(c["Power"])))))


def merged_models(a: dict, b: dict) -> dict:
    """Recursive union of two nested dictionaries; a leaf in both is an error."""
    out = dict(a)
    for k, v in b.items():
        if k not in out:
            out[k] = v
        elif isinstance(out[k], dict) and isinstance(v, dict):
            out[k] = merged_models(out[k], v)
        else:
            raise ValueError(f"{k} is in both models")
    return out

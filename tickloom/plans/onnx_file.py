"""Tree ensembles as ONNX files: the public protobuf layout written by hand, as no converter is needed for it.

A file takes [N, features] floats and gives label ([N], the class) and probabilities (a map of
classes for each row). Splits of a Spark tree go left at or below a threshold; so do BRANCH_LEQ
nodes, with thresholds rounded down to the next float, which decides floats alike.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: element types, attribute types, and the operator sets used.
FLOAT, INT64 = 1, 7
_FLOAT, _INT, _STRING, _FLOATS, _INTS, _STRINGS = 1, 2, 3, 6, 7, 8
OPSET, ML_OPSET, IR_VERSION = 15, 3, 8


@dataclass
class Node:
    """A node of a tree: a split (feature, threshold, children) or a leaf (what it adds to each class)."""

    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    weights: dict[int, float] | None = None


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _attribute(name: str, value) -> bytes:
    """One attribute of a node; lists are repeated fields."""
    if isinstance(value, list):
        kind, number = (_FLOATS, 7) if isinstance(value[0], float) else (_INTS, 8) if isinstance(value[0], int) else (_STRINGS, 9)
        body = b"".join(_field(number, v) for v in value)
    else:
        kind, number = (_FLOAT, 2) if isinstance(value, float) else (_INT, 3) if isinstance(value, int) else (_STRING, 4)
        body = _field(number, value)
    return _field(5, _field(1, name) + body + _field(20, kind))


def _node(kind: str, inputs: list[str], outputs: list[str], **attributes) -> bytes:
    body = b"".join(_field(1, i) for i in inputs) + b"".join(_field(2, o) for o in outputs) + _field(3, kind) + _field(4, kind)
    return body + b"".join(_attribute(k, v) for k, v in attributes.items()) + _field(7, "ai.onnx.ml")


def _tensor(element: int, *shape: int | str) -> bytes:
    dims = b"".join(_field(1, _field(1, d) if isinstance(d, int) else _field(2, d)) for d in shape)
    return _field(1, _field(1, element) + _field(2, dims))


def _float_below(x: float) -> float:
    """The largest 32-bit float that is not above x."""
    f = np.float32(x)
    return float(f if float(f) <= x else np.nextafter(f, np.float32(-np.inf)))


def classifier(trees: list[list[Node]], classes: int, features: int, logistic: bool, facts: dict[str, str]) -> bytes:
    """The file of an ensemble whose classes' scores are sums over trees, through a logistic function if wanted, as shares of their sum."""
    at: dict[str, list] = {k: [] for k in ("treeids", "nodeids", "featureids", "modes", "values", "truenodeids", "falsenodeids")}
    leaf: dict[str, list] = {k: [] for k in ("treeids", "nodeids", "ids", "weights")}
    for t, nodes in enumerate(trees):
        for n, node in enumerate(nodes):
            split = node.weights is None
            row = (t, n, max(node.feature, 0), "BRANCH_LEQ" if split else "LEAF", _float_below(node.threshold) if split else 0.0, max(node.left, 0), max(node.right, 0))
            for k, v in zip(at, row, strict=True):
                at[k].append(v)
            for c, w in (node.weights or {}).items():
                for k, v in zip(leaf, (t, n, c, float(w)), strict=True):
                    leaf[k].append(v)
    labels = list(range(classes))
    ensemble = _node("TreeEnsembleClassifier", ["features"], ["label", "scores"], **{f"nodes_{k}": v for k, v in at.items()}, **{f"class_{k}": v for k, v in leaf.items()}, classlabels_int64s=labels, post_transform="LOGISTIC" if logistic else "NONE")
    shares = _node("Normalizer", ["scores"], ["shares"], norm="L1")
    zipped = _node("ZipMap", ["shares"], ["probabilities"], classlabels_int64s=labels)
    mapped = _field(4, _field(1, _field(5, _field(1, INT64) + _field(2, _tensor(FLOAT)))))
    value = lambda name, kind: _field(1, name) + _field(2, kind)
    graph = b"".join(_field(1, n) for n in (ensemble, shares, zipped)) + _field(2, "trees") + _field(11, value("features", _tensor(FLOAT, "N", features))) + _field(12, value("label", _tensor(INT64, "N"))) + _field(12, value("probabilities", mapped))
    opsets = _field(8, _field(1, "") + _field(2, OPSET)) + _field(8, _field(1, "ai.onnx.ml") + _field(2, ML_OPSET))
    return _field(1, IR_VERSION) + opsets + _field(2, "tickloom") + _field(7, graph) + b"".join(_field(14, _field(1, k) + _field(2, v)) for k, v in facts.items())

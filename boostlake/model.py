"""Boosted models: trees as arrays, linear weights, JSON and UBJSON interchange, dumps, importance and slicing."""

from __future__ import annotations

import copy
import json
import re
import struct
from dataclasses import dataclass, field

import numpy as np

VERSION = [3, 5, 0]
#: The parent of a root in a saved model.
NO_PARENT = 2147483647
TYPES = ("int", "float", "i", "q", "c")


@dataclass
class Tree:
    """A binary tree of n nodes. ``left`` is -1 at leaves; ``leaf`` has a row of values per node."""

    left: np.ndarray
    right: np.ndarray
    parent: np.ndarray
    feature: np.ndarray
    cond: np.ndarray
    default_left: np.ndarray
    loss_chg: np.ndarray
    sum_hess: np.ndarray
    base_weight: np.ndarray
    leaf: np.ndarray
    categories: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def root(cls, outputs: int = 1) -> Tree:
        z = lambda t: np.zeros(1, t)
        return cls(np.full(1, -1, np.int32), np.full(1, -1, np.int32), np.full(1, -1, np.int32), z(np.int32), z(np.float32), z(bool), z(np.float32), z(np.float32), z(np.float32), np.zeros((1, outputs), np.float32))

    @property
    def n(self) -> int:
        return len(self.left)

    def expand(self, node: int, feature: int, cond: float, default_left: bool, gain: float, weights: np.ndarray, hessians: tuple[float, float], categories: np.ndarray | None = None) -> tuple[int, int]:
        """Split a leaf; ``weights`` are the children's leaf values. Returns the children."""
        a, b = self.n, self.n + 1
        grow = lambda x, v: np.concatenate((x, np.asarray(v, x.dtype)))
        self.left, self.right, self.parent = grow(self.left, [-1, -1]), grow(self.right, [-1, -1]), grow(self.parent, [node, node])
        self.feature, self.cond, self.default_left, self.loss_chg = grow(self.feature, [0, 0]), grow(self.cond, [0, 0]), grow(self.default_left, [0, 0]), grow(self.loss_chg, [0, 0])
        self.sum_hess, self.base_weight = grow(self.sum_hess, hessians), grow(self.base_weight, [weights[0][0], weights[1][0]])
        self.leaf = np.concatenate((self.leaf, np.asarray(weights, np.float32)))
        self.left[node], self.right[node], self.feature[node], self.cond[node], self.default_left[node], self.loss_chg[node] = a, b, feature, cond, default_left, gain
        if categories is not None:
            self.categories[node] = np.asarray(categories, np.int64)
        return a, b

    def collapse(self, node: int, value: np.ndarray) -> None:
        """Make a node whose children are leaves a leaf; the children are dropped and nodes renumbered."""
        self.left[node] = self.right[node] = -1
        self.leaf[node] = value
        self.loss_chg[node] = 0
        self.categories.pop(node, None)
        self._compact()

    def _compact(self) -> None:
        keep, stack = [], [0]
        while stack:
            x = stack.pop()
            keep.append(x)
            if self.left[x] >= 0:
                stack += [int(self.right[x]), int(self.left[x])]
        keep = np.array(sorted(keep))
        new = np.full(self.n + 1, -1, np.int32)
        new[keep] = np.arange(len(keep))
        self.categories = {int(new[k]): v for k, v in self.categories.items() if new[k] >= 0}
        for name in ("feature", "cond", "default_left", "loss_chg", "sum_hess", "base_weight", "leaf"):
            setattr(self, name, getattr(self, name)[keep])
        self.left, self.right, self.parent = new[self.left[keep]], new[self.right[keep]], new[self.parent[keep]]

    def depths(self) -> np.ndarray:
        d = np.zeros(self.n, int)
        for i in range(1, self.n):
            d[i] = d[self.parent[i]] + 1 if self.parent[i] >= 0 else 0
        return d

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of a float32 matrix; NaN is missing."""
        at = np.zeros(len(x), np.int32)
        open_ = np.arange(len(x)) if self.left[0] >= 0 else np.zeros(0, int)
        while len(open_):
            node = at[open_]
            v = x[open_, self.feature[node]]
            missing = np.isnan(v)
            go_left = np.where(missing, self.default_left[node], v < self.cond[node])
            for k, cats in self.categories.items():
                here = (node == k) & ~missing
                if here.any():
                    code = v[here]
                    valid = (code >= 0) & (code < 16777216)
                    go_left[here] = ~(valid & np.isin(np.where(valid, code, -1).astype(np.int64), cats))
            at[open_] = np.where(go_left, self.left[node], self.right[node])
            open_ = open_[self.left[at[open_]] >= 0]
        return at

    def paths(self) -> list[list[int]]:
        """Nodes from the root to each node."""
        out: list[list[int]] = []
        for i in range(self.n):
            out.append([*(out[self.parent[i]] if i and self.parent[i] >= 0 else []), i])
        return out

    def equal(self, other: Tree) -> bool:
        """Whether both decide and value alike; statistics may differ."""
        if self.n != other.n or not np.array_equal(self.left, other.left) or not np.array_equal(self.right, other.right) or self.categories.keys() != other.categories.keys():
            return False
        inner, leaf = self.left >= 0, self.left < 0
        same = all(np.array_equal(getattr(self, k)[inner], getattr(other, k)[inner]) for k in ("feature", "cond", "default_left"))
        return same and np.array_equal(self.leaf[leaf], other.leaf[leaf]) and all(np.array_equal(v, other.categories[k]) for k, v in self.categories.items())

    def to_json(self, number: int, features: int) -> dict:
        leaf = self.left < 0
        cats = sorted(self.categories.items())
        sizes = [len(v) for _, v in cats]
        k = self.leaf.shape[1]
        out = {
            "base_weights": self.base_weight, "categories": np.concatenate([v for _, v in cats]).astype(np.int32) if cats else np.zeros(0, np.int32),
            "categories_nodes": np.array([n for n, _ in cats], np.int32), "categories_segments": np.array(np.concatenate(([0], np.cumsum(sizes)[:-1])) if cats else [], np.int64), "categories_sizes": np.array(sizes, np.int64),
            "default_left": self.default_left.astype(np.uint8), "id": number, "left_children": self.left, "loss_changes": self.loss_chg,
            "parents": np.where(self.parent < 0, NO_PARENT, self.parent).astype(np.int32), "right_children": self.right,
            "split_conditions": np.where(leaf & (k == 1), self.leaf[:, 0], self.cond).astype(np.float32), "split_indices": self.feature,
            "split_type": np.array([i in self.categories for i in range(self.n)], np.uint8), "sum_hessian": self.sum_hess,
            "tree_param": {"num_deleted": "0", "num_feature": str(features), "num_nodes": str(self.n), "size_leaf_vector": str(k)},
        }
        if k > 1:
            at = np.flatnonzero(leaf)
            right = self.right.copy()
            right[at] = np.arange(len(at))
            out |= {"leaf_weights": self.leaf[at].ravel(), "right_children": right}
        return out

    @classmethod
    def from_json(cls, d: dict) -> Tree:
        a = lambda k, t: np.asarray(d[k], t)
        left, right, cond = a("left_children", np.int32), a("right_children", np.int32), a("split_conditions", np.float32)
        parent = np.asarray(d["parents"], np.int64)
        parent = np.where(parent == NO_PARENT, -1, parent).astype(np.int32)
        k = int(d["tree_param"].get("size_leaf_vector", 1) or 1)
        is_leaf = left < 0
        if k > 1 and "leaf_weights" in d:
            leaf = np.zeros((len(left), k), np.float32)
            rows = np.asarray(d["leaf_weights"], np.float32).reshape(-1, k)
            leaf[is_leaf] = rows[right[is_leaf]]
            right = np.where(is_leaf, -1, right)
        else:
            leaf = np.where(is_leaf, cond, 0).astype(np.float32)[:, None]
        flat = np.asarray(d.get("categories", []), np.int64)
        cats = {int(n): flat[s : s + z] for n, s, z in zip(d.get("categories_nodes", []), d.get("categories_segments", []), d.get("categories_sizes", []), strict=True)}
        return cls(left, right, parent, a("split_indices", np.int32), cond, a("default_left", bool), a("loss_changes", np.float32), a("sum_hessian", np.float32), a("base_weights", np.float32), leaf, cats)


@dataclass
class Model:
    """A booster: trees with the output group and round of each, or linear weights ((features + 1) x groups, bias last)."""

    objective: str = "reg:squarederror"
    params: dict = field(default_factory=dict)
    booster: str = "gbtree"
    num_feature: int = 0
    num_class: int = 0
    num_target: int = 1
    base_score: list[float] = field(default_factory=lambda: [0.5])
    trees: list[Tree] = field(default_factory=list)
    tree_info: list[int] = field(default_factory=list)
    indptr: list[int] = field(default_factory=lambda: [0])
    weight_drop: list[float] | None = None
    weights: np.ndarray | None = None
    linear_rounds: int = 0
    parallel: int = 1
    attributes: dict[str, str] = field(default_factory=dict)
    feature_names: list[str] = field(default_factory=list)
    feature_types: list[str] = field(default_factory=list)
    categories: dict[int, list[str]] = field(default_factory=dict)
    objective_config: dict = field(default_factory=dict)

    @property
    def groups(self) -> int:
        return max(len(self.base_score), self.num_class, self.num_target, 1)

    @property
    def rounds(self) -> int:
        return self.linear_rounds if self.booster == "gblinear" else len(self.indptr) - 1

    def names(self) -> list[str]:
        return self.feature_names or [f"f{i}" for i in range(self.num_feature)]

    def tree_weight(self, i: int) -> float:
        return 1.0 if self.weight_drop is None else self.weight_drop[i]

    def set_feature_info(self, names: list[str] | None = None, types: list[str] | None = None) -> None:
        for what, x in (("names", names), ("types", types)):
            if x and len(x) != self.num_feature:
                raise ValueError(f"{len(x)} feature {what} for {self.num_feature} features")
        if types and (bad := set(types) - set(TYPES)):
            raise ValueError(f"unknown feature types {sorted(bad)}")
        self.feature_names = list(names) if names is not None else self.feature_names
        self.feature_types = list(types) if types is not None else self.feature_types

    def tree_range(self, begin: int = 0, end: int = 0) -> range:
        """Trees of the rounds from begin to end; 0 is the last round."""
        end = end or self.rounds
        if not 0 <= begin <= end <= self.rounds:
            raise ValueError(f"rounds {begin} to {end} of {self.rounds}")
        return range(self.indptr[begin], self.indptr[end])

    def slice(self, begin: int = 0, end: int = 0, step: int = 1) -> Model:
        """The rounds begin, begin + step, ... before end; a step that doesn't divide the range is allowed."""
        if self.booster == "gblinear":
            raise ValueError("a linear model has no rounds to slice")
        end = end or self.rounds
        if not 0 <= begin < end <= self.rounds or step < 1:
            raise IndexError(f"rounds {begin} to {end} of {self.rounds}")
        out = copy.deepcopy(self)
        chosen = [t for r in range(begin, end, step) for t in range(self.indptr[r], self.indptr[r + 1])]
        out.trees, out.tree_info = [out.trees[t] for t in chosen], [self.tree_info[t] for t in chosen]
        out.indptr = [0, *np.cumsum([self.indptr[r + 1] - self.indptr[r] for r in range(begin, end, step)]).tolist()]
        out.weight_drop = [self.weight_drop[t] for t in chosen] if self.weight_drop is not None else None
        for k in ("best_iteration", "best_score"):
            out.attributes.pop(k, None)
        return out

    def importance(self, kind: str = "weight") -> dict[str, list[float] | float]:
        """Feature scores: weight, gain, total_gain, cover, total_cover; only used features. Linear models: weight."""
        names = self.names()
        if self.booster == "gblinear":
            if kind != "weight":
                raise ValueError("a linear model has weights only")
            return {n: [float(x) for x in self.weights[i]] for i, n in enumerate(names)}
        if kind not in ("weight", "gain", "total_gain", "cover", "total_cover"):
            raise ValueError(f"unknown importance {kind}")
        count, total = np.zeros(self.num_feature), np.zeros(self.num_feature, np.float32)
        for t in self.trees:
            at = np.flatnonzero(t.left >= 0)
            np.add.at(count, t.feature[at], 1)
            for f, v in zip(t.feature[at], (t.loss_chg if "gain" in kind else t.sum_hess)[at], strict=True):
                total[f] += v
        score = count if kind == "weight" else total if kind.startswith("total") else total / np.maximum(count, 1).astype(np.float32)
        return {names[i]: float(score[i]) for i in range(self.num_feature) if count[i]}

    def to_json(self) -> dict:
        learner = {
            "attributes": dict(sorted(self.attributes.items())), "feature_names": self.feature_names, "feature_types": self.feature_types,
            "learner_model_param": {"base_score": "[" + ",".join(number(x) for x in self.base_score) + "]", "boost_from_average": "1", "num_class": str(self.num_class), "num_feature": str(self.num_feature), "num_target": str(self.num_target)},
            "objective": {**self.objective_config, "name": self.objective},
        }
        if self.booster == "gblinear":
            learner["gradient_booster"] = {"model": {"boosted_rounds": self.linear_rounds, "weights": self.weights.astype(np.float32).ravel()}, "name": "gblinear"}
        else:
            text = [self.categories.get(i, []) for i in range(self.num_feature)] if self.categories else []
            model = {
                "cats": {"enc": text, "feature_segments": [], "sorted_idx": []},
                "gbtree_model_param": {"num_parallel_tree": str(self.parallel), "num_trees": str(len(self.trees))},
                "iteration_indptr": np.array(self.indptr, np.int32), "tree_info": np.array(self.tree_info, np.int32), "trees": [t.to_json(i, self.num_feature) for i, t in enumerate(self.trees)],
            }
            if self.weight_drop is not None:
                model["weight_drop"] = np.array(self.weight_drop, np.float32)
            learner["gradient_booster"] = {"model": model, "name": "gbtree"}
        return {"learner": learner, "version": VERSION}

    @classmethod
    def from_json(cls, d: dict) -> Model:
        learner = d["learner"]
        p, g = learner["learner_model_param"], learner["gradient_booster"]
        base = p["base_score"]
        scores = [float(x) for x in (base.strip("[]").split(",") if isinstance(base, str) else base)]
        m = cls(learner["objective"]["name"], {}, g["name"], int(p["num_feature"]), int(p["num_class"]), int(p["num_target"]), scores)
        m.attributes, m.feature_names, m.feature_types = dict(learner["attributes"]), list(learner["feature_names"]), list(learner["feature_types"])
        m.objective_config = {k: v for k, v in learner["objective"].items() if k != "name"}
        for v in m.objective_config.values():
            m.params |= v if isinstance(v, dict) else {}
        body = g["model"]
        if g["name"] == "gblinear":
            m.linear_rounds = int(body["boosted_rounds"])
            m.weights = np.asarray(body["weights"], np.float32).reshape(m.num_feature + 1, -1)
            return m
        m.parallel = int(body["gbtree_model_param"]["num_parallel_tree"])
        m.trees, m.tree_info, m.indptr = [Tree.from_json(t) for t in body["trees"]], [int(x) for x in body["tree_info"]], [int(x) for x in body["iteration_indptr"]]
        m.weight_drop = [float(x) for x in body["weight_drop"]] if "weight_drop" in body else None
        m.categories = {i: list(c) for i, c in enumerate(body["cats"].get("enc", [])) if c and all(isinstance(x, str) for x in c)}
        return m

    def save(self, kind: str = "json") -> bytes:
        """Bytes of the model: json or ubj."""
        if kind == "json":
            return json_text(self.to_json()).encode()
        if kind == "ubj":
            return ubj_bytes(self.to_json())
        raise ValueError(f"unknown model format {kind}")

    @classmethod
    def load(cls, content: bytes) -> Model:
        """Read JSON or UBJSON; told apart by the second byte."""
        if content[:4] == b"binf":
            raise ValueError("the old binary format isn't supported")
        if content[:1] != b"{":
            raise ValueError("not a model")
        text = content[1:2] in b'"\n\r\t }'
        return cls.from_json(json.loads(content) if text else ubj_value(content))

    def dump(self, kind: str = "text", stats: bool = False, feature_map: list[tuple[str, str]] | None = None) -> list[str]:
        """Text, json or dot of each tree (or of the linear weights)."""
        names = [n for n, _ in feature_map] if feature_map else self.names()
        types = [t for _, t in feature_map] if feature_map else (self.feature_types or ["q"] * self.num_feature)
        if self.booster == "gblinear":
            return [_dump_linear(self.weights, kind)]
        make = {"text": _dump_text, "json": _dump_json, "dot": _dump_dot}.get(kind.split(":")[0])
        if make is None:
            raise ValueError(f"unknown dump format {kind}")
        return [make(t, names, types, stats) for t in self.trees]

    def nodes(self) -> list[dict]:
        """Rows of the tree_nodes table."""
        at = [r for r in range(self.rounds) for _ in range(self.indptr[r], self.indptr[r + 1])]
        return [
            {"tree": i, "grp": self.tree_info[i], "iteration": at[i], "weight": self.tree_weight(i), "node": n, "parent": int(t.parent[n]), "left": int(t.left[n]), "right": int(t.right[n]), "feature": int(t.feature[n]), "split_cond": float(t.cond[n]), "default_left": bool(t.default_left[n]),
             "is_cat": n in t.categories, "categories": [int(c) for c in t.categories.get(n, [])], "loss_chg": float(t.loss_chg[n]), "sum_hess": float(t.sum_hess[n]), "base_weight": float(t.base_weight[n]), "leaf": [float(x) for x in t.leaf[n]]}
            for i, t in enumerate(self.trees) for n in range(t.n)
        ]


NODE_SCHEMA = "tree int, grp int, iteration int, weight double, node int, parent int, left int, right int, feature int, split_cond double, default_left boolean, is_cat boolean, categories array<int>, loss_chg double, sum_hess double, base_weight double, leaf array<double>"


def number(x: float) -> str:
    """Shortest digits of a float32 that read back, as d.dddE±x."""
    x = np.float32(x)
    if not np.isfinite(x):
        return "NaN" if np.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    return np.format_float_scientific(x, unique=True, trim="-", exp_digits=1).replace("e+", "E").replace("e", "E")


def json_text(x) -> str:
    """JSON with floats in the model format."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{json_text(v)}" for k, v in x.items()) + "}"
    if isinstance(x, np.ndarray):
        return "[" + ",".join(map(number, x) if x.dtype.kind == "f" else map(str, x.tolist())) + "]"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(json_text(v) for v in x) + "]"
    if isinstance(x, float):
        return number(x)
    return json.dumps(x)


# Type marks of Universal Binary JSON, big-endian.
_UBJ = {"i": "b", "U": "B", "I": "h", "l": "i", "L": "q", "d": "f", "D": "d"}
_MARK = {"float32": "d", "float64": "D", "int8": "i", "uint8": "U", "int16": "I", "int32": "l", "int64": "L"}


def ubj_bytes(x) -> bytes:
    """Encode as UBJSON; arrays of numbers are typed."""
    if isinstance(x, dict):
        return b"{" + b"".join(_ubj_key(k) + ubj_bytes(v) for k, v in x.items()) + b"}"
    if isinstance(x, np.ndarray):
        return b"[$" + _MARK[x.dtype.name].encode() + b"#L" + struct.pack(">q", len(x)) + x.astype(x.dtype.newbyteorder(">")).tobytes()
    if isinstance(x, (list, tuple)):
        return b"[#L" + struct.pack(">q", len(x)) + b"".join(map(ubj_bytes, x))
    if isinstance(x, bool):
        return b"T" if x else b"F"
    if x is None:
        return b"Z"
    if isinstance(x, int):
        return b"L" + struct.pack(">q", x)
    if isinstance(x, float):
        return b"d" + struct.pack(">f", x)
    return b"S" + _ubj_key(str(x))


def _ubj_key(k: str) -> bytes:
    raw = k.encode()
    return b"L" + struct.pack(">q", len(raw)) + raw


def ubj_value(content: bytes):
    """Decode one UBJSON value."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        at += n
        return content[at - n : at]

    def num(mark: str):
        f = ">" + _UBJ[mark]
        return struct.unpack(f, take(struct.calcsize(f)))[0]

    def value(mark: str):
        nonlocal at
        if mark in _UBJ:
            return num(mark)
        if mark == "S":
            return take(num(take(1).decode())).decode()
        if mark in "TFZ":
            return {"T": True, "F": False, "Z": None}[mark]
        if mark == "[":
            kind = None
            if content[at : at + 1] == b"$":
                take(1)
                kind = take(1).decode()
            if content[at : at + 1] == b"#":
                take(1)
                n = num(take(1).decode())
                if kind in _UBJ:
                    t = np.dtype(">" + _UBJ[kind])
                    return np.frombuffer(take(n * t.itemsize), t).astype(t.newbyteorder("=")).tolist()
                return [value(kind or take(1).decode()) for _ in range(n)]
            out = []
            while content[at : at + 1] != b"]":
                out.append(value(take(1).decode()))
            take(1)
            return out
        if mark == "{":
            out = {}
            while content[at : at + 1] != b"}":
                key = take(num(take(1).decode())).decode()
                out[key] = value(take(1).decode())
            take(1)
            return out
        raise ValueError(f"unknown mark {mark!r} at {at}")

    return value(take(1).decode())


def general(x: float, digits: int = 9) -> str:
    """A number as %g prints it."""
    return f"{float(x):.{digits}g}"


def read_feature_map(text: str) -> list[tuple[str, str]]:
    """(name, type) by index from lines of id, name and type."""
    fields = text.split()
    rows = sorted((int(fields[i]), fields[i + 1], fields[i + 2]) for i in range(0, len(fields) - 2, 3))
    if [r[0] for r in rows] != list(range(len(rows))):
        raise ValueError("feature ids must run from 0 without gaps")
    if bad := {r[2] for r in rows} - {"i", "q", "int", "float", "c"}:
        raise ValueError(f"unknown feature types {sorted(bad)}")
    return [(n, t) for _, n, t in rows]


def _dump_text(t: Tree, names: list[str], types: list[str], stats: bool) -> str:
    out, stack, depth = [], [(0, 0)], 0
    while stack:
        i, depth = stack.pop()
        tab = "\t" * depth
        if t.left[i] < 0:
            value = general(t.leaf[i, 0]) if t.leaf.shape[1] == 1 else "[" + ",".join(map(general, t.leaf[i])) + "]"
            out.append(f"{tab}{i}:leaf={value}" + (f",cover={general(t.sum_hess[i])}" if stats else "") + "\n")
            continue
        f, a, b = int(t.feature[i]), int(t.left[i]), int(t.right[i])
        miss = a if t.default_left[i] else b
        end = f",gain={general(t.loss_chg[i])},cover={general(t.sum_hess[i])}" if stats else ""
        if i in t.categories:
            head, yes, no = f"[{names[f]}:{{{','.join(map(str, t.categories[i]))}}}]", b, a
        elif types[f] == "i":
            out.append(f"{tab}{i}:[{names[f]}] yes={b if miss == a else a},no={miss}{end}\n")
            stack += [(b, depth + 1), (a, depth + 1)]
            continue
        else:
            cond = str(int(np.ceil(t.cond[i]))) if types[f] == "int" else general(t.cond[i])
            head, yes, no = f"[{names[f]}<{cond}]", a, b
        out.append(f"{tab}{i}:{head} yes={yes},no={no},missing={miss}{end}\n")
        stack += [(b, depth + 1), (a, depth + 1)]
    return "".join(out)


def _dump_json(t: Tree, names: list[str], types: list[str], stats: bool, node: int = 0, depth: int = 0) -> str:
    pad = "  " * (depth + 1)
    if t.left[node] < 0:
        value = general(t.leaf[node, 0]) if t.leaf.shape[1] == 1 else "[" + ", ".join(map(general, t.leaf[node])) + "]"
        return f'{pad}{{ "nodeid": {node}, "leaf": {value} ' + (f', "cover": {general(t.sum_hess[node])} ' if stats else "") + "}"
    f, a, b = int(t.feature[node]), int(t.left[node]), int(t.right[node])
    miss = a if t.default_left[node] else b
    if node in t.categories:
        cond, yes, no = "[" + ", ".join(map(str, t.categories[node])) + "]", b, a
    else:
        cond, yes, no = (str(int(np.ceil(t.cond[node]))) if types[f] == "int" else general(t.cond[node])), a, b
    head = f'"nodeid": {node}, "depth": {depth}, "split": "{names[f]}"' + ("" if types[f] == "i" else f', "split_condition": {cond}')
    end = f' , "gain": {general(t.loss_chg[node])}, "cover": {general(t.sum_hess[node])}' if stats else ""
    inner = ", \n".join(_dump_json(t, names, types, stats, c, depth + 1) for c in (a, b))
    return f'{pad}{{ {head}, "yes": {yes}, "no": {no}, "missing": {miss}{end}, "children": [\n{inner}\n{pad}]}}'


def _dump_dot(t: Tree, names: list[str], types: list[str], stats: bool) -> str:
    lines = ["digraph {", "    graph [ rankdir=TB ]"]
    for i in range(t.n):
        if t.left[i] < 0:
            lines.append(f'    {i} [ label="leaf={general(t.leaf[i, 0])}" ]')
            continue
        f = int(t.feature[i])
        test = f":{{{','.join(map(str, t.categories[i]))}}}" if i in t.categories else "" if types[f] == "i" else f"<{general(t.cond[i])}"
        lines.append(f'    {i} [ label="{names[f]}{test}" ]')
        for child, left in ((int(t.left[i]), True), (int(t.right[i]), False)):
            yes = left != (i in t.categories)
            missing = ", missing" if bool(t.default_left[i]) == left else ""
            lines.append(f'    {i} -> {child} [label="{"yes" if yes else "no"}{missing}" color="{"#0000FF" if missing else "#FF0000"}"]')
    return "\n".join([*lines, "}"])


def _dump_linear(w: np.ndarray, kind: str) -> str:
    bias, rest = w[-1], w[:-1].ravel()
    if kind == "json":
        block = lambda xs: ",\n".join(f"      {general(x, 6)}" for x in xs)
        return f'  {{ "bias": [\n{block(bias)}\n    ],\n    "weight": [\n{block(rest)}\n    ]\n  }}'
    return "bias:\n" + "".join(f"{general(x, 6)}\n" for x in bias) + "weight:\n" + "".join(f"{general(x, 6)}\n" for x in rest)


def parse_eval(line: str, sets: list[str]) -> dict[str, dict[str, float]]:
    """Scores by set and metric of a line such as ``[7]<tab>train-rmse:0.25``; set names may hold dashes."""
    out: dict[str, dict[str, float]] = {s: {} for s in sets}
    for part in re.split(r"\t", line.strip())[1:]:
        key, _, value = part.rpartition(":")
        name = max((s for s in sets if key.startswith(s + "-")), key=len)
        out[name][key[len(name) + 1 :]] = float(value)
    return out

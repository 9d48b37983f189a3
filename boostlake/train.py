"""Training: the rounds loop for trees, dropout and linear boosters, evaluation, early stopping and cross-validation."""

from __future__ import annotations

import functools
import json
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlake.functions.metrics import Metric, metric
from boostlake.functions.objectives import Frame, Objective, objective
from boostlake.model import Model
from boostlake.operators import linear
from boostlake.operators.cuts import Cuts, bins_matrix, build
from boostlake.operators.grow import BinnedTree, ValueTree, grow, uniform
from boostlake.operators.predict import predict
from boostlake.operators.refresh import prune, refresh
from boostlake.operators.splits import ALIASES, TreeParams
from boostlake.session import remove, stored

log = logging.getLogger("boostlake")
#: Rows in a stretch of values that one task of the exact method sorts, about; and the fewest stretches of a feature.
STRETCH_ROWS, STRETCHES = 65_536, 256
#: Attributes of a model that hold the position debiasing terms, from which training goes on.
TERMS = ("ti+", "tj-")
#: Rounds after which margins are stored, to cut lineage.
STORE_EVERY = 8


@dataclass(frozen=True)
class Data:
    """A frame and the roles of its columns. ``row_id`` must be unique; ``label`` may be an array for several targets."""

    df: DataFrame
    features: list[str]
    label: str = "label"
    row_id: str = "row_id"
    weight: str | None = None
    qid: str | None = None
    base_margin: str | None = None
    lower: str | None = None
    upper: str | None = None
    categorical: list[str] = field(default_factory=list)
    missing: float | None = None

    def targets(self) -> int:
        kind = dict(self.df.dtypes).get(self.label, "double")
        if not kind.startswith("array"):
            return 1
        r = self.df.select(F.size(self.label)).first()
        return int(r[0]) if r else 1

    def flags(self) -> list[bool]:
        return [f in self.categorical for f in self.features]

    def x(self) -> list[Column]:
        """Feature columns as float, missing values null."""
        out = []
        for c in self.features:
            v = F.col(f"`{c}`").cast("float")
            bad = F.isnan(v) if self.missing is None or self.missing != self.missing else F.isnan(v) | (v == F.lit(self.missing).cast("float"))
            out.append(F.when(bad, None).otherwise(v))
        return out

    def plain(self) -> DataFrame:
        """row_id, x (array of float), label, weight, qid and bounds under fixed names."""
        named = {"label": self.label if self.label in self.df.columns else None, "weight": self.weight, "qid": self.qid, "label_lower_bound": self.lower, "label_upper_bound": self.upper, "base_margin": self.base_margin}
        cols = [F.col(f"`{c}`").alias(n) for n, c in named.items() if c]
        return self.df.select(F.col(f"`{self.row_id}`").cast("long").alias("row_id"), F.array(*self.x()).alias("x"), *cols)

    def frame(self) -> Frame:
        return Frame(weight="weight" if self.weight else None, qid="qid" if self.qid else None)


@dataclass
class Booster:
    """A trained model with its evaluation history."""

    model: Model
    history: dict[str, dict[str, list[float]]] = field(default_factory=dict)

    @property
    def best_iteration(self) -> int | None:
        v = self.model.attributes.get("best_iteration")
        return None if v is None else int(v)

    @property
    def best_score(self) -> float | None:
        v = self.model.attributes.get("best_score")
        return None if v is None else float(v)


LEARNER = {"objective", "base_score", "num_class", "num_target", "boost_from_average", "disable_default_eval_metric", "booster", "multi_strategy", "eval_metric", "seed", "random_state", "seed_per_iteration", "nthread", "n_jobs", "device", "validate_parameters", "verbosity"}
BOOSTER = {"tree_method", "updater", "updater_seq", "process_type", "num_parallel_tree", "num_trees", "sample_type", "normalize_type", "rate_drop", "one_drop", "skip_drop", "tolerance", "feature_selector", "top_k", "sparse_threshold", "max_cached_hist_node", "opt_dense_col", "debug_synchronize"}
OBJECTIVE = {"scale_pos_weight", "huber_slope", "tweedie_variance_power", "quantile_alpha", "expectile_alpha", "aft_loss_distribution", "aft_loss_distribution_scale", "lambdarank_pair_method", "lambdarank_num_pair_per_sample", "lambdarank_unbiased", "lambdarank_normalization", "lambdarank_score_normalization", "lambdarank_bias_norm", "ndcg_exp_gain"}


def tree_params(params: dict) -> TreeParams:
    """Growth parameters by name or alias; lists may be given as text."""
    out = {}
    for f in fields(TreeParams):
        if f.name in params:
            v = params[f.name]
            if f.name == "monotone_constraints" and isinstance(v, str):
                v = [int(x) for x in v.strip("() ").split(",") if x.strip()]
            if f.name == "interaction_constraints" and isinstance(v, str):
                v = json.loads(v) if v else []
            out[f.name] = v if isinstance(v, (list, str)) or v is None else type(f.default)(v)
    p = TreeParams(**out)
    if p.default_direction not in ("learn", "left", "right"):
        raise ValueError("default_direction is learn, left or right")
    if p.max_bin < 2 or p.learning_rate < 0 or not 0 <= p.subsample <= 1:
        raise ValueError("max_bin, learning_rate or subsample is out of range")
    return p


def canonical(params: dict) -> dict:
    """Parameters under their full names; unknown ones are reported."""
    out = {ALIASES.get(k, k): v for k, v in params.items()}
    if int(out.get("num_class", 0) or 0) > 1 and "objective" not in out:
        out["objective"] = "multi:softmax"
    known = LEARNER | BOOSTER | OBJECTIVE | {f.name for f in fields(TreeParams)}
    if unused := sorted(set(out) - known):
        log.warning("parameters not used: %s", ", ".join(unused))
    return out


def validate(data: Data, obj: Objective) -> None:
    """Raise where labels, weights, query ids or bounds can't be trained on; one pass over the rows."""
    df, f = data.plain(), data.frame()
    bad: dict[str, Column] = {}
    if data.weight:
        w = F.col("weight").cast("double")
        bad["weights must be finite and not negative"] = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    if data.qid:
        bad["query ids must not be missing"] = F.col("qid").isNull()
    if "label" in df.columns and not obj.name.startswith("survival:aft"):
        each = (lambda rule: F.exists("label", rule)) if dict(df.dtypes)["label"].startswith("array") else lambda rule: rule(F.col("label"))
        bad["labels must be finite"] = F.coalesce(each(lambda y: y.isNull() | F.isnan(y.cast("double")) | (F.abs(y.cast("double")) == float("inf"))), F.lit(True))
        if obj.valid(F.lit(0.0)) is not None:
            bad[f"labels are out of the domain of {obj.name}"] = F.coalesce(each(lambda y: ~obj.valid(y.cast("double"))), F.lit(False))
    if obj.name.startswith("survival:aft") and data.lower and data.upper:
        low, high = F.col("label_lower_bound").cast("double"), F.col("label_upper_bound").cast("double")
        bad["bounds must be ordered and not negative"] = low.isNull() | high.isNull() | (low < 0) | (low > high)
    if not bad:
        return
    found = df.agg(*[F.count(F.when(rule, 1)).alias(f"c{i}") for i, rule in enumerate(bad.values())]).first()
    for n, what in zip(found, bad, strict=True):
        if n:
            raise ValueError(f"{what}: {n} rows")


def _encode(data: Data, cuts: Cuts, extra: list[str]) -> DataFrame:
    """row_id, bins (values for the exact method) and the extra columns of ``data.plain()``, x among them if asked for."""
    plain = data.plain()
    keep = [c for c in plain.columns if c != "row_id" and c in extra]
    shared = plain.sparkSession.sparkContext.broadcast(cuts)
    fields_ = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in plain.select(*keep).schema)
    m = len(cuts.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, m)
            if np.isinf(x).any():
                raise ValueError("features hold infinite values")
            cuts = shared.value
            bins = (x if cuts.exact else bins_matrix(x, cuts)).astype(cuts.kind)
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array([r.tobytes() for r in bins], pa.binary()), *(b.column(c) for c in keep)], names=["row_id", "bins", *keep])

    return plain.select("row_id", "x", *[c for c in keep if c != "x"]).mapInArrow(run, f"row_id long, bins binary{fields_}")


def _rebinned(df: DataFrame, cuts: Cuts) -> DataFrame:
    """A binned frame that holds x, with the bins of other cuts."""
    shared, names = df.sparkSession.sparkContext.broadcast(cuts), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, len(cuts.values))
            bins = pa.array([r.tobytes() for r in bins_matrix(x, cuts).astype(cuts.kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([bins if c == "bins" else b.column(c) for c in names], names=names)

    return df.mapInArrow(run, df.schema)


def _add_trees(df: DataFrame, trees: list[BinnedTree], outputs: list[list[int]], cuts: Cuts, factors: list[float] | None = None, only: bool = False) -> DataFrame:
    """Margins of a binned frame plus the leaf values of ``trees``."""
    shared = df.sparkSession.sparkContext.broadcast((trees, outputs, factors or [1.0] * len(trees)))
    features, kind = len(cuts.values), cuts.kind
    names, at = df.columns, df.columns.index("margin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, outputs, factors = shared.value
        for b in batches:
            n = b.num_rows
            bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), kind).reshape(n, features)
            margin = np.asarray(b.column("margin").flatten(), np.float64).reshape(n, -1).astype(np.float32)
            for t, o, w in zip(trees, outputs, factors, strict=True):
                margin[:, o] += np.float32(w) * t.tree.leaf[t.nodes_of(bins)]
            packed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * margin.shape[1]), pa.array(margin.astype(np.float64).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), packed, *(b.column(i) for i in range(at + 1, len(names)))], names=names)

    return df.mapInArrow(run, df.schema)


def _start(df: DataFrame, base: list[float]) -> DataFrame:
    """The margin column from base_margin or the base."""
    const = F.array(*[F.lit(float(np.float32(b))) for b in base])
    if "base_margin" not in df.columns:
        return df.withColumn("margin", const)
    kind = dict(df.dtypes)["base_margin"]
    own = F.transform("base_margin", lambda v: v.cast("double")) if kind.startswith("array") else F.array(*[F.col("base_margin").cast("double")] * len(base))
    return df.withColumn("margin", F.coalesce(own, const))


def intercept(params: dict, obj: Objective, data: Data) -> list[float]:
    """Base scores: given, fitted to the labels, or 0.5."""
    targets = data.targets()
    given = params.get("base_score")
    if given is not None:
        g = [float(x) for x in (given if isinstance(given, (list, tuple)) else [given])]
        return g * obj.outputs(targets) if len(g) == 1 else g
    if not int(params.get("boost_from_average", 1)):
        return [0.5] * obj.outputs(targets)
    return [float(np.float32(x)) for x in obj.intercept(data.plain(), data.frame(), targets)]


def mvs_threshold(df: DataFrame, rate: float, rounds: int = 30) -> float:
    """u with sum of min(1, r / u) = n * rate, for r the root of summed g squared plus a tenth of h squared."""
    r = F.sqrt(F.aggregate("g", F.lit(0.0), lambda a, x: a + x * x) + 0.1 * F.aggregate("h", F.lit(0.0), lambda a, x: a + x * x))
    rows = df.select(r.alias("r"))
    first = rows.agg(F.sum("r").alias("s"), F.count("*").alias("n")).first()
    if not first["n"] or not first["s"]:
        return 0.0
    u = first["s"] / (first["n"] * rate)
    for _ in range(rounds):
        x = rows.agg(F.sum(F.when(F.col("r") < u, F.col("r")).otherwise(0.0)).alias("s"), F.count(F.when(F.col("r") >= u, 1)).alias("k")).first()
        left = first["n"] * rate - x["k"]
        if left <= 0 or not x["s"]:
            break
        new = x["s"] / left
        if abs(new - u) <= 1e-9 * u:
            break
        u = new
    return float(u)


def _take_share(ids: np.ndarray, g: np.ndarray, h: np.ndarray, rate: float, seed: int) -> np.ndarray:
    return (uniform(ids, seed) < rate).astype(float)


def _take_gradient(ids: np.ndarray, g: np.ndarray, h: np.ndarray, u: float, seed: int) -> np.ndarray:
    p = np.minimum(1, np.sqrt((g * g).sum(axis=1) + 0.1 * (h * h).sum(axis=1)) / u) if u else np.ones(len(ids))
    return np.where(uniform(ids, seed) < p, 1 / np.maximum(p, 1e-300), 0.0)


def _sampler(p: TreeParams, df: DataFrame, seed: int) -> Callable | None:
    if p.subsample >= 1:
        return None
    if p.sampling_method == "gradient_based":
        return functools.partial(_take_gradient, u=mvs_threshold(df, p.subsample), seed=seed)
    return functools.partial(_take_share, rate=p.subsample, seed=seed)


def stretches(df: DataFrame, features: list[str]) -> Cuts:
    """Stretches of values for the exact method, so many that each has a bounded number of rows apart from copies of a value."""
    cuts = build(df, features, max(STRETCHES, -(-df.count() // STRETCH_ROWS)))
    return replace(cuts, exact=True)


def train(params: dict, data: Data, rounds: int = 10, evals: dict[str, Data] | None = None, early_stopping_rounds: int = 0, maximise: bool | None = None, on_iteration: Callable[[int, dict], bool | None] | None = None, custom: Callable[[DataFrame], DataFrame] | None = None, start: Model | None = None, custom_metric: tuple[str, Callable[[DataFrame], float]] | None = None) -> Booster:
    """Train a booster.

    ``custom`` adds g and h (arrays) to a frame with margin and label; ``start`` is a model to go on from.
    Early stopping watches the last metric of the last set; the model keeps all rounds. ``on_iteration`` may return
    True to stop.
    """
    params = canonical(params)
    kind = params.get("booster", "gbtree")
    obj = objective(params.get("objective", "reg:squarederror"), {k: v for k, v in params.items() if k in OBJECTIVE | {"num_class"}})
    targets = data.targets()
    if custom is None:
        validate(data, obj)
    k = obj.outputs(targets)
    model = _new_model(params, data, obj, k, targets, custom, start)
    metrics = _metrics(params, obj, custom is not None)
    run = _linear_rounds if kind == "gblinear" else _update_rounds if params.get("process_type") == "update" else _tree_rounds
    if kind != "gblinear":
        updaters(params)
    held = [json.loads(model.attributes[a]) for a in TERMS if a in model.attributes]
    if len(held) == 2 and hasattr(obj, "bias") and obj.unbiased():
        obj.bias = (np.array(held[0]), np.array(held[1]))
    history: dict[str, dict[str, list[float]]] = {}
    best, best_at = None, 0
    for i, states in run(params, data, obj, model, rounds, evals or {}, custom, k, targets):
        line = f"[{i}]"
        if getattr(obj, "bias", None) is not None:
            model.attributes |= {a: json.dumps(t.tolist()) for a, t in zip(TERMS, obj.bias, strict=True)}
        last: tuple[Metric | None, float] = (None, float("nan"))
        for name, (frame, df) in states.items():
            shown = [F.col("margin")[j] for j in range(k)]
            pred = df.withColumn("pred", F.array(*(obj.eval_transform(shown) if custom is None else shown)))
            for m in metrics:
                v = m.value(pred, frame)
                history.setdefault(name, {}).setdefault(m.name, []).append(v)
                line += f"\t{name}-{m.name}:{v:.17f}"
                last = (m, v)
            if custom_metric:
                v = float(custom_metric[1](pred))
                history.setdefault(name, {}).setdefault(custom_metric[0], []).append(v)
                last = (None, v)
        if states:
            log.info(line)
        stop = bool(on_iteration and on_iteration(i, history))
        if early_stopping_rounds and states:
            up = maximise if maximise is not None else bool(last[0] and last[0].maximise)
            if best is None or (last[1] > best if up else last[1] < best):
                best, best_at = last[1], i
                model.attributes |= {"best_iteration": str(i), "best_score": repr(best)}
            stop = stop or i - best_at >= early_stopping_rounds
        if stop:
            break
    return Booster(model, history)


def _metrics(params: dict, obj: Objective, custom: bool) -> list[Metric]:
    names = params.get("eval_metric")
    names = [names] if isinstance(names, str) else list(names or [])
    if not names and not int(params.get("disable_default_eval_metric", 0)):
        names = ["rmse" if custom else obj.metric]
    return [metric(n, obj.params) for n in names]


def _new_model(params, data, obj, k, targets, custom, start) -> Model:
    if start is not None:
        return replace(start, trees=list(start.trees), tree_info=list(start.tree_info), indptr=list(start.indptr), weight_drop=list(start.weight_drop) if start.weight_drop is not None else None, attributes=dict(start.attributes))
    kind = params.get("booster", "gbtree")
    model = Model(obj.name, dict(obj.params), "gblinear" if kind == "gblinear" else "gbtree", len(data.features), int(params.get("num_class", 0) or 0), targets)
    model.base_score = [0.5] * k if custom is not None and "base_score" not in params else intercept(params, obj, data)
    model.weight_drop = [] if kind == "dart" else None
    model.parallel = int(params.get("num_parallel_tree", 1))
    model.feature_types = ["c" if c else "q" for c in data.flags()] if any(data.flags()) else []
    return model


#: Tree methods by the name of their updater.
GROWERS = {"grow_colmaker": "exact", "grow_histmaker": "approx", "grow_quantile_histmaker": "hist"}


def updaters(params: dict) -> list[str]:
    """Names in updater_seq or updater: for update those that change trees, else none or one that grows them."""
    names = [x.strip() for x in str(params.get("updater_seq") or params.get("updater") or "").split(",") if x.strip()]
    kind = params.get("process_type", "default")
    if kind not in ("default", "update"):
        raise ValueError("process_type is default or update")
    if kind == "update" and (not names or set(names) - {"refresh", "prune"}):
        raise ValueError("process_type update takes the updaters refresh and prune")
    if kind == "default" and names and (len(names) > 1 or names[0] not in GROWERS):
        raise ValueError(f"new trees take one updater of {', '.join(GROWERS)}")
    return names


def _update_rounds(params, data, obj, model, rounds, evals, custom, k, targets) -> Iterator[tuple[int, dict]]:
    """The trees of a model, round by round, with statistics and leaves of the data (refresh) or fewer splits (prune)."""
    p, names = tree_params(params), updaters(params)
    if model.weight_drop is not None or params.get("multi_strategy") == "multi_output_tree":
        raise ValueError("process_type update doesn't take dropout or vector leaves")
    if "refresh" in names and any(p.monotone_constraints):
        raise ValueError("refresh doesn't take monotone constraints")
    if rounds > model.rounds:
        raise ValueError(f"no more trees to update: the model has {model.rounds} rounds")
    p = replace(p, learning_rate=p.learning_rate / model.parallel)
    old, info, ends = model.trees, model.tree_info, model.indptr
    model.trees, model.tree_info, model.indptr = [], [], [0]
    base = [obj.to_margin(b) for b in model.base_score]
    frame = data.frame()
    state = _start(data.plain(), base).persist()
    sets = {name: (d, d.frame(), predict_margin(d, model, base)) for name, d in evals.items()}
    for i in range(rounds):
        part = replace(model, trees=old[ends[i] : ends[i + 1]], tree_info=info[ends[i] : ends[i + 1]], indptr=[0, ends[i + 1] - ends[i]])
        gh = custom(state) if custom is not None else obj.settle(obj.gradient(state, frame, targets).persist())
        for name in names:
            part = refresh(part, gh, p) if name == "refresh" else prune(part, p)
        first = len(model.trees)
        model.trees += part.trees
        model.tree_info += part.tree_info
        model.indptr.append(len(model.trees))
        state = add_margin(data, model, state, first, base, False)
        if (i + 1) % STORE_EVERY == 0:
            state = stored(state, "margins")
        state = state.persist()
        states = {}
        for name, (d, f, df) in sets.items():
            df = add_margin(d, model, df, first, base, False).persist()
            sets[name], states[name] = (d, f, df), (f, df)
        yield i, states


def _binned(model: Model, i: int, cuts: Cuts) -> BinnedTree:
    """A tree of the model with its splits as bins."""
    t = model.trees[i]
    if cuts.exact:
        return ValueTree(t, {})
    last = {n: int(np.searchsorted(cuts.values[t.feature[n]], t.cond[n], side="right")) - 1 for n in range(t.n) if t.left[n] >= 0 and n not in t.categories}
    return BinnedTree(t, last)


def _tree_rounds(params, data, obj, model, rounds, evals, custom, k, targets) -> Iterator[tuple[int, dict]]:
    p = tree_params(params)
    method = GROWERS[u[0]] if (u := updaters(params)) else params.get("tree_method", "auto")
    exact, approx = method == "exact", method == "approx"
    seed = int(params.get("seed", params.get("random_state", 0)))
    vector = params.get("multi_strategy") == "multi_output_tree"
    single = [[j] for j in range(k)] if not vector else [list(range(k))]
    outputs = [o for o in single for _ in range(model.parallel)]
    dart = model.weight_drop is not None
    cats = data.flags()
    if exact and any(cats):
        raise ValueError("the exact method doesn't take categorical features")
    base = [obj.to_margin(b) for b in model.base_score]
    fitted = {"plain": data.plain().select("row_id", *[F.col("x")[i].alias(f) for i, f in enumerate(data.features)], *(["weight"] if data.weight else []))}
    w = F.col("weight") if data.weight and not data.qid else None
    cuts = stretches(fitted["plain"], data.features) if exact else build(fitted["plain"], data.features, p.max_bin, cats, w)
    keep = ["label", "weight", "qid", "label_lower_bound", "label_upper_bound", "base_margin", *(["x"] if approx else [])]
    frame = data.frame()
    begin = _start(_encode(data, cuts, keep), base)
    if model.trees:
        begin = _from_model(data, model, begin, k)
    state = begin.persist()
    sets = {}
    for name, d in evals.items():
        sets[name] = (d, d.frame(), predict_margin(d, model, base))
    tables: dict[str | None, DataFrame] = {}  # margins stored last, by set (None: the training rows)
    for i in range(model.rounds, model.rounds + rounds):
        rng = np.random.default_rng([seed, i])
        factors = None
        work = state
        if dart and model.trees:
            factors = _drop(params, model, rng)
            if factors:
                work = _add_trees(state, [_binned(model, t, cuts) for t in factors], [_outputs_of(model, t, k, vector) for t in factors], cuts, [-model.weight_drop[t] for t in factors])
        gh = (custom(work) if custom is not None else obj.gradient(work, frame, targets)).persist()
        if custom is None:
            gh = obj.settle(gh)
        if approx:
            weighted = gh.select(*[F.col("x")[j].alias(f) for j, f in enumerate(data.features)], F.aggregate("h", F.lit(0.0), lambda a, x: a + x).alias("__h"))
            cuts = build(weighted, data.features, p.max_bin, cats, F.col("__h"))
            first = gh
            gh, state = _rebinned(gh, cuts).persist(), _rebinned(state, cuts)
        grown: list[BinnedTree] = []
        for _ in range(model.parallel):
            sample = _sampler(p, gh, seed * 1_000_003 + i * 1009 + len(grown))
            grown += grow(gh, cuts, p, single, rng, sample, 1 / model.parallel)
        order = [j * len(single) + s for s in range(len(single)) for j in range(model.parallel)]
        grown = [grown[x] for x in order]
        new = len(grown)
        weights = [1.0] * new
        if dart:
            weights = _normalise(params, model, factors or [], new)
        model.trees += [t.tree for t in grown]
        model.tree_info += [o[0] for o in outputs]
        model.indptr.append(len(model.trees))
        old = state
        if factors:
            changed = list(factors)
            before = _add_trees(work, [_binned(model, t, cuts) for t in changed], [_outputs_of(model, t, k, vector) for t in changed], cuts, [model.weight_drop[t] for t in changed])
            state = _add_trees(before, grown, outputs, cuts, weights)
        else:
            state = _add_trees(state, grown, outputs, cuts, weights)
        done = [gh, old, *([first] if approx else [])]
        store = (i + 1) % STORE_EVERY == 0
        before = dict(tables) if store else {}
        if store:
            state = tables[None] = stored(state, "margins")
        state = state.persist()
        names = {}
        for name, (d, f, df) in sets.items():
            done.append(df)
            df = add_margin(d, model, df, len(model.trees) - new, base, bool(factors))
            if store:
                df = tables[name] = stored(df, "margins")
            df = df.persist()
            sets[name] = (d, f, df)
            names[name] = (f, df)
        yield i, names
        for df in (state, *(x for _, x in names.values())):
            df.count()
        for df in done:
            df.unpersist()
        for df in before.values():
            remove(df)
    for df in (state, *(x for _, _, x in sets.values())):
        df.unpersist()


def _outputs_of(model: Model, t: int, k: int, vector: bool) -> list[int]:
    return list(range(k)) if vector else [model.tree_info[t]]


def _from_model(data: Data, model: Model, begin: DataFrame, k: int) -> DataFrame:
    """Margins of a frame under the trees that a model has already."""
    found = predict(model, data.plain(), output="margin").select("row_id", F.col("prediction").alias("__m"))
    return begin.drop("margin").join(found, "row_id").withColumnRenamed("__m", "margin")


def predict_margin(d: Data, model: Model, base: list[float]) -> DataFrame:
    """The plain frame of a set with its margin."""
    plain = d.plain()
    if not model.trees:
        return _start(plain, base)
    return predict(model, plain, output="margin").withColumnRenamed("prediction", "margin")


def add_margin(d: Data, model: Model, df: DataFrame, first: int, base: list[float], anew: bool) -> DataFrame:
    """Margins of a set after more trees; anew where weights of old trees changed."""
    if anew:
        return predict(model, df.drop("margin"), output="margin").withColumnRenamed("prediction", "margin")
    return predict(model, df, output="margin", trees=range(first, len(model.trees)), add_to="margin").drop("margin").withColumnRenamed("prediction", "margin")


def _drop(params: dict, model: Model, rng: np.random.Generator) -> list[int]:
    """Trees dropped this round."""
    if rng.random() < float(params.get("skip_drop", 0)):
        return []
    n, rate = len(model.trees), float(params.get("rate_drop", 0))
    w = np.array(model.weight_drop)
    share = np.minimum(1, rate * n * w / w.sum()) if params.get("sample_type", "uniform") == "weighted" and w.sum() > 0 else np.full(n, rate)
    found = np.flatnonzero(rng.random(n) < share).tolist()
    if not found and int(params.get("one_drop", 0)):
        found = [int(rng.choice(n, p=w / w.sum() if params.get("sample_type") == "weighted" else None))]
    return found


def _normalise(params: dict, model: Model, dropped: list[int], new: int) -> list[float]:
    """Scale the dropped trees and give the new ones their weight."""
    eta = np.float32(tree_params(params).learning_rate)
    lr = np.float32(eta / np.float32(new))
    n = np.float32(len(dropped))
    if not dropped:
        weight = np.float32(1)
    elif params.get("normalize_type", "tree") == "forest":
        factor = np.float32(1) / (np.float32(1) + lr)
        weight = factor
    else:
        factor = n / (n + lr)
        weight = np.float32(1) / (n + lr)
    if dropped:
        for t in dropped:
            model.weight_drop[t] = float(np.float32(model.weight_drop[t]) * factor)
    model.weight_drop += [float(weight)] * new
    return [float(weight)] * new


def _linear_rounds(params, data, obj, model, rounds, evals, custom, k, targets) -> Iterator[tuple[int, dict]]:
    base = [obj.to_margin(b) for b in model.base_score]
    m = len(data.features)
    if model.weights is None:
        model.weights = np.zeros((m + 1, k), np.float32)
    frame = data.frame()
    rows = data.plain().persist()
    sets = {name: (d.frame(), d.plain().persist()) for name, d in evals.items()}
    for i in range(model.linear_rounds, model.linear_rounds + rounds):
        at = linear.margins(_start(rows, base), model.weights, "base_margin" in rows.columns)
        gh = custom(at) if custom is not None else obj.settle(obj.gradient(at, frame, targets))
        largest = linear.step(gh, model.weights, params, np.random.default_rng([int(params.get("seed", 0)), i]))
        model.linear_rounds += 1
        yield i, {n: (f, linear.margins(_start(df, base), model.weights, True)) for n, (f, df) in sets.items()}
        if largest <= float(params.get("tolerance", 0)):
            break
    rows.unpersist()


def cross_validate(params: dict, data: Data, rounds: int = 10, folds: int = 3, early_stopping_rounds: int = 0, seed: int = 0) -> list[dict]:
    """Mean and population deviation of the metrics per round, over folds by hash of row_id; early stopping cuts the table."""
    fold = F.pmod(F.xxhash64(F.col(data.row_id), F.lit(seed)), F.lit(folds))
    runs = []
    for f in range(folds):
        fit, test = replace(data, df=data.df.where(fold != f)), replace(data, df=data.df.where(fold == f))
        runs.append(train(params, fit, rounds, {"train": fit, "test": test}).history)
    table = []
    for r in range(rounds):
        row: dict = {"round": r}
        for s in ("train", "test"):
            for name in runs[0][s]:
                v = [h[s][name][r] for h in runs]
                row |= {f"{s}-{name}-mean": float(np.mean(v)), f"{s}-{name}-std": float(np.std(v))}
        table.append(row)
    if early_stopping_rounds:
        name = list(runs[0]["test"])[-1]
        up = metric(name, params).maximise
        scores = [t[f"test-{name}-mean"] for t in table]
        best = 0
        for r, v in enumerate(scores):
            if v > scores[best] if up else v < scores[best]:
                best = r
            if r - best >= early_stopping_rounds:
                break
        table = table[: best + 1]
    return table

"""Step-by-step training: single rounds, evaluation lines, snapshots, configuration, callbacks and grid search."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlake import train as loops
from boostlake.functions.objectives import objective
from boostlake.model import VERSION, Model, json_text, ubj_bytes, ubj_value
from boostlake.operators.predict import predict
from boostlake.train import Data, canonical, cross_validate

#: Settings of the whole engine, with their defaults.
GLOBAL = {"verbosity": 1, "use_rmm": False}
_settings = dict(GLOBAL)


def version() -> tuple[int, ...]:
    """Version of the model format."""
    return tuple(VERSION)


def build_info() -> dict:
    """What the engine runs on."""
    import pyspark

    return {"engine": "spark", "spark": pyspark.__version__, "numpy": np.__version__, "model_version": list(VERSION)}


def set_config(**settings) -> None:
    """Change settings of the whole engine; unknown names are an error."""
    if unknown := sorted(set(settings) - set(GLOBAL)):
        raise ValueError(f"unknown settings {unknown}")
    _settings.update(settings)


def get_config() -> dict:
    return dict(_settings)


@dataclass
class Learner:
    """A model that is trained a round at a time.

    ``update`` uses the objective, ``boost`` given gradients (a function that adds the arrays g and h to a frame with margin
    and label). The sequence of random draws follows from the seed and the number of rounds, so that a
    snapshot goes on as the learner itself would.
    """

    params: dict
    model: Model | None = None
    _rounds: Iterator | None = field(default=None, repr=False)
    _data: Data | None = field(default=None, repr=False)
    _given: Callable[[DataFrame], DataFrame] | None = field(default=None, repr=False)

    def __post_init__(self):
        self.params = canonical(self.params)

    def set_param(self, name: str, value) -> None:
        """Change a parameter; it holds from the next round."""
        self.params = canonical({**self.params, name: value})
        self._rounds = None

    def _objective(self):
        return objective(self.params.get("objective", "reg:squarederror"), {k: v for k, v in self.params.items() if k in loops.OBJECTIVE | {"num_class"}})

    def _begin(self, data: Data) -> None:
        if self._rounds is not None and data is self._data:
            return
        obj, targets = self._objective(), data.targets()
        loops.validate(data, obj)
        k = obj.outputs(targets)
        if self.model is None:
            self.model = loops._new_model(self.params, data, obj, k, targets, None, None)
        frame = data.frame()

        def gradients(df: DataFrame) -> DataFrame:
            return self._given(df) if self._given is not None else obj.settle(obj.gradient(df, frame, targets).persist())

        kind = self.params.get("booster", "gbtree")
        if self.params.get("process_type") == "update":
            raise ValueError("process_type update goes through train()")
        run = loops._linear_rounds if kind == "gblinear" else loops._tree_rounds
        self._rounds, self._data = run(self.params, data, obj, self.model, 1 << 30, {}, gradients, k, targets), data

    def update(self, data: Data) -> int:
        """Train one round; returns its number."""
        self._given = None
        self._begin(data)
        return next(self._rounds)[0]

    def boost(self, data: Data, gradients: Callable[[DataFrame], DataFrame]) -> int:
        """Train one round on given gradients."""
        self._given = gradients
        self._begin(data)
        return next(self._rounds)[0]

    def evaluate(self, sets: dict[str, Data], round_: int | None = None) -> tuple[str, dict[str, dict[str, float]]]:
        """The evaluation line of the model as it is, and its values by set and metric."""
        if self.model is None:
            raise ValueError("nothing is trained yet")
        obj, values = self._objective(), {}
        line = f"[{self.model.rounds - 1 if round_ is None else round_}]"
        for name, d in sets.items():
            scored = predict(self.model, d.plain(), "margin").withColumnRenamed("prediction", "margin")
            shown = obj.eval_transform([F.col("margin")[j] for j in range(self.model.groups)])
            scored = scored.withColumn("pred", F.array(*shown))
            for m in loops._metrics(self.params, obj, False):
                v = m.value(scored, d.frame())
                values.setdefault(name, {})[m.name] = v
                line += f"\t{name}-{m.name}:{v:.17f}"
        return line, values

    def predict(self, data: Data, output: str = "value", **options) -> DataFrame:
        return predict(self.model, data.plain(), output, **options)

    def attr(self, name: str) -> str | None:
        return self.model.attributes.get(name)

    def set_attr(self, **attributes: str | None) -> None:
        """Set attributes of the model; None deletes one."""
        for k, v in attributes.items():
            if v is None:
                self.model.attributes.pop(k, None)
            else:
                self.model.attributes[k] = str(v)

    def attributes(self) -> dict[str, str]:
        return dict(self.model.attributes)

    def reset(self) -> None:
        """Forget margins and binned rows; model and parameters stay."""
        if self._rounds is not None:
            self._rounds.close()
        self._rounds = self._data = self._given = None

    def config(self) -> dict:
        """Full configuration as nested text values, by the part that uses it."""
        text = lambda names: {k: json.dumps(self.params[k]) if not isinstance(self.params[k], str) else self.params[k] for k in sorted(names) if k in self.params}
        grow = asdict(loops.tree_params(self.params))
        return {
            "learner": {
                "generic_param": text(loops.LEARNER - {"booster", "objective"}),
                "gradient_booster": {"name": self.params.get("booster", "gbtree"), "params": text(loops.BOOSTER), "tree_train_param": {k: json.dumps(v) for k, v in grow.items() if k in self.params}},
                "objective": {"name": self._objective().name, "params": text(loops.OBJECTIVE)},
            },
            "version": list(VERSION),
        }

    def load_config(self, config: dict) -> None:
        """Take over all parameters of ``config``; others go back to their defaults."""
        def value(v: str):
            try:
                return json.loads(v)
            except json.JSONDecodeError:
                return v

        parts = config["learner"]
        flat = {**parts["generic_param"], **parts["gradient_booster"]["params"], **parts["gradient_booster"]["tree_train_param"], **parts["objective"]["params"]}
        self.params = canonical({k: value(v) for k, v in flat.items()} | {"objective": parts["objective"]["name"], "booster": parts["gradient_booster"]["name"]})
        self.reset()

    def snapshot(self, kind: str = "ubj") -> bytes:
        """Model, configuration and the state of random draws (seed and rounds) in one piece."""
        both = {"Config": self.config(), "Model": self.model.to_json(), "Random": {"seed": str(self.params.get("seed", 0)), "rounds": str(self.model.rounds)}}
        return ubj_bytes(both) if kind == "ubj" else json_text(both).encode()

    @classmethod
    def restore(cls, content: bytes) -> Learner:
        """The learner of a snapshot."""
        d = json.loads(content) if content[1:2] in b'"\n\r\t }' else ubj_value(content)
        out = cls({})
        out.load_config(d["Config"])
        out.model = Model.from_json(d["Model"])
        if out.model.weight_drop is not None:
            out.params["booster"] = "dart"
        return out


class Callback:
    """Called around training; a true result of ``after_round`` stops it."""

    def before_training(self, learner: Learner) -> None: ...

    def after_round(self, learner: Learner, i: int, history: dict) -> bool | None: ...

    def after_training(self, learner: Learner) -> None: ...


@dataclass
class SaveBest(Callback):
    """After training the model is that of the best round of the last metric of the last set."""

    maximise: bool = False
    best: float | None = None
    at: int = 0

    def after_round(self, learner: Learner, i: int, history: dict) -> bool | None:
        v = list(list(history.values())[-1].values())[-1][-1]
        if self.best is None or (v > self.best if self.maximise else v < self.best):
            self.best, self.at = v, i

    def after_training(self, learner: Learner) -> None:
        if self.best is not None and learner.model.booster != "gblinear":
            learner.model = learner.model.slice(0, self.at + 1)
            learner.set_attr(best_iteration=str(self.at), best_score=repr(self.best))
            learner.reset()


@dataclass
class Checkpoint(Callback):
    """Hands over a snapshot every ``every`` rounds; ``write`` takes (round, bytes) and stores them where it likes."""

    write: Callable[[int, bytes], None]
    every: int = 10

    def after_round(self, learner: Learner, i: int, history: dict) -> bool | None:
        if (i + 1) % self.every == 0:
            self.write(i, learner.snapshot())


def train_with(learner: Learner, data: Data, rounds: int, sets: dict[str, Data] | None = None, callbacks: list[Callback] = ()) -> dict:
    """Train with callbacks; returns the history by set and metric."""
    history: dict[str, dict[str, list[float]]] = {}
    for c in callbacks:
        c.before_training(learner)
    for _ in range(rounds):
        i = learner.update(data)
        for name, ms in (learner.evaluate(sets)[1] if sets else {}).items():
            for m, v in ms.items():
                history.setdefault(name, {}).setdefault(m, []).append(v)
        if any([c.after_round(learner, i, history) for c in callbacks]):
            break
    for c in callbacks:
        c.after_training(learner)
    return history


def grid_search(params: dict, grid: dict[str, list], data: Data, rounds: int = 10, folds: int = 3, seed: int = 0, maximise: bool = False) -> list[dict]:
    """Cross-validated score of every combination of ``grid``, best first: the last metric's mean over the test folds after
    the last round. Ties keep the order of the grid."""
    names, out = sorted(grid), []
    for values in itertools.product(*(grid[n] for n in names)):
        own = dict(zip(names, values, strict=True))
        last = cross_validate({**params, **own}, data, rounds, folds, seed=seed)[-1]
        metric = [k for k in last if k.startswith("test-") and k.endswith("-mean")][-1]
        out.append({"params": own, "score": last[metric], "metric": metric})
    return sorted(out, key=lambda r: -r["score"] if maximise else r["score"])

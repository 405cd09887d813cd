"""Training in rounds on metric columns: validation, early stop, history, checkpoints that a run goes on from.

The model is a small network over standardised columns with a quality and, where there are labels of it, a severity
output.  A round is one pass over the rows: each task sends the sums of its rows' gradients and losses, as decimals, so
that they add up to the same whatever their order, and a run that goes on from a checkpoint equals one that never stopped.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import METRIC_NAMES
from ..sources.files import opened, qualified
from .stats import written

# The published training recipe.
DECAY, CLIP, SEVERITY_WEIGHT = 1e-5, 1.0, 0.5
FACTOR, PLATEAU, THRESHOLD, PATIENCE, EVERY = 0.5, 5, 1e-4, 10, 5
BETAS, TINY = (0.9, 0.999), 1e-8


@dataclass
class Network:
    """Columns with their means and deviations, and the weights of ``hidden`` units (none: a linear model)."""

    features: list[str]
    mean: list[float]
    std: list[float]
    hidden: int = 0
    weights: list[float] = field(default_factory=list)
    target_mean: list[float] = field(default_factory=lambda: [0.0, 0.0])
    target_std: list[float] = field(default_factory=lambda: [1.0, 1.0])

    def shapes(self) -> list[tuple[int, int]]:
        """Of the matrices, each with a row more for the constant."""
        n = len(self.features)
        return [(n + 1, 2)] if not self.hidden else [(n + 1, self.hidden), (self.hidden + 1, 2)]

    def begin(self, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        parts = [rng.normal(0, 1 / math.sqrt(a), (a, b)) if self.hidden else np.zeros((a, b)) for a, b in self.shapes()]
        self.weights = np.concatenate([p.ravel() for p in parts]).tolist()
        return self

    def layers(self) -> list[np.ndarray]:
        flat, out, at = np.array(self.weights), [], 0
        for a, b in self.shapes():
            out.append(flat[at : at + a * b].reshape(a, b))
            at += a * b
        return out

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised columns and a constant; what is missing is the mean."""
        z = (x - np.array(self.mean)) / np.array(self.std)
        return np.c_[np.where(np.isfinite(z), z, 0.0), np.ones(len(x))]

    def outputs(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The inputs of each layer, and the two outputs in standard units."""
        first, *rest = self.layers()
        seen = [self.inputs(x)]
        z = seen[0] @ first
        for w in rest:
            seen.append(np.c_[np.tanh(z), np.ones(len(x))])
            z = seen[-1] @ w
        return seen, z

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.outputs(x)[1] * np.array(self.target_std) + np.array(self.target_mean)

    def judged(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of the squared errors of both outputs and of the absolute error of the first, sums of the gradients of both), severity only where it is known."""
        seen, z = self.outputs(x)
        gap = np.where(np.isfinite(y), z - (y - np.array(self.target_mean)) / np.array(self.target_std), 0.0)
        losses = np.array([(gap[:, 0] ** 2).sum(), (gap[:, 1] ** 2).sum(), np.abs(gap[:, 0]).sum() * self.target_std[0]])
        layers, grads = self.layers(), []
        for output in range(2):
            back = np.zeros_like(gap)
            back[:, output] = 2 * gap[:, output]
            own = []
            for w, s in zip(layers[::-1], seen[::-1], strict=True):
                own.append((s.T @ back).ravel())
                back = (back @ w[:-1].T) * (1 - s[:, :-1] ** 2)
            grads.append(np.concatenate(own[::-1]))
        return losses, np.stack(grads)


@dataclass
class State:
    """All that a run goes on from: model, optimiser, scheduler, best round, history."""

    model: Network
    epoch: int = 0
    rate: float = 0.05
    first: list[float] = field(default_factory=list)
    second: list[float] = field(default_factory=list)
    least: float = math.inf
    waited: int = 0
    best: float = math.inf
    stale: int = 0
    history: list[dict[str, float]] = field(default_factory=list)

    def step(self, gradient: np.ndarray) -> None:
        """One step of AdamW along a gradient whose length is bounded."""
        norm = float(np.sqrt((gradient**2).sum()))
        gradient = gradient * min(1.0, CLIP / (norm + 1e-6))
        m, v, w = (np.array(x or [0.0] * len(gradient)) for x in (self.first, self.second, self.model.weights))
        m, v = BETAS[0] * m + (1 - BETAS[0]) * gradient, BETAS[1] * v + (1 - BETAS[1]) * gradient**2
        t = self.epoch + 1
        w = w * (1 - self.rate * DECAY) - self.rate * (m / (1 - BETAS[0] ** t)) / (np.sqrt(v / (1 - BETAS[1] ** t)) + TINY)
        self.first, self.second, self.model.weights, self.epoch = m.tolist(), v.tolist(), w.tolist(), t

    def plateau(self, loss: float) -> None:
        """Half the rate after rounds without a gain."""
        if loss < self.least * (1 - THRESHOLD):
            self.least, self.waited = loss, 0
        else:
            self.waited += 1
        if self.waited > PLATEAU:
            self.rate, self.waited = self.rate * FACTOR, 0

    def save(self, path: str) -> None:
        """Written beside and moved into place, so that a reader never sees half of it."""
        system, inside = opened(path)
        system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inside + ".new") as out:
            out.write(json.dumps(asdict(self)).encode())
        system.move(inside + ".new", inside)

    @staticmethod
    def load(path: str) -> State:
        system, inside = opened(path)
        with system.open_input_stream(inside) as file:
            made = json.loads(file.read())
        return State(**made | {"model": Network(**made["model"])})


def sums_of(rows: DataFrame, model: Network) -> tuple[np.ndarray, np.ndarray]:
    """(2 x 5, 2 x weights): of training and of validation rows the numbers of both labels and the losses; of training rows the gradients of both outputs."""
    n = len(model.features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros((2, 5))
        grads = np.zeros((2, len(model.weights)))
        for batch in batches:
            table = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n + 2)], axis=1)
            held = batch.column(n + 2).to_numpy(zero_copy_only=False).astype(bool)
            for part in range(2):
                own = table[held == bool(part)]
                if not len(own):
                    continue
                losses, slopes = model.judged(own[:, :n], own[:, n:])
                told[part] += [*np.isfinite(own[:, n:]).sum(axis=0), *losses]
                if not part:
                    grads += slopes
        flat = np.concatenate([told.ravel(), grads.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array([f"{x:.12f}" for x in flat], pa.string())], names=["place", "value"])

    found = rows.mapInArrow(each, "place int, value string").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,12)")).alias("value"))
    flat = np.zeros(10 + 2 * len(model.weights))
    for r in found.collect():  # a number for each weight
        flat[r["place"]] = float(r["value"])
    return flat[:10].reshape(2, 5), flat[10:].reshape(2, -1)


def loss_of(told: np.ndarray) -> float:
    """Mean squared error of quality, and half of that of severity."""
    return float(told[2] / told[0] + (SEVERITY_WEIGHT * told[3] / told[1] if told[1] else 0.0))


def train(
    rows: DataFrame, epochs: int, folder: str, label: str = "quality_score", severity: str | None = None, held_out: str | None = None, features: Sequence[str] = METRIC_NAMES,
    hidden: int = 0, rate: float = 0.05, patience: int = PATIENCE, seed: int = 42, resume: str | None = None,
) -> State:
    """Fit scores to columns for ``epochs`` rounds at most; the result is the last state, its history has an entry a round.

    Rows without the label are left out, none at all raises; ``held_out`` names a boolean column of
    validation rows.  A round takes one step along the mean gradient of the training rows and is judged on the validation rows, or on the
    training rows where there are none.  The rate halves after six rounds without a gain, and the run stops after ``patience``
    rounds without a lower loss.  In ``folder`` are best_model.json, checkpoint_epoch_<n>.json every five rounds and at the end, and
    training_history.json.  ``resume`` names a checkpoint to go on from, whose model and columns are then used.  The
    columns are written once; losses are in standard units of the labels, the absolute error in the label's own.
    """
    if epochs <= 0:
        raise ValueError(f"the number of rounds has to be positive, not {epochs}")
    resume = resume and qualified(rows.sparkSession, resume)
    used = State.load(resume).model.features if resume else list(features)
    asked = F.lit(False) if held_out is None else F.coalesce(F.col(held_out).cast("boolean"), F.lit(False))
    other = F.lit(None).cast("double") if severity is None else F.col(severity).cast("double")
    table = written(rows.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(used)], F.col(label).cast("double").alias("label"), other.alias("severity"), asked.alias("held")), "training")
    if resume:
        state = State.load(resume)
    else:
        numbers = [f"x{i}" for i in range(len(used))] + ["label", "severity"]
        whole = table.where(~F.col("held")).agg(*[F.round(f(c), 12).alias(f"{k}{c}") for c in numbers for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        if whole["mlabel"] is None:
            raise RuntimeError(f"no training row has a {label}")
        mean, std = ([whole[f"{k}{c}"] for c in numbers] for k in "ms")
        safe = [s if s else 1.0 for s in std]
        model = Network(used, [m or 0.0 for m in mean[:-2]], safe[:-2], hidden, target_mean=[m or 0.0 for m in mean[-2:]], target_std=safe[-2:])
        state = State(model.begin(seed), rate=rate)
    told, slopes = sums_of(table, state.model)
    if not told[0, 0]:
        raise RuntimeError(f"no training row has a {label}")
    folder = qualified(rows.sparkSession, folder.rstrip("/"))
    while state.epoch < epochs and state.stale < patience:
        taught = loss_of(told[0])
        gradient = slopes[0] / told[0, 0] + (SEVERITY_WEIGHT * slopes[1] / told[0, 1] if told[0, 1] else 0.0)
        state.step(gradient)
        told, slopes = sums_of(table, state.model)
        judge = told[1] if told[1, 0] else told[0]
        loss = loss_of(judge)
        state.history.append({"epoch": state.epoch, "train_loss": taught, "val_loss": loss, "val_mae": float(judge[4] / judge[0]), "learning_rate": state.rate})
        state.plateau(loss)
        better = loss < state.best
        state.best, state.stale = (loss, 0) if better else (state.best, state.stale + 1)
        if better:
            state.save(f"{folder}/best_model.json")
        if state.epoch % EVERY == 0:
            state.save(f"{folder}/checkpoint_epoch_{state.epoch}.json")
    state.save(f"{folder}/checkpoint_epoch_{state.epoch}.json")
    system, inside = opened(f"{folder}/training_history.json")
    with system.open_output_stream(inside) as out:
        out.write(json.dumps(state.history).encode())
    return state


def history(spark: SparkSession, state: State) -> DataFrame:
    """(epoch, train_loss, val_loss, val_mae, learning_rate): a row a round."""
    rows = [(int(h["epoch"]), h["train_loss"], h["val_loss"], h["val_mae"], h["learning_rate"]) for h in state.history]
    return spark.createDataFrame(rows, "epoch int, train_loss double, val_loss double, val_mae double, learning_rate double")


def predict(model: Network, rows: DataFrame) -> DataFrame:
    """The rows with ``dl_score`` (0 to 100) and ``dl_severity`` (0 to 10)."""

    @F.pandas_udf("dl_score double, dl_severity double")
    def outputs(*columns: pd.Series) -> pd.DataFrame:
        x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns], axis=1)
        made = model.predict(x)
        return pd.DataFrame({"dl_score": made[:, 0].clip(0, 100), "dl_severity": made[:, 1].clip(0, 10)})

    own = outputs(*[F.col(c).cast("double") for c in model.features])
    return rows.select("*", own.alias("_made")).select(*rows.columns, "_made.dl_score", "_made.dl_severity")

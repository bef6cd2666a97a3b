"""Logistic probes of many labels on one embedding table, fitted together.

Limited-memory quasi-Newton steps: each pass over the training rows gives the loss and the
gradient of every label at its own trial point. A task sums ``labels x width`` numbers, the
tasks' sums are added up by label in a second stage, and the driver keeps the last steps
and gradient changes of each label (``labels x width x memory``). No Hessian is formed.
The state is carried from one call of :meth:`LabelProbe.run` to the next, so an epoch
starts where the last one ended.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.session import materialize

#: Labels of one probe; a longer list is fitted by several probes.
MOST_LABELS = 4096
#: Passes that one iteration may spend on shortening steps.
HALVINGS = 12


def _inputs(part) -> np.ndarray:
    return np.column_stack([np.vstack(part["x"]), np.ones(len(part))])


def _dense(part, n_labels: int) -> np.ndarray:
    """Labels of a part's rows; NaN where a row has no such label."""
    y = np.full((len(part), n_labels), np.nan)
    for i, (at, values) in enumerate(zip(part["at"], part["y"])):
        y[i, at] = values
    return y


class LabelProbe:
    """One logistic regression for each (task, item) of ``targets``.

    ``targets``: ``task, client_id, item, label`` (0 or 1); a client counts for the labels
    it has a row for. ``embeddings``: ``client_id, embedding``. Minimises the mean log loss
    plus ``ridge / 2`` times the squared weights; clients without embedding do not count.
    """

    def __init__(self, targets: DataFrame, embeddings: DataFrame, ridge: float = 1e-3, memory: int = 8):
        keys = targets.select("task", "item").distinct().orderBy("task", "item").limit(MOST_LABELS + 1).collect()
        if len(keys) > MOST_LABELS:
            raise ValueError(f"more than {MOST_LABELS} labels: fit them by several probes")
        self.labels = [(r["task"], r["item"]) for r in keys]
        self.ridge, self.memory = ridge, memory
        self.rows = materialize(self._rows(targets, embeddings))
        width = (self.rows.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0) + 1
        shape = (len(self.labels), width)
        self.weights = np.zeros(shape)
        self.steps: list[np.ndarray] = []
        self.changes: list[np.ndarray] = []
        self.loss, self.gradient = self._pass(self.weights) if self.labels else (np.zeros(0), np.zeros(shape))

    def _rows(self, targets: DataFrame, embeddings: DataFrame) -> DataFrame:
        """``client_id, x, at, y``: the labels of a client by their place (at most MOST_LABELS)."""
        spark = targets.sparkSession
        place = spark.createDataFrame([(t, i, k) for k, (t, i) in enumerate(self.labels)], "task string, item long, _at int")
        per = (targets.join(F.broadcast(place), ["task", "item"])
               .groupBy("client_id").agg(F.collect_list(F.struct("_at", F.col("label").cast("int").alias("y"))).alias("_t")))
        return per.join(embeddings, "client_id").select(
            "client_id", F.col("embedding").cast("array<double>").alias("x"), F.col("_t._at").alias("at"), F.col("_t.y").alias("y"))

    def _pass(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss and gradient of every label at ``weights``."""
        n_labels, width = weights.shape

        def sums(parts):
            import pandas as pd
            total = np.zeros((n_labels, width + 2))
            for part in parts:
                if len(part):
                    x, y = _inputs(part), _dense(part, n_labels)
                    seen = ~np.isnan(y)
                    y = np.where(seen, y, 0.0)
                    z = x @ weights.T
                    p = 0.5 * (1 + np.tanh(z / 2))
                    total[:, :width] += np.where(seen, p - y, 0).T @ x
                    total[:, width] += np.where(seen, np.logaddexp(0, z) - y * z, 0).sum(axis=0)
                    total[:, width + 1] += seen.sum(axis=0)
            yield pd.DataFrame({"label": np.arange(n_labels), "v": list(total)})

        def merged(parts):
            import pandas as pd
            held: dict[int, np.ndarray] = {}
            for part in parts:
                for label, v in zip(part["label"], part["v"]):
                    held[label] = held[label] + v if label in held else np.array(v)
            if held:
                yield pd.DataFrame({"label": list(held), "v": list(held.values())})

        schema = "label int, v array<double>"
        found = self.rows.mapInPandas(sums, schema).repartition("label").mapInPandas(merged, schema).collect()
        loss, gradient = np.zeros(n_labels), np.zeros((n_labels, width))
        for r in found:  # one row for each label
            v = np.array(r["v"])
            n = max(1.0, v[-1])
            w = weights[r["label"]]
            loss[r["label"]] = v[-2] / n + self.ridge / 2 * w @ w
            gradient[r["label"]] = v[:-2] / n + self.ridge * w
        return loss, gradient

    def _direction(self) -> np.ndarray:
        """The quasi-Newton direction of each label from its last steps."""
        dots = lambda a, b: np.einsum("lw,lw->l", a, b)
        q, used = self.gradient.copy(), []
        for s, c in zip(reversed(self.steps), reversed(self.changes)):
            curve = dots(s, c)
            rho = np.where(curve > 1e-12, 1 / np.where(curve > 1e-12, curve, 1), 0)
            alpha = rho * dots(s, q)
            q -= alpha[:, None] * c
            used.append((s, c, rho, alpha))
        if self.steps:
            s, c = self.steps[-1], self.changes[-1]
            size = dots(c, c)
            curve = dots(s, c)
            q *= np.where((size > 0) & (curve > 1e-12), curve / np.where(size > 0, size, 1), 1.0)[:, None]
        else:
            q /= np.maximum(1.0, np.linalg.norm(q, axis=1))[:, None]
        for s, c, rho, alpha in reversed(used):
            q += (alpha - rho * dots(c, q))[:, None] * s
        return -q

    def run(self, iterations: int, tolerance: float = 1e-7) -> int:
        """So many more iterations, or fewer once every gradient is below ``tolerance``."""
        for done in range(iterations):
            if not self.labels or np.abs(self.gradient).max() < tolerance:
                return done
            direction = self._direction()
            slope = np.einsum("lw,lw->l", self.gradient, direction)
            uphill = slope >= 0
            direction[uphill] = -self.gradient[uphill]
            slope[uphill] = -(self.gradient[uphill] ** 2).sum(axis=1)
            length = np.ones(len(self.labels))
            for _ in range(HALVINGS):
                trial = self.weights + length[:, None] * direction
                loss, gradient = self._pass(trial)
                short = loss > self.loss + 1e-4 * length * slope + 1e-15
                if not short.any():
                    break
                length[short] /= 2
            else:
                # a label that found no lower loss stays where it is
                trial[short], loss[short], gradient[short] = self.weights[short], self.loss[short], self.gradient[short]
            self.steps = [*self.steps, trial - self.weights][-self.memory :]
            self.changes = [*self.changes, gradient - self.gradient][-self.memory :]
            self.weights, self.loss, self.gradient = trial, loss, gradient
        return iterations

    def score(self, targets: DataFrame, embeddings: DataFrame) -> DataFrame:
        """``task, client_id, item, label, score`` (raw margin) of the rows of ``targets``
        whose label is known and whose client has an embedding."""
        weights, labels = self.weights, self.labels
        tasks, items = np.array([t for t, _ in labels], object), np.array([i for _, i in labels], np.int64)

        def scores(parts):
            import pandas as pd
            for part in parts:
                if len(part):
                    z = _inputs(part) @ weights.T
                    at = np.concatenate(list(part["at"])).astype(int)
                    row = np.repeat(np.arange(len(part)), [len(a) for a in part["at"]])
                    yield pd.DataFrame({"task": tasks[at], "client_id": part["client_id"].to_numpy()[row], "item": items[at],
                                        "label": np.concatenate(list(part["y"])), "score": z[row, at]})

        return self._rows(targets, embeddings).mapInPandas(scores, "task string, client_id long, item long, label int, score double")

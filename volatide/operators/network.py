"""What small numpy networks share: training by Adam with early stopping, alone, by tasks that exchange gradients, or in shards."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame


def sum_over_tasks(numbers: np.ndarray) -> np.ndarray:
    """The sum of an array over the tasks of a barrier stage, in the same order everywhere."""
    said = BarrierTaskContext.get().allGather(base64.b64encode(np.asarray(numbers, float).tobytes()).decode())
    return np.sum([np.frombuffer(base64.b64decode(x)) for x in said], axis=0)


#: Parts that an array is summed in.
PARTS = 16


def in_parts(shard: int, numbers: np.ndarray) -> pa.RecordBatch:
    """An array of a task, as rows for `summed_parts`."""
    return pa.RecordBatch.from_arrays([pa.array([shard] * PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in np.array_split(numbers, PARTS)], pa.binary())], ["shard", "i", "part"])


def summed_parts(parts: DataFrame) -> np.ndarray:
    """The sum of the arrays of all shards, added up by the executors in the order of the shards; the driver gets one array."""

    def run(batches):
        now, total = None, np.zeros(0)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "part"])
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != now:
                    if now is not None:
                        yield row()
                    now, total = i, np.zeros(len(part) // 8)
                total = total + np.frombuffer(part)
        if now is not None:
            yield row()

    found = parts.repartition("i").sortWithinPartitions("i", "shard").select("i", "part").mapInArrow(run, "i int, part binary").collect()  # PARTS rows
    return np.concatenate([np.frombuffer(r["part"]) for r in sorted(found, key=lambda r: r["i"])])


class Network:
    """Weights `w` by name; subclasses give `gradient` (mean loss and its derivatives) and `loss` (a sum)."""

    w: dict[str, np.ndarray]

    def gradient(self, x, y) -> tuple[float, dict[str, np.ndarray]]:
        raise NotImplementedError

    def loss(self, x, y) -> float:
        raise NotImplementedError

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([w.ravel() for w in self.w.values()])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for k, w in self.w.items():
            self.w[k] = flat[at : at + w.size].reshape(w.shape).copy()
            at += w.size

    def one_pass(self, x, y, memory: np.ndarray, batch: int, rate: float, rng: np.random.Generator) -> np.ndarray:
        """Adam over all rows once, in random order. `memory` is both moments and the number of steps behind them; gives what they are now."""
        first, second, step, w = *np.split(memory[:-1], 2), memory[-1], self.flat()
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            _, found = self.gradient(x[own], y[own])
            g, step = np.concatenate([found[k].ravel() for k in self.w]), step + 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
            w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            self.put(w)
        return np.concatenate([first, second, [step]])

    def train(self, x, y, vx, vy, epochs: int = 30, batch: int = 32, rate: float = 1e-3, patience: int = 5, seed: int = 0, summed=None, worker: int = 0, workers: int = 1) -> list[float]:
        """Losses of the epochs, on the validation rows where there are any.

        With several workers each has its own rows and takes its share of every batch; `summed` adds up an array of
        numbers over all of them, so that all make the same steps.
        """
        summed = summed or (lambda numbers: numbers)
        most = int(summed(np.eye(workers)[worker] * len(x)).max())
        share = max(1, batch // workers)
        rng = np.random.default_rng(seed if workers == 1 else [seed, worker])
        names, sizes = list(self.w), np.cumsum([0, *(w.size for w in self.w.values())])
        first, second = (np.zeros(sizes[-1]) for _ in range(2))
        kept, best, waited, step, losses = {k: v.copy() for k, v in self.w.items()}, np.inf, 0, 0, []
        has_val = summed(np.array([float(len(vx))]))[0] > 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, most, share):
                step += 1
                own = order[at : at + share]
                total = np.zeros(sizes[-1] + 1)
                if len(own):
                    _, g = self.gradient(x[own], y[own])
                    total = np.append(np.concatenate([g[k].ravel() for k in names]), 1.0) * len(own)
                total = summed(total)
                g = total[:-1] / total[-1]
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
                change = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                for i, k in enumerate(names):
                    self.w[k] = self.w[k] - change[sizes[i] : sizes[i + 1]].reshape(self.w[k].shape)
            a, b = (vx, vy) if has_val else (x, y)
            total = summed(np.array([self.loss(a, b), len(a)]))
            losses.append(float(total[0] / total[1]))
            if losses[-1] < best - 1e-12:
                best, waited, kept = losses[-1], 0, {k: v.copy() for k, v in self.w.items()}
            else:
                waited += 1
                if waited >= patience:
                    break
        self.w = kept
        return losses

"""Boosted trees over binned vectors, their scores and their Shapley values.

*Training table*: Spark finds the cut points of every feature (quantiles over
all rows), bins the rows and adds up the labels of rows that fall into the same
bins.  Second-order boosting only needs these sums, so the fit over the distinct
vectors equals the fit over all binned rows.  Every vector enters its fit.

*Fits*: independent fits (folds, targets) are groups of one Spark job and grow
side by side, each in a task of its own while none has more than ``TASK_VECTORS``
vectors.  Beyond that the vectors of all fits are dealt over the tasks of one barrier stage,
which grow the same trees in step: a task adds up its own vectors, and the sums over all tasks
(``Exchange``), whose size is bounded by nodes and bins, give each of them the same splits.
Trees are complete up to ``depth``: node i has the children 2i+1 (value <= cut) and
2i+2; a leaf has feature -1.  Leaves take -G / (H + 1); a child needs H >= ``min_hessian``.

*Model*: a table of nodes (fit, tree, output, node, feature, cut, value, cover,
gain), stored as Parquet; for scoring it is a few arrays whose size is trees
times 2**(depth + 1), whatever the number of rows.

*Shapley values* are path-dependent: an absent feature is averaged over both
children by their cover.  For each leaf a table over the patterns of satisfied
conditions (2**depth) holds its part of each feature's value; the tables of neighbouring
leaves are added up, so a row costs one lookup for each low subtree.
"""

from __future__ import annotations

import base64
import time
import uuid
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ripple.session import scratch_path

N_TREES, DEPTH, RATE = 300, 6, 0.05
BINS = 64
TASK_VECTORS = 200_000          # distinct binned vectors of a fit that grows in one task
SHARE_VECTORS = 50_000          # at least, of each task where the vectors of the fits are dealt over tasks
SLICED = 8192                   # numbers beyond which each task adds up its own slice of them
L2, MIN_HESSIAN = 1.0, 1.0
FIT_RANGES = 64                 # at most, a range holds no less than one fit: more than there are fits
ROWS, SHAP_ROWS = 128, 8192     # rows scored at once
SHAP_BATCH = 65_536             # rows that share the tables of a tree
LOWER = 2                       # levels of splits whose leaves share a table of Shapley values
NODE_SCHEMA = ("fit string, tree int, output int, node int, feature int, cut double, value double, cover double, "
               "gain double")


@dataclass(frozen=True)
class Spec:
    """One kind of fit: features, objective (binary, classes, poisson), number of outputs and size.

    With ``stop`` the number of trees (``n_trees`` at most) is the one with the least
    loss on a fifth of the vectors, by trees grown on the others; the fit then takes all.
    """
    features: tuple
    objective: str
    outputs: int = 1
    n_trees: int = N_TREES
    depth: int = DEPTH
    rate: float = RATE
    min_hessian: float = MIN_HESSIAN
    stop: bool = False


def cut_points(df: DataFrame, features, bins: int = BINS) -> dict[str, list[float]]:
    """Up to ``bins - 1`` values of each feature, at its quantiles over all rows."""
    probs = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    row = df.agg(*(F.percentile_approx(F.col(f).cast("double"), probs, 20 * bins).alias(f) for f in features)).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def binned(df: DataFrame, features, cuts: dict[str, list[float]]) -> "F.Column":
    """The bin of each feature: the number of cut points below its value."""
    def place(f):
        return F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: c < F.col(f))) if cuts[f] else F.lit(0)
    return F.array(*map(place, features))


def vectors(df: DataFrame, features, cuts, sums: dict, keys=()) -> DataFrame:
    """``keys, bins, stats``: the sums of rows that share their bins."""
    return (df.select(*keys, binned(df, features, cuts).alias("bins"), *(c.cast("double").alias(k) for k, c in sums.items()))
            .groupBy(*keys, "bins").agg(*(F.sum(k).alias(k) for k in sums))
            .select(*keys, "bins", F.array(*sums).alias("stats")))


def _gradients(spec: Spec, f: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss (vectors by outputs); binary: stats are (negatives, positives)."""
    if spec.objective == "binary":
        p, w = 1 / (1 + np.exp(-f)), stats.sum(axis=1, keepdims=True)
        return w * p - stats[:, 1:], w * np.maximum(p * (1 - p), 1e-16)
    if spec.objective == "classes":
        e = np.exp(f - f.max(axis=1, keepdims=True))
        p, w = e / e.sum(axis=1, keepdims=True), stats.sum(axis=1, keepdims=True)
        return w * p - stats, np.maximum(2 * w * p * (1 - p), 1e-16)
    mu = stats[:, :1] * np.exp(f)                                    # stats are (rows, sum of counts)
    return mu - stats[:, 1:], np.maximum(mu, 1e-16)


# Whoever grows a tree yields the sums of its own vectors (a list of arrays) and is sent the sums over all tasks.
Sums = Generator[list, list, object]


def _alone(growing: Sums):
    """The result of one who has all the vectors: its own sums are those of all."""
    found = None
    while True:
        try:
            found = growing.send(found)
        except StopIteration as end:
            return end.value


def _side_by_side(growing: list[Sums]) -> Sums:
    """The results of all, in step: what they ask for at a time is asked for at once."""
    results, asked, got = [None] * len(growing), {}, dict.fromkeys(range(len(growing)))
    while got:
        for i, sums in got.items():
            try:
                asked[i] = growing[i].send(sums)
            except StopIteration as end:
                results[i] = end.value
                asked.pop(i, None)
        if not asked:
            break
        found = iter((yield [a for own in asked.values() for a in own]))
        got = {i: [next(found) for _ in own] for i, own in asked.items()}
    return results


def _start(spec: Spec, stats: np.ndarray) -> Sums:
    """The score before the first tree."""
    if spec.objective != "poisson":
        return 0.0
    (rows, events), = yield [np.array([stats[:, 0].sum(), stats[:, 1].sum()])]
    return float(np.log(max(events, 1e-6) / max(rows, 1e-6)))


def _bin_sums(code: np.ndarray, offset: np.ndarray, own: np.ndarray, node: np.ndarray, weights, count: int) -> list[np.ndarray]:
    """Sums of each of ``weights`` over the vectors ``own``, by the ``node`` of each (of ``count``) and the bins."""
    # feature by feature: no copy of the weights for each of them, and the sums of a few nodes and bins stay in cache
    sums, weights = [np.empty((count, int(offset[-1]))) for _ in weights], [w[own] for w in weights]
    for j, size in enumerate(np.diff(offset)):
        slot = code[:, j].take(own).astype(np.intp, copy=False)
        slot += node * size - offset[j]
        for s, w in zip(sums, weights):
            s[:, offset[j]:offset[j + 1]] = np.bincount(slot, w, count * size).reshape(count, size)
    return sums


def _grow(code: np.ndarray, offset: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float,
          min_hessian: float = MIN_HESSIAN):
    """One tree from all its vectors in one place."""
    return _alone(_growing(code, offset, g, h, depth, rate, min_hessian))


def _growing(code: np.ndarray, offset: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float,
             min_hessian: float) -> Sums:
    """One tree: feature, bin, value, cover and gain of each node, and the node each vector ends in.

    ``code`` is bin plus ``offset`` of its feature (vectors by features).
    """
    n, m = code.shape
    width, size = int(offset[-1]), 2 ** (depth + 1) - 1
    feature, cut = np.full(size, -1), np.zeros(size, int)
    value, cover, gain = np.zeros(size), np.zeros(size), np.zeros(size)
    at, own = np.zeros(n, int), np.arange(n)                          # node of each vector; those still in a growing node
    owner = np.repeat(np.arange(m), np.diff(offset))
    last = np.zeros(width, bool)
    last[offset[1:] - 1] = True                                       # nothing lies above the last bin
    for level in range(depth + 1):
        first, count = 2 ** level - 1, 2 ** level
        local = at[own] - first
        rows, big_g, big_h = yield [np.bincount(local, minlength=count), *(np.bincount(local, w[own], count) for w in (g, h))]
        value[first:first + count] = -rate * big_g / (big_h + L2)
        cover[first:first + count] = big_h
        if level == depth or not rows.any():
            break
        # of two children only the one with fewer vectors is added up: the other has what is left of their parent
        added = np.ones(count, bool)
        if level:
            fewer = rows[::2] <= rows[1::2]
            added = np.c_[fewer, ~fewer].ravel() & np.repeat(split, 2)
        place, some = np.cumsum(added) - 1, added[local]
        found = yield _bin_sums(code, offset, own[some], place[local[some]], (g, h), int(added.sum()))
        if level:
            nodes, parents = np.flatnonzero(added), np.flatnonzero(split)
            for i, s in enumerate(found):
                both = np.zeros((count, width))
                both[nodes], both[nodes ^ 1] = s, sums[i][parents] - s
                found[i] = both
        sums = found
        # running sums inside each feature
        left = []
        for s in sums:
            c = np.cumsum(s, axis=1)
            before = np.c_[np.zeros(count), c][:, offset[:-1]]
            left.append(c - before[:, owner])
        lg, lh = left
        rg, rh = big_g[:, None] - lg, big_h[:, None] - lh
        score = lg * lg / (lh + L2) + rg * rg / (rh + L2) - (big_g * big_g / (big_h + L2))[:, None]
        score[(lh < min_hessian) | (rh < min_hessian) | last[None, :]] = -np.inf
        # the first of the splits that are as good up to rounding, so that sums in another order give the same tree
        peak = score.max(axis=1, keepdims=True)
        best = (score >= peak - 1e-9 * np.abs(peak)).argmax(axis=1)
        won = score[np.arange(count), best]
        split = won > 1e-9
        nodes = first + np.flatnonzero(split)
        feature[nodes], cut[nodes] = owner[best[split]], best[split] - offset[owner[best[split]]]
        gain[nodes] = won[split]
        own = own[split[at[own] - first]]
        f = feature[at[own]]
        right = code[own, f] - offset[f] > cut[at[own]]
        at[own] = 2 * at[own] + 1 + right
    return feature, cut, value, cover, gain, at


def _loss(spec: Spec, f: np.ndarray, stats: np.ndarray) -> float:
    """Minus the log-likelihood, up to a constant."""
    if spec.objective == "poisson":
        return float((stats[:, 0] * np.exp(f[:, 0]) - stats[:, 1] * f[:, 0]).sum())
    if spec.objective == "binary":
        return float((stats.sum(axis=1) * np.logaddexp(0, f[:, 0]) - stats[:, 1] * f[:, 0]).sum())
    return float((stats.sum(axis=1) * np.logaddexp.reduce(f, axis=1) - (stats * f).sum(axis=1)).sum())


def _boost(spec: Spec, code: np.ndarray, offset: np.ndarray, stats: np.ndarray, grown: np.ndarray, n_trees: int,
           after=None) -> Sums:
    """The score before the first tree, and the trees of each round grown on the vectors ``grown``.

    ``after`` each round is given the scores of all vectors.
    """
    start = yield from _start(spec, stats[grown])
    f, rounds = np.full((len(code), spec.outputs), start), []
    for _ in range(n_trees):
        g, h = _gradients(spec, f, stats)
        found = yield from _side_by_side([
            _growing(code, offset, g[:, o] * grown, h[:, o] * grown, spec.depth, spec.rate, spec.min_hessian)
            for o in range(spec.outputs)])
        for o, (*tree, at) in enumerate(found):
            f[:, o] += tree[2][at]
        rounds.append([tree for *tree, _ in found])
        if after:
            after(f)
    return start, rounds


def _shuffled_fifth(bins: np.ndarray) -> np.ndarray:
    """A fifth of all the vectors: they are in the order of their bins, a shuffle with a fixed seed deals the fifths."""
    return np.random.default_rng(0).permutation(len(bins)) % 5 == 0


def _hashed_fifth(bins: np.ndarray) -> np.ndarray:
    """A fifth of the vectors, whichever of them are at hand: by a hash of their bins."""
    x = np.zeros(len(bins), np.uint64)
    for column in bins.T:
        x = (x ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x % np.uint64(5) == 0


def fit(name: str, spec: Spec, cuts: dict[str, list[float]], bins: np.ndarray, stats: np.ndarray) -> list[tuple]:
    """The node rows of one fit over vectors and their sums."""
    return _alone(_fitting(name, spec, cuts, bins, stats, _shuffled_fifth))


def _fitting(name: str, spec: Spec, cuts: dict[str, list[float]], bins: np.ndarray, stats: np.ndarray, fifth) -> Sums:
    sizes = [len(cuts[f]) + 1 for f in spec.features]
    offset = np.r_[0, np.cumsum(sizes)]
    code = np.empty(bins.shape, np.int16 if offset[-1] < 1 << 15 else np.int64, order="F")      # a tree adds up one feature at a time
    np.add(bins, offset[:-1], out=code, casting="unsafe")
    every, n_trees, held = np.ones(len(bins), bool), spec.n_trees, fifth(bins) if spec.stop else None
    (n,), (weight,) = yield [np.array([len(bins)]), np.array([stats.sum()])]
    del bins
    if spec.stop and n >= 100:
        losses = []
        yield from _boost(spec, code, offset, stats, ~held, n_trees, lambda f: losses.append(_loss(spec, f[held], stats[held])))
        losses, = yield [np.array(losses)]
        n_trees = int(np.argmin(losses)) + 1
    start, rounds = yield from _boost(spec, code, offset, stats, every, n_trees)
    rows = [(name, -1, o, 0, -1, None, start, float(weight), 0.0) for o in range(spec.outputs)]
    for t, trees in enumerate(rounds):
        for o, (feature, cut, value, cover, gain) in enumerate(trees):
            for i in np.flatnonzero(cover > 0):
                j = int(feature[i])
                rows.append((name, t, o, int(i), j, None if j < 0 else cuts[spec.features[j]][cut[i]], float(value[i]),
                             float(cover[i]), float(gain[i])))
    return rows


class Exchange:
    """Sums over the tasks of a barrier stage, by files in a folder that all of them share.

    Each task writes its numbers and reads those of the others; of many numbers it adds up a
    slice and reads the other slices.  The tasks are added up in one order, so all of them get
    the same sums.  A folder that only Spark reads leaves the stage's ``allGather``, which takes
    about a second each time.
    """

    def __init__(self, folder: str, task: BarrierTaskContext, tasks: int):
        self.task, self.me, self.tasks, self.round, self.old = task, task.partitionId(), tasks, 0, []
        folder = f"{folder}/{task.allGather(uuid.uuid4().hex)[0]}"      # a stage that is run again starts in a new one
        try:
            self.files, self.base = fs.FileSystem.from_uri(folder) if "://" in folder else (
                fs.LocalFileSystem(), folder.removeprefix("file:"))
            self.files.create_dir(self.base)
        except (pa.ArrowException, OSError, ImportError):
            self.files = None
        if not all(task.allGather("files" if self.files else "")):
            self.files = None

    def _put(self, name: str, numbers: np.ndarray) -> str:
        path = f"{self.base}/{name}-{self.me}"
        with self.files.open_output_stream(f"{path}.part") as out:
            out.write(numbers.tobytes())
        self.files.move(f"{path}.part", path)            # whole as soon as it is there
        return path

    def _get(self, name: str, task: int, first: int, last: int) -> np.ndarray:
        while True:                                      # a task that fails ends the whole stage, and this one with it
            try:
                with self.files.open_input_file(f"{self.base}/{name}-{task}") as own:
                    return np.frombuffer(own.read_at((last - first) * 8, first * 8))
            except FileNotFoundError:
                time.sleep(0.0005)

    def sums(self, own: np.ndarray) -> np.ndarray:
        if not self.files:
            return sum(np.frombuffer(base64.b64decode(x)) for x in self.task.allGather(base64.b64encode(own.tobytes()).decode()))
        self.round += 1
        new = [self._put(f"{self.round}-own", own)]
        sliced = len(own) > SLICED
        ends = [len(own) * k // self.tasks for k in range(self.tasks + 1)]
        first, last = ends[self.me:self.me + 2] if sliced else (0, len(own))
        total = sum(self._get(f"{self.round}-own", k, first, last) for k in range(self.tasks))
        if sliced:
            new.append(self._put(f"{self.round}-sum", total))
            total = np.concatenate([self._get(f"{self.round}-sum", k, 0, ends[k + 1] - ends[k]) for k in range(self.tasks)])
        # all tasks are in this round, so none of them reads files of an earlier one
        for path in self.old:
            self.files.delete_file(path)
        self.old = new
        return total

    def run(self, growing: Sums):
        """The result of ``growing``, sent the sums over all tasks."""
        found = None
        while True:
            try:
                asked = growing.send(found)
            except StopIteration as end:
                return end.value
            total = self.sums(np.concatenate([np.ravel(a).astype(float) for a in asked]))
            places = np.cumsum([a.size for a in asked])[:-1]
            found = [part.reshape(a.shape) for part, a in zip(np.split(total, places), asked)]


def _arrays(own: pa.Table, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Bins and sums of a fit's vectors in one order, whatever order they arrive in."""
    bins, stats = (own.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("bins", "stats"))
    bins, stats = bins.reshape(-1, len(spec.features)), stats.reshape(-1, spec.outputs if spec.objective == "classes" else 2)
    order = np.lexsort(bins.T[::-1])
    return bins[order], stats[order]


def _node_table(rows: list[tuple]) -> pa.Table:
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *(pa.float64(),) * 4)
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                    names=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def train(table: DataFrame, specs: dict[str, Spec], cuts: dict[str, dict], max_vectors: int | None = None,
          task_vectors: int = TASK_VECTORS) -> DataFrame:
    """The node table of all fits of table(fit, kind, bins, stats).

    ``specs`` and ``cuts`` are looked up by ``kind``.  Fits of up to ``task_vectors`` vectors are
    one task each; if one has more, all fits grow in step, over tasks that each hold a share of
    their vectors.  A fit takes all its vectors, unless a caller names ``max_vectors``: then it takes
    about so many of them, by the smallest hash.
    """
    limits = table.groupBy("fit", "kind").agg(F.count(F.lit(1)).alias("n"))
    fits = sorted((r["fit"], r["kind"], r["n"]) for r in limits.collect())
    share = {fit: n for fit, _, n in fits if max_vectors and n > max_vectors}
    if share:                                # a uniform hash keeps the wanted share, up to chance
        keep = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, n in share.items() for x in (k, max_vectors / n))),
                                       F.col("fit")), F.lit(1.0))
        table = table.where(F.pmod(F.xxhash64("bins"), F.lit(1 << 30)) < keep * (1 << 30))
    elif any(n > task_vectors for _, _, n in fits):
        return _train_in_step(table, specs, cuts, fits)

    def grown(key: tuple, own: pa.Table) -> pa.Table:
        name, kind = key[0].as_py(), own.column("kind")[0].as_py()
        spec = specs[kind]
        return _node_table(fit(name, spec, cuts[kind], *_arrays(own, spec)))

    # ranges of their own number are not coalesced: hashed groups, small in bytes, would grow one after the other in few tasks
    return table.repartitionByRange(FIT_RANGES, "fit").groupBy("fit").applyInArrow(grown, NODE_SCHEMA)


def _train_in_step(table: DataFrame, specs: dict[str, Spec], cuts: dict[str, dict], fits: list[tuple]) -> DataFrame:
    """The node table of all ``fits`` (fit, kind, number of vectors), whose vectors are dealt over as many tasks as run at once."""
    spark = table.sparkSession
    slots = spark.sparkContext.defaultParallelism // int(spark.conf.get("spark.task.cpus", "1"))
    tasks = max(1, min(slots, sum(n for _, _, n in fits) // SHARE_VECTORS))
    folder = scratch_path(spark, "sums")
    table = table.select("fit", "bins", "stats")
    schema = pa.schema([("fit", pa.string()), ("bins", pa.list_(pa.int32())), ("stats", pa.list_(pa.float64()))])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(batches, schema)
        growing = [_fitting(name, specs[kind], cuts[kind], *_arrays(own.filter(pc.equal(own.column("fit"), name)), specs[kind]),
                            _hashed_fifth) for name, kind, _ in fits]
        del own
        exchange = Exchange(folder, BarrierTaskContext.get(), tasks)
        rows = exchange.run(_side_by_side(growing))
        if exchange.me == 0:                 # all tasks have the same trees
            yield from _node_table([r for one in rows for r in one]).to_batches()

    dealt = table.repartitionById(tasks, F.pmod(F.xxhash64("bins"), F.lit(tasks)).cast("int"))
    return dealt.mapInArrow(grown, NODE_SCHEMA, barrier=True)


@dataclass
class Trees:
    """One fit as arrays (trees by nodes), for each output."""
    features: tuple
    objective: str
    outputs: int
    depth: int
    start: float
    feature: np.ndarray = field(repr=False)
    cut: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)
    cover: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, rows: pa.Table, spec: Spec) -> "Trees":
        """From the node rows of one fit (their number is bounded by trees and depth)."""
        tree, out, node = (rows.column(c).to_numpy() for c in ("tree", "output", "node"))
        size = 2 ** (spec.depth + 1) - 1
        at = (out, tree, node)
        live = tree >= 0
        shape = (spec.outputs, int(tree.max(initial=-1)) + 1, size)
        arrays = {}
        for c, empty in (("feature", -1), ("cut", 0.0), ("value", 0.0), ("cover", 0.0)):
            a = np.full(shape, empty, int if c == "feature" else float)
            a[tuple(x[live] for x in at)] = np.nan_to_num(rows.column(c).to_numpy(zero_copy_only=False)[live])
            arrays[c] = a
        start = float(rows.column("value").to_numpy()[~live][0]) if (~live).any() else 0.0
        return cls(spec.features, spec.objective, spec.outputs, spec.depth, start, **arrays)

    @cached_property
    def cuts(self) -> list[np.ndarray]:
        """The different cuts of each feature, rising."""
        return [np.unique(self.cut[self.feature == j]) for j in range(len(self.features))]

    def distinct(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` that no other one agrees with on every split, and the place of each row among them.

        Rows that lie between the same cuts take the same way through every tree, so they
        have the same scores and Shapley values: dense tables hold many of them.
        """
        key = np.zeros(len(x), np.int64)
        for j, cuts in enumerate(self.cuts):
            if len(cuts):
                place = np.where(np.isnan(x[:, j]), 0, np.searchsorted(cuts, x[:, j]))      # NaN is above no cut
                key = np.unique(key * (len(cuts) + 1) + place, return_inverse=True)[1]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        return x[first], back

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores before the link (rows by outputs)."""
        x, back = self.distinct(x)
        return self._raw(x)[back]

    @cached_property
    def _steps(self) -> list[tuple]:
        """For each output, by place of a node in its flattened trees: feature, place of the cut, lower child, value.

        A leaf is its own child, with a cut that nothing lies above.
        """
        n_trees, size = self.feature.shape[1:]
        place = np.arange(n_trees * size)
        found = []
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            f, c = feature.ravel(), np.full(n_trees * size, np.iinfo(np.int64).max)
            for j, cuts in enumerate(self.cuts):
                own = f == j
                c[own] = np.searchsorted(cuts, cut.ravel()[own])
            child = np.where(f < 0, place, place + place % size + 1)          # node i: 2i+1
            found.append((np.maximum(f, 0), c, child, value.ravel()))
        return found

    def _raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), self.outputs), self.start)
        n_trees, size = self.feature.shape[1:]
        width = x.shape[1]
        # the place of each value among its feature's cuts: above a cut if greater than the cut's own
        places = np.zeros(x.shape, np.int64)
        for j, cuts in enumerate(self.cuts):
            places[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(cuts, x[:, j]))
        for a in range(0, len(x), ROWS):
            rows = places[a:a + ROWS].ravel()
            first = np.arange(0, len(rows), width)[:, None]
            for o, (feature, cut, child, value) in enumerate(self._steps):
                at = np.repeat(np.arange(n_trees)[None, :] * size, len(first), axis=0)
                for _ in range(self.depth):
                    above = rows.take(feature.take(at) + first) > cut.take(at)
                    at = child.take(at) + above
                out[a:a + ROWS, o] += value.take(at).sum(axis=1)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, of each class, or the expected count."""
        f = self.raw(x)
        if self.objective == "binary":
            return 1 / (1 + np.exp(-f))
        if self.objective == "classes":
            e = np.exp(f - f.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        return np.exp(f)

    def shapley(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Path-dependent Shapley values of output 0 (rows by features) and their base, the mean score."""
        x, back = self.distinct(x)
        values, base = self._shapley(x)
        return values[back], base

    def _shapley(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        out, base = np.zeros((len(x), len(self.features))), self.start
        columns = np.ascontiguousarray(x.T)
        kind = np.uint8 if self.depth - LOWER + 2 ** LOWER <= 9 else np.uint16         # as many bits as a pattern has
        found = np.empty((min(SHAP_ROWS, len(x)), len(self.features)))
        for t in range(self.feature.shape[1]):
            slots, leaves, table, mean = self._leaf_tables(t)
            base += mean
            upper, lower = self._lower_tables(slots, dict(zip(leaves, table)))
            f, cut = self.feature[0, t], self.cut[0, t]
            for a in range(0, len(x), SHAP_ROWS):
                n = min(SHAP_ROWS, len(x) - a)
                above = {node: (columns[f[node], a:a + n] > cut[node]).view(np.uint8).astype(kind, copy=False) for node in slots}
                # failed conditions on the way to a node, one bit for each different feature
                failed = {0: np.zeros(n, kind)}
                for node in upper:
                    own, bit = failed.pop(node), slots[node]
                    failed[2 * node + 1] = own | (above[node] << bit)
                    failed[2 * node + 2] = own | ((above[node] ^ 1) << bit)
                for top, (inner, parts) in lower.items():
                    at = failed[top] << len(inner)
                    for bit, node in enumerate(inner):
                        at |= above[node] << bit
                    # every pattern is a row of the table: nothing to check, so no copy of the result is made first
                    out[a:a + n] += parts.take(at, axis=0, out=found[:n], mode="clip")
        return out, base

    def _lower_tables(self, slots: dict[int, int], parts: dict[int, np.ndarray]):
        """The upper splits of a tree, and for each subtree below them its splits and the sum of its leaves' tables.

        The subtrees are LOWER levels of splits high: a pattern holds the failed conditions on the
        way to one and then, in the lowest bits, whether the row is above the cut of each of its
        splits.  A row so costs one lookup for each subtree in place of one for each leaf.
        """
        upper_depth = max(self.depth - LOWER, 0)
        depth_of = lambda node: (node + 1).bit_length() - 1
        upper = [node for node in slots if depth_of(node) < upper_depth]
        tops = [node for node in (*slots, *parts) if depth_of(node) == upper_depth or
                (depth_of(node) < upper_depth and node in parts)]
        lower = {}
        for top in tops:
            inner = []
            below = [top] if top in slots else []
            while below:
                inner += below
                below = [c for node in below for c in (2 * node + 1, 2 * node + 2) if c in slots]
            at = np.arange(1 << (min(depth_of(top), self.depth) + len(inner)))
            failed, total = {top: at >> len(inner)}, 0.0
            for bit, node in enumerate(inner):
                own, above = failed.pop(node), at >> bit & 1
                failed[2 * node + 1] = own | (above << slots[node])
                failed[2 * node + 2] = own | ((above ^ 1) << slots[node])
            for leaf, own in failed.items():
                total = total + parts[leaf][own]
            lower[top] = inner, total
        return upper, lower

    def _leaf_tables(self, t: int):
        """Bit of each split's feature on its path, the leaves, and value parts by leaf, failed pattern and feature.

        A feature's value at a leaf is (present - absent share) times the integral
        over s in 0..1 of the product of (1 - s) absent share + s present over the
        other features.  The product has a degree below ``depth``, so a Gauss rule of
        half as many points gives the integral exactly.
        """
        f, value, cover, d = self.feature[0, t], self.value[0, t], self.cover[0, t], self.depth
        slots, paths, leaves = {}, {0: []}, []
        for node in range(len(f)):
            if node not in paths:
                continue
            own = paths[node]
            if f[node] < 0:
                leaves.append(node)
                continue
            names = [k for k, _ in own]
            slots[node] = at = names.index(f[node]) if f[node] in names else len(names)
            for child in (2 * node + 1, 2 * node + 2):
                ratio = cover[child] / cover[node]
                paths[child] = [*own[:at], (f[node], (own[at][1] if at < len(own) else 1.0) * ratio), *own[at + 1:]]
        # a path shorter than the depth gets features that are never absent: they change no value
        absent = np.ones((len(leaves), d))
        names = np.zeros((len(leaves), d), int)
        for i, leaf in enumerate(leaves):
            for j, (k, z) in enumerate(paths[leaf]):
                absent[i, j], names[i, j] = z, k
        present = 1.0 - (np.arange(1 << d)[:, None] >> np.arange(d) & 1)            # by pattern and slot
        part = np.zeros((len(leaves), 1 << d, d))
        points, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
        for s, w in zip((points + 1) / 2, weights / 2):
            factors = (1 - s) * absent[:, None, :] + s * present[None]
            part += w * factors.prod(axis=2, keepdims=True) / factors
        part *= (present[None] - absent[:, None]) * value[leaves][:, None, None]
        table = np.zeros((len(leaves), 1 << d, len(self.features)))
        for j in range(d):
            # the features of a leaf's slots differ, so each is added once; unused slots add zeros
            table[np.arange(len(leaves))[:, None], np.arange(1 << d)[None, :], names[:, j][:, None]] += part[:, :, j]
        return slots, leaves, table, float((value[leaves] * absent.prod(axis=1)).sum())


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width)


def scores(fits: list[Trees], calibrators: list | None = None):
    """A column function of the features' array: one number for each output of each fit (calibrated if given)."""
    width = len(fits[0].features)

    def run(x: pa.Array) -> pa.Array:
        rows = matrix(x, width)
        found = [m.predict(rows) for m in fits]
        if calibrators:
            found = [np.interp(p, *c) for p, c in zip(found, calibrators)]
        return _lists(np.hstack(found))

    return F.arrow_udf(run, ArrayType(DoubleType()))


def shapley_values(fits: list[Trees]):
    """A column function of the features' array: mean Shapley values over the fits, then the mean base."""
    width = len(fits[0].features)

    def values(x: pa.Array) -> pa.Array:
        rows = matrix(x, width)
        found = [m.shapley(rows) for m in fits]
        each = np.mean([v for v, _ in found], axis=0)
        return _lists(np.c_[each, np.full(len(rows), np.mean([b for _, b in found]))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: list[pa.Array] = []
        for x in batches:
            held.append(x)
            if sum(map(len, held)) >= SHAP_BATCH:
                yield values(pa.concat_arrays(held))
                held = []
        if held:
            yield values(pa.concat_arrays(held))

    return F.arrow_udf(run, ArrayType(DoubleType()))


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))


# -- isotonic calibration ------------------------------------------------------

def pooled(low, high, weight, total) -> list[tuple]:
    """Blocks (low, high, weight, total) with rising means: adjacent violators are pooled."""
    out: list[list] = []
    for block in zip(low, high, weight, total):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, h, w, t = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = h, out[-1][2] + w, out[-1][3] + t
    return [tuple(b) for b in out]


def isotonic(scored: DataFrame, key: str, score: str, label: str, ranges: int, finest: int = 4096) -> DataFrame:
    """``key, low, high, mean``: isotonic regression of label (0 to 1) on score, for each key.

    Rows of one score are added up; each of ``ranges`` score ranges (quantiles of
    the scores) pools its own violators, then neighbouring ranges are joined
    two by two and pooled again (pooling blocks gives what pooling their rows would).  Blocks whose means
    agree to 1/``finest`` become one, which bounds the result at any input size.
    """
    cur = (scored.groupBy(F.col(key).alias("k"), F.col(score).cast("double").alias("low"))
           .agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum(F.col(label).cast("double")).alias("total")))
    part = F.lit(0)
    if ranges > 1:
        probs = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
        cuts = cur.agg(F.percentile_approx("low", probs)).first()[0] or [0.0]
        part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("low")))
    cur = cur.select("k", "low", F.col("low").alias("high"), "weight", "total", part.alias("part"))
    names = ["k", "low", "high", "weight", "total", "part"]

    def pool(_: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("low")
        blocks = pooled(*(own.column(c).to_pylist() for c in ("low", "high", "weight", "total")))
        first = own.column("k")[0], own.column("part")[0]
        return pa.table([pa.array([first[0].as_py()] * len(blocks), own.schema.field("k").type),
                         *(pa.array([b[i] for b in blocks], pa.float64()) for i in range(4)),
                         pa.array([first[1].as_py()] * len(blocks), pa.int32())], names=names)

    schema = f"k {cur.schema['k'].dataType.simpleString()}, low double, high double, weight double, total double, part int"
    parts = ranges
    while True:
        cur = cur.groupBy("k", "part").applyInArrow(pool, schema)
        if parts == 1:
            break
        parts = (parts + 1) // 2
        cur = cur.withColumn("part", F.expr("cast(part div 2 as int)"))
    level = F.floor(F.col("total") / F.col("weight") * finest)
    return (cur.groupBy("k", level.alias("level")).agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        (F.sum("total") / F.sum("weight")).alias("mean")).drop("level").withColumnRenamed("k", key))

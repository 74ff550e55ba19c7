"""Quality classifier by co-training.

Two views of a document: its text (hashed words, and binned shares of capitals, digits, symbols, exclamation marks,
distinct words and repeated lines) and its page metadata (source, language, length). A logistic model for each view is fit
on labelled rows. In each round a view labels the unlabelled rows that it is most sure of, and these join the training set
of the other view. At the end each view is calibrated on held-out labelled rows (Platt) and a logistic of both calibrated
views scores every document. Quality and toxicity are two targets of the same procedure.

A text feature is used where it tells the classes apart: its count among the rows of one class is at least ``LEAST_Z``
standard deviations from what chance gives. Without that, the many words that a long text has by chance outweigh the few
that matter.

Only the labelled rows that are fitted on are bounded (``max_labelled``). They are drawn class by class, small classes
whole, and weighted by how many rows they stand for, so a class of few rows in a large table is not lost. Every unlabelled document is a candidate in every
round: its features are written once, one pass counts how sure each view is of it, a second gives the pseudo-labels. The
text view's further fits are L-BFGS steps whose loss and gradient are summed over all pseudo-labelled rows, one pass each;
the metadata view's rows are counted by their few different feature sets. Scoring reads every document whole.

Defined results: null text has no words and is scored by what is left; null metadata is a value of its own; labels that
are null are not used; without labels of both kinds a target has the constant score of the only kind (quality 1, toxicity
0 for no labels), so nothing is rejected for it; label rows that repeat whole count once, documents that repeat train and
score row by row; contradicting labels of one id all count; an empty table gives an empty result; other columns pass through
untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.storage import Scratch
from docloom.llm.wordhash import chunks, constants, mix, segment_hashes, string_buffers, word_hashes
from docloom.llm.worker import lean

MAX_LABELLED = 6000
ROUNDS, GROWTH, SURE = 3, 0.1, 0.95
WORD_BITS = 16
STAT_BINS = 16
N_STATS = 8
WIDTH = (1 << WORD_BITS) + STAT_BINS * N_STATS
META_WIDTH = 1 << 12
LEAST_ROWS, LEAST_Z = 10, 3.0
L2 = 1e-4
#: L-BFGS steps of a round and the pairs they keep; tasks of a pass, and tasks that add up their sums
STEPS, PAIRS = 8, 8
TASKS, SUMS = 1024, 8
#: how sure a view is beyond ``sure``: bins of the calibrated margin, BIN to a unit
BINS, BIN = 4096, 128
#: bin edges of the shares, denser near 0
SHARES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass
class Rows:
    """Binary features of rows: flat feature numbers and each row's bounds."""

    idx: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.at)[rows]
        pos = np.repeat(self.at[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return Rows(self.idx[pos], np.append(0, np.cumsum(n)))

    def margins(self, w: np.ndarray) -> np.ndarray:
        total = np.append(0.0, np.cumsum(w[self.idx], dtype=np.float64))
        return total[self.at[1:]] - total[self.at[:-1]]


def text_features(texts: pa.Array) -> Rows:
    raw, off = string_buffers(texts)
    parts, sizes = [], []
    for i, j in chunks(off):
        part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        h, first = word_hashes(part, at)
        n = np.diff(first)
        owner = np.repeat(np.arange(j - i), n)
        order = np.lexsort((h, owner))
        o, v = owner[order], h[order]
        new = np.append(True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])) if len(o) else np.zeros(0, bool)
        o, v = o[new], v[new]

        def count(flags: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            c = np.append(0, np.cumsum(flags))
            return c[at[1:]] - c[at[:-1]]

        size, words = np.maximum(np.diff(at), 1), np.maximum(n, 1)
        lines = np.flatnonzero(part == 10)
        begin = np.unique(np.concatenate([at[:-1], lines + 1]))
        begin = begin[begin < len(part)]
        line_owner = np.searchsorted(at, begin, side="right") - 1
        line = np.diff(np.append(begin, len(part)))
        line = np.minimum(line, at[line_owner + 1] - begin)
        lh = segment_hashes(part, begin, line) if len(begin) else np.zeros(0, np.uint64)
        lo = np.lexsort((lh, line_owner))
        again = np.append(False, (line_owner[lo][1:] == line_owner[lo][:-1]) & (lh[lo][1:] == lh[lo][:-1])) if len(lo) else np.zeros(0, bool)
        stats = np.stack(
            [
                count((part >= 65) & (part <= 90)) / size,
                count((part >= 48) & (part <= 57)) / size,
                count(SYMBOLS[part]) / size,
                count(part == 33) / words,
                np.bincount(o, minlength=j - i) / words,
                np.bincount(line_owner[lo][again], minlength=j - i) / np.maximum(np.bincount(line_owner, minlength=j - i), 1),
                size / words / 20.0,
                np.log2(words + 1.0) / 20.0,
            ],
            axis=1,
        )
        bins = np.searchsorted(SHARES, stats) + np.arange(N_STATS) * STAT_BINS + (1 << WORD_BITS)
        f = np.concatenate([(v & np.uint64((1 << WORD_BITS) - 1)).astype(np.int32), bins.astype(np.int32).ravel()])
        who = np.concatenate([o, np.repeat(np.arange(j - i), N_STATS)])
        parts.append(f[np.argsort(who, kind="stable")])
        sizes.append(np.bincount(who, minlength=j - i))
    idx = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return Rows(idx, np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64))


def meta_features(columns: list[pa.Array], n: int) -> Rows:
    """One feature a column: its hashed value; numbers count by their power of two."""
    out = np.zeros((n, len(columns)), np.int32)
    for k, col in enumerate(columns):
        if pa.types.is_integer(col.type) or pa.types.is_floating(col.type):
            x = np.asarray(pc.fill_null(col.cast(pa.float64()), -1.0))
            code = np.where(x < 0, 0, 1 + np.log2(np.maximum(x, 0) + 1).astype(np.int64)).astype(np.uint64)
        else:
            raw, off = string_buffers(col.cast(pa.string()))
            code = segment_hashes(raw, off[:-1], np.diff(off)) if n else np.zeros(0, np.uint64)
            code[np.asarray(pc.is_null(col))] = np.uint64(0)
        out[:, k] = (mix(code ^ constants(k + 1, seed=11)[k]) % np.uint64(META_WIDTH)).astype(np.int32)
    return Rows(out.ravel(), np.arange(n + 1) * len(columns))


def telling(seen: np.ndarray, ones: np.ndarray, n: float, n_ones: float, least_z: float) -> np.ndarray:
    """Which features are in at least LEAST_ROWS rows and lean to a class by ``least_z`` standard deviations.

    ``seen`` and ``ones`` count a feature's rows and those of class 1, ``n`` and ``n_ones`` all rows.
    """
    p = n_ones / max(n, 1.0)
    spread = np.sqrt(np.maximum(seen * p * (1 - p) * (1 - seen / max(n, 1.0)), 1e-12))
    return (seen >= LEAST_ROWS) & (np.abs(ones - seen * p) >= least_z * spread)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    width: int
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    b: float = 0.0

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray, least_z: float = 0.0, times: np.ndarray | None = None, steps: int = 120, rate: float = 0.3, l2: float = L2) -> Logistic:
        """Full-batch AdaGrad; features that are not ``telling`` keep weight 0. ``weight``: how many rows of the corpus a row
        stands for; ``times``: how many it was made of, 1 by default."""
        n = np.diff(rows.at)
        times = np.ones(len(y)) if times is None else times
        seen, ones = (np.bincount(rows.idx, weights=np.repeat(x, n), minlength=self.width) for x in (times, times * y))
        use = np.flatnonzero(telling(seen, ones, times.sum(), (times * y).sum(), least_z))
        place = np.full(self.width, len(use), np.int64)
        place[use] = np.arange(len(use))
        idx, share = place[rows.idx], weight / weight.sum()
        w, g2 = np.zeros(len(use) + 1), np.full(len(use) + 1, 1e-8)
        b, b2 = 0.0, 1e-8
        own = Rows(idx, rows.at)
        for _ in range(steps):
            err = (sigmoid(own.margins(w) + b) - y) * share
            g = np.bincount(idx, weights=np.repeat(err, n), minlength=len(w)) + l2 * w
            g[-1] = 0
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
            gb = float(err.sum())
            b2 += gb * gb
            b -= rate * gb / b2**0.5
        self.w = np.zeros(self.width, np.float32)
        self.w[use] = w[:-1]
        self.b = b
        return self

    def margins(self, rows: Rows) -> np.ndarray:
        return rows.margins(self.w) + self.b


def platt(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Logistic fit on the columns of ``margins`` by Newton steps: their weights and, last, the offset."""
    x, share = np.column_stack([margins, np.ones(len(y))]), weight / weight.sum()
    t = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))  # softened targets
    c = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ c)
        h = (x * (share * (p * (1 - p) + 1e-6))[:, None]).T @ x + l2 * np.eye(len(c))
        step = np.linalg.solve(h, x.T @ (share * (p - t)) + l2 * c)
        c -= np.clip(step, -5, 5)
    return c


def combined(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``platt`` over both views with no weight below 0: a view that would count against itself is left out."""
    on = np.ones(margins.shape[1], bool)
    while True:
        c = np.zeros(margins.shape[1] + 1)
        c[np.append(on, True)] = platt(margins[:, on], y, weight)
        if (c[:-1] >= 0).all():
            return c
        on &= c[:-1] >= 0


@dataclass
class Target:
    """Both views' models, their calibration, and the combination. ``constant`` is set where there was nothing to learn."""

    constant: float | None = None
    text: Logistic | None = None
    meta: Logistic | None = None
    text_scale: np.ndarray | None = None
    meta_scale: np.ndarray | None = None
    both: np.ndarray | None = None
    held_out: float = float("nan")
    exchanged: tuple[int, int] = (0, 0)

    def score(self, text: Rows, meta: Rows) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(text), self.constant)
        a = self.text.margins(text) * self.text_scale[0] + self.text_scale[1]
        b = self.meta.margins(meta) * self.meta_scale[0] + self.meta_scale[1]
        return sigmoid(np.column_stack([a, b, np.ones(len(a))]) @ self.both)


@dataclass
class Known:
    """The labelled rows of a target, ``y`` 0 or 1, and how many rows each stands for; every fifth of a class is held out
    for calibration."""

    text: Rows
    meta: Rows
    y: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        nth = np.where(self.y > 0.5, np.cumsum(self.y > 0.5), np.cumsum(self.y <= 0.5))
        held = nth % 5 == 0
        self.train, self.held = np.flatnonzero(~held), np.flatnonzero(held)
        self.learnable = all(len(np.unique(self.y[x])) == 2 for x in (self.train, self.held))


def joined(a: Rows, b: Rows) -> Rows:
    return Rows(np.concatenate([a.idx, b.idx]), np.concatenate([a.at, a.at[-1] + b.at[1:]]))


def packed(rows: Rows) -> pa.Array:
    """Text features in two bytes each; the last N_STATS of a row are statistics, above 1 << WORD_BITS."""
    raw = rows.idx.astype("<u2").tobytes()
    return pa.array([raw[2 * p : 2 * q] for p, q in zip(rows.at[:-1].tolist(), rows.at[1:].tolist(), strict=True)], pa.binary())


def unpacked(cells: list[bytes], text: bool) -> Rows:
    at = np.append(0, np.cumsum([len(c) // 2 for c in cells])).astype(np.int64)
    idx = np.frombuffer(b"".join(cells), "<u2").astype(np.int32)
    if text:
        idx[(at[1:, None] - 1 - np.arange(N_STATS)).ravel()] += 1 << WORD_BITS
    return Rows(idx, at)


UNLABELLED = "u double, text binary, meta binary, for_text array<tinyint>, for_meta array<tinyint>"  # labels given, by target; -1 for none


def _labels(col: pa.Array, n: int) -> np.ndarray:
    return col.values.to_numpy().reshape(-1, n) if len(col) else np.zeros((0, n), np.int8)


def _sums(df: DataFrame, one, width: int) -> np.ndarray:
    """The sum of ``one(batch)`` over all batches, ``width`` numbers, in the order of the partitions. Tasks' sums are added up by
    SUMS tasks before they go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += one(b)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["p", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, p = np.zeros(width), None
        for b in batches:
            for at, x in zip(b.column("p").to_pylist(), b.column("s"), strict=True):
                total += np.frombuffer(x.as_buffer(), np.float64)
                p = at if p is None else p
        if p is not None:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["p", "s"])

    out = np.zeros(width)
    parts = df.coalesce(TASKS).mapInArrow(lean(run), "p int, s binary").repartition(SUMS, F.floor(F.col("p") / (TASKS // SUMS))).sortWithinPartitions("p").mapInArrow(add, "p int, s binary")
    for _, x in sorted((r.p, r.s) for r in parts.collect()):  # SUMS rows
        out += np.frombuffer(x, np.float64)
    return out


def _margins(b: pa.RecordBatch, targets: list[Target]) -> np.ndarray:
    """Calibrated margins of a batch: target, view (text, metadata), row."""
    text, meta = unpacked(b.column("text").to_pylist(), True), unpacked(b.column("meta").to_pylist(), False)
    return np.array([[t.text.margins(text) * t.text_scale[0] + t.text_scale[1], t.meta.margins(meta) * t.meta_scale[0] + t.meta_scale[1]] for t in targets])


def _bins(z: np.ndarray, label: int, sure: float) -> np.ndarray:
    """Bin of each margin for a label, -1 where the view is not sure."""
    e = (z if label else -z) - np.log(sure / (1 - sure))
    return np.where(e < 0, -1, np.minimum((e * BIN).astype(np.int64), BINS - 1))


def give_labels(free: DataFrame, targets: list[Target], growth: float, sure: float) -> tuple[DataFrame, int]:
    """``free`` with the labels of this round, and its rows. For each view, target and label the surest documents of the
    corpus, up to a share of ``growth``; equally sure ones at the end of the share by a hash of the id. Labels given before stay."""
    n_t = len(targets)
    shared = free.sparkSession.sparkContext.broadcast(targets)

    def count(b: pa.RecordBatch) -> np.ndarray:
        z = _margins(b, shared.value)
        h = [np.bincount(_bins(z[t, v], label, sure) + 1, minlength=BINS + 1)[1:] for t in range(n_t) for v in (0, 1) for label in (0, 1)]
        return np.append(np.concatenate(h), b.num_rows)

    got = _sums(free, count, n_t * 4 * BINS + 1)
    room = max(1, int(growth * got[-1]))
    h = got[:-1].reshape(n_t, 2, 2, BINS)
    above = np.flip(np.cumsum(np.flip(h, -1), -1), -1) - h  # surer rows than those of the bin
    part = np.clip((room - above) / np.maximum(h, 1), 0, 1)  # of each bin

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z, u = _margins(b, shared.value), b.column("u").to_numpy()
            had = [_labels(b.column(c), n_t).copy() for c in ("for_text", "for_meta")]
            for t in range(n_t):
                for v in (0, 1):
                    for label in (1, 0):
                        k = _bins(z[t, v], label, sure)
                        mine = had[1 - v][:, t]  # a view labels for the other
                        mine[(k >= 0) & (u < part[t, v, label][k]) & (mine < 0)] = label
            offsets = pa.array(np.arange(b.num_rows + 1) * n_t, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.int8())) for x in had]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], names=b.schema.names)

    return free.mapInArrow(lean(give), UNLABELLED), int(got[-1])


def fit_text(free: DataFrame, known: list[Known], start: list[Logistic]) -> tuple[list[Logistic], list[int]]:
    """The text models fit on training rows and all pseudo-labelled rows, from ``start``; and the number of the latter."""
    n_t, sc = len(known), free.sparkSession.sparkContext
    rows = free.where(F.exists("for_text", lambda x: x >= 0)).select("text", "for_text")
    own = [(k.text.take(k.train), k.y[k.train], k.weight[k.train]) for k in known]

    def count(x: Rows, y: np.ndarray) -> np.ndarray:
        """Rows of each feature, rows of class 1 of each feature, all rows, all of class 1; rows with y < 0 do not count."""
        n = np.diff(x.at)
        of = [np.bincount(x.idx[np.repeat(on, n)], minlength=WIDTH) for on in (y >= 0, y == 1)]
        return np.concatenate([*of, [(y >= 0).sum(), (y == 1).sum()]])

    def seen(b: pa.RecordBatch) -> np.ndarray:
        x, y = unpacked(b.column("text").to_pylist(), True), _labels(b.column("for_text"), n_t)
        return np.concatenate([count(x, y[:, t]) for t in range(n_t)])

    got = _sums(rows, seen, n_t * (2 * WIDTH + 2)).reshape(n_t, -1)
    n_given = got[:, -2].copy()
    got += [count(x, y) for x, y, _ in own]
    use = np.array([telling(g[:WIDTH], g[WIDTH:-2], g[-2], g[-1], LEAST_Z) for g in got])
    n_all = n_given + [weight.sum() for _, _, weight in own]

    def part(x: Rows, y: np.ndarray, w: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
        """Loss, and the gradient of weights and offset; rows with y < 0 do not count."""
        z, on = x.margins(w[:-1]) + w[-1], y >= 0
        err = np.where(on, sigmoid(z) - y, 0.0) * weight
        loss = float(((np.logaddexp(0, z) - y * z) * weight)[on].sum())
        return np.concatenate([[loss], np.bincount(x.idx, weights=np.repeat(err, np.diff(x.at)), minlength=WIDTH), [err.sum()]])

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = sc.broadcast(w)

        def one(b: pa.RecordBatch) -> np.ndarray:
            x, y = unpacked(b.column("text").to_pylist(), True), _labels(b.column("for_text"), n_t)
            return np.concatenate([part(x, y[:, t], shared.value[t]) for t in range(n_t)])

        total = _sums(rows, one, n_t * (WIDTH + 2)).reshape(n_t, -1)
        shared.destroy()
        total = total + [part(x, y, w[t], weight) for t, (x, y, weight) in enumerate(own)]
        total /= n_all[:, None]
        g = total[:, 1:]
        g[:, :-1] += L2 * w[:, :-1]
        g[:, :-1][~use] = 0
        return float(total[:, 0].sum() + L2 / 2 * (w[:, :-1] ** 2).sum()), g

    w = np.array([np.append(np.where(u, m.w, 0.0), m.b) for u, m in zip(use, start, strict=True)])
    w = lbfgs(value, w)
    return [Logistic(WIDTH, x[:-1].astype(np.float32), float(x[-1])) for x in w], n_given.astype(int).tolist()


def lbfgs(value, w: np.ndarray, steps: int = STEPS, pairs: int = PAIRS) -> np.ndarray:
    """``value`` gives the loss and its gradient; each call may be a pass over the data."""
    f, g = value(w)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, a = g.copy(), []
        for s, y in reversed(kept):
            a.append((s * d).sum() / (s * y).sum())
            d -= a[-1] * y
        d *= (kept[-1][0] * kept[-1][1]).sum() / (kept[-1][1] ** 2).sum() if kept else 1 / max(np.abs(g).sum(), 1e-12)
        for (s, y), x in zip(kept, reversed(a), strict=True):
            d += (x - (y * d).sum() / (s * y).sum()) * s
        slope, step = (g * d).sum(), 1.0
        if slope <= 1e-12:
            break
        for _ in range(6):
            new, at = value(w - step * d), w - step * d
            if new[0] <= f - 1e-4 * step * slope:
                break
            step /= 4
        else:
            break
        s, y = at - w, new[1] - g
        if (s * y).sum() > 1e-12:
            kept = [*kept[1 - pairs :], (s, y)] if len(kept) >= pairs else [*kept, (s, y)]
        w, (f, g) = at, new
    return w


def fit_meta(free: DataFrame, known: list[Known]) -> tuple[list[Logistic], list[int]]:
    """The metadata models; pseudo-labelled rows count by their feature sets, at most META_WIDTH values a column."""
    sets = free.where(F.exists("for_meta", lambda x: x >= 0)).groupBy("meta", "for_meta").count().orderBy("meta", "for_meta").collect()
    out, given = [], []
    for t, k in enumerate(known):
        mine = [(bytes(r.meta), r.for_meta[t], r["count"]) for r in sets if r.for_meta[t] >= 0]
        rows = joined(k.meta.take(k.train), unpacked([m for m, _, _ in mine], False))
        y = np.append(k.y[k.train], [x for _, x, _ in mine])
        given_times = [n for _, _, n in mine]
        out.append(Logistic(META_WIDTH).fit(rows, y, np.append(k.weight[k.train], given_times), times=np.append(np.ones(len(k.train)), given_times)))
        given.append(int(sum(n for _, _, n in mine)))
    return out, given


def calibrate(t: Target, k: Known) -> None:
    t.text_scale = platt(t.text.margins(k.text.take(k.held))[:, None], k.y[k.held], k.weight[k.held])
    t.meta_scale = platt(t.meta.margins(k.meta.take(k.held))[:, None], k.y[k.held], k.weight[k.held])


def co_train(free: DataFrame, known: list[Known], rounds: int = ROUNDS, growth: float = GROWTH, sure: float = SURE) -> list[Target]:
    """One target for each of ``known``; ``free`` has the features of all unlabelled documents, UNLABELLED."""
    scratch = Scratch(free.sparkSession)
    free = scratch(free, "cotrain")
    out = [Target(text=Logistic(WIDTH).fit(k.text.take(k.train), k.y[k.train], k.weight[k.train], LEAST_Z), meta=Logistic(META_WIDTH).fit(k.meta.take(k.train), k.y[k.train], k.weight[k.train])) for k in known]
    for t, k in zip(out, known, strict=True):
        calibrate(t, k)
    for _ in range(rounds):
        labelled, n = give_labels(free, out, growth, sure)
        if not n:
            break
        old, scratch = scratch, Scratch(free.sparkSession)
        free = scratch(labelled, "cotrain")
        old.drop()
        texts, for_text = fit_text(free, known, [t.text for t in out])
        metas, for_meta = fit_meta(free, known)
        for i, (t, k) in enumerate(zip(out, known, strict=True)):
            t.text, t.meta, t.exchanged = texts[i], metas[i], (for_text[i], for_meta[i])
            calibrate(t, k)
    scratch.drop()
    for t, k in zip(out, known, strict=True):
        text, meta = k.text.take(k.held), k.meta.take(k.held)
        t.both = combined(np.column_stack([t.text.margins(text) * t.text_scale[0] + t.text_scale[1], t.meta.margins(meta) * t.meta_scale[0] + t.meta_scale[1]]), k.y[k.held], k.weight[k.held])
        t.held_out = float(((t.score(text, meta) > 0.5) == (k.y[k.held] > 0.5)).mean())
    return out


@dataclass
class Classifier:
    quality: Target
    toxic: Target
    meta_columns: list[str]


def _sampled(known: DataFrame, rows: int) -> DataFrame:
    """``known`` with ct_w, how many rows each stands for; about ``rows`` rows, chosen by a hash of the id.

    Rows are in classes by both labels (null, 0 or 1: at most nine). Classes share ``rows`` evenly, and what small ones leave
    goes to the others.
    """
    kind = F.concat_ws("/", F.coalesce(F.signum(F.col("ct_q")).cast("int").cast("string"), F.lit("-")), F.coalesce(F.signum(F.col("ct_t")).cast("int").cast("string"), F.lit("-")))
    known = known.withColumn("ct_kind", kind)
    sizes = sorted(((r["count"], r.ct_kind) for r in known.groupBy("ct_kind").count().collect()))
    rates, left = {}, rows
    for i, (n, k) in enumerate(sizes):
        take = min(n, left // (len(sizes) - i))
        rates[k], left = take / n, left - take
    rate = F.lit(1.0)
    for k, r in rates.items():
        rate = F.when(F.col("ct_kind") == k, F.lit(r)).otherwise(rate)
    drawn = F.pmod(F.xxhash64(F.col("ct_id"), F.lit("labelled")), F.lit(1 << 30)) < rate * float(1 << 30)
    return known.withColumn("ct_w", 1.0 / F.greatest(rate, F.lit(1e-12))).where(drawn).drop("ct_kind")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"), max_labelled: int = MAX_LABELLED) -> Classifier:
    known = labels.select(F.col(id_col).alias("ct_id"), F.col("quality").cast("double").alias("ct_q"), F.col("toxic").cast("double").alias("ct_t")).where("ct_id IS NOT NULL AND (ct_q IS NOT NULL OR ct_t IS NOT NULL)").distinct()
    names = [c for c in meta_cols if c in docs.columns]
    chosen = _sampled(known, max_labelled)
    with_labels = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("ct_id"))  # bounded by max_labelled
    cols = [F.col(text_col).alias("ct_text"), F.hash(id_col).alias("ct_o"), *[F.col(c) for c in names]]

    def features(kept: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t, m = text_features(b.column("ct_text")), meta_features([b.column(c) for c in names], b.num_rows)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], packed(t), packed(m)], names=[*kept, "text", "meta"])

        return lean(run)

    own = "ct_q double, ct_t double, ct_w double, ct_o int, text binary, meta binary"
    got = with_labels.select("ct_q", "ct_t", "ct_w", *cols).mapInArrow(features(["ct_q", "ct_t", "ct_w", "ct_o"]), own).toPandas()
    got = got.sort_values(["ct_o", "text", "meta"], kind="stable").reset_index(drop=True)  # the same order whatever task ended first
    out, learn = {}, {}
    for col, default in (("ct_q", 1.0), ("ct_t", 0.0)):
        x = got[got[col].notna()]
        k = Known(unpacked(x.text.tolist(), True), unpacked(x.meta.tolist(), False), (x[col].to_numpy() > 0.5).astype(float), x.ct_w.to_numpy())
        if k.learnable:
            learn[col] = k
        else:
            out[col] = Target(constant=float(np.round(k.y.mean())) if len(k.y) else default)
    if learn:
        ids = docs.select(F.col(id_col).alias("ct_key"), F.pmod(F.xxhash64(F.col(id_col), F.lit("share")), F.lit(1 << 30)).alias("ct_u"), *cols)
        id_type = docs.select(id_col).schema[0].dataType.simpleString()
        free = ids.mapInArrow(features(["ct_key", "ct_u"]), f"ct_key {id_type}, ct_u bigint, text binary, meta binary")
        free = free.join(known.select("ct_id"), F.col("ct_key") == F.col("ct_id"), "left_anti")
        none = F.array_repeat(F.lit(-1).cast("tinyint"), len(learn))
        out |= zip(learn, co_train(free.select((F.col("ct_u") / (1 << 30)).alias("u"), "text", "meta", none.alias("for_text"), none.alias("for_meta")), list(learn.values())), strict=True)
    return Classifier(out["ct_q"], out["ct_t"], names)


def score(docs: DataFrame, model: Classifier, text_col: str = "text", tag: str = "ct") -> DataFrame:
    """``docs`` with {tag}_quality and {tag}_toxic, probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors of fixed width for each target
    had, place = docs.columns, docs.columns.index(text_col)
    extra = docs.sparkSession.createDataFrame([], f"{tag}_quality double, {tag}_toxic double").schema
    out = type(docs.schema)([*docs.schema.fields, *extra.fields])
    at = [had.index(c) for c in model.meta_columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            t, meta = text_features(b.column(place)), meta_features([b.column(i) for i in at], b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.quality.score(t, meta)), pa.array(m.toxic.score(t, meta))], names=[*had, *extra.names])

    return docs.mapInArrow(lean(run), out)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, tag: str = "ct", **kw) -> DataFrame:
    """``docs`` with scores and {tag}_kept: quality at least ``threshold`` and toxicity below it."""
    x = score(docs, fit(docs, labels, **kw), tag=tag)
    return x.withColumn(f"{tag}_kept", (F.col(f"{tag}_quality") >= threshold) & (F.col(f"{tag}_toxic") < threshold))


def report(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    keep = [c for c in ("doc_id", "text", "source", "lang", "n_chars") if c in docs.columns]
    x = classify(docs.select(*keep), labels, **kw)
    return x.select("doc_id", F.round("ct_quality", 6).alias("quality_score"), F.round("ct_toxic", 6).alias("toxic_score"), F.col("ct_kept").alias("kept"))

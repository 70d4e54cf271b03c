"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of 4 and 6 code points (A-Z lower-cased, one space put at either end), hashed
into a fixed number of buckets. Each counts as its log-count ratio: how much more often toxic training texts have it
than others, smoothed in proportion to the classes so that an unseen n-gram counts nothing. Features are scaled to
length one, weighted by logistic regression, and the margin becomes a probability by two numbers fitted on margins
that cross-fitting gives for texts the weights have not seen.

Ratios count every labelled row, in partial counts whose non-zero buckets Spark adds. The weights are fitted in one task
on the texts of at most ``max_rows`` labelled doc_ids (documented bound: 4,000), the first in the order of a hash of
doc_id; these are chosen by their ids alone, of a repeated one the least text counts.
The model is a few arrays of one number a bucket and so may pass through the driver.

Defined results: a null text counts as empty; an empty text scores as one whose n-grams say nothing; a null label is no
label, of several labels of one doc_id the largest counts; with labels of one class only (or none) every score is that
class (or 0); repeated rows score alike; an empty table gives an empty table; extra columns are kept, one that bears
the output's name is replaced.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from refrain.llm.common import ship, whole_text

BITS, SIZES = 18, (4, 6)
SMOOTHING, PENALTY, STEPS = 5.0, 1e-4, 25
MAX_ROWS = 4000
CUT = 0.7
FOLDS = 2
BLOCK_FEATURES = 1 << 19
CHUNK, PACK = 1 << 16, 1 << 14
#: A label takes about so many bytes in a broadcast table.
LABELS_BROADCAST_BYTES, LABEL_BYTES = 64 << 20, 96


def buckets(text: str, sizes: tuple = SIZES, bits: int = BITS):
    """Distinct buckets of a text's n-grams."""
    import numpy as np
    points = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    points += np.uint64(32) * ((points >= 65) & (points <= 90))
    found = []
    for n in sizes:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                h *= np.uint64(0x100000001B3)
                h += points[j:len(points) - n + 1 + j]
            h *= np.uint64(0x9E3779B97F4A7C15)
            found.append((h >> np.uint64(64 - bits)).astype(np.int64))
    if not found:
        return np.zeros(0, dtype=np.int64)
    every = np.concatenate(found)
    if len(every) < 4000:
        return np.unique(every)
    seen = np.zeros(1 << bits, dtype=bool)
    seen[every] = True
    return np.flatnonzero(seen)


def log_ratios(pos, neg, n_pos: float, n_neg: float):
    import numpy as np
    n = max(1.0, n_pos + n_neg)
    a, b = SMOOTHING * n_pos / n, SMOOTHING * n_neg / n
    return np.log((pos + a) / (n_pos + a)) - np.log((neg + b) / (n_neg + b))


def descend(loss, x, steps: int, kept: int = 8):
    """Minimise a smooth function: limited-memory BFGS with a halving line search."""
    import numpy as np
    f, g = loss(x)
    pairs: list = []
    for _ in range(steps):
        d, back = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (y @ s)
            back.append(a)
            d -= a * y
        if pairs:
            s, y = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(back)):
            d += s * (a - (y @ d) / (y @ s))
        step, slope = (1.0 if pairs else 1 / max(1.0, float(np.linalg.norm(g)))), g @ d
        while True:
            nx = x - step * d
            nf, ng = loss(nx)
            if nf <= f - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = nx - x, ng - g
        if s @ y > 1e-12:
            pairs = (pairs + [(s, y)])[-kept:]
        done = abs(f - nf) < 1e-7 * abs(f)
        x, f, g = nx, nf, ng
        if done:
            break
    return x


def fit_weights(rows: list, labels, ratios):
    """Weights and intercept of the logistic regression over length-one features.

    Passes run over blocks of rows, so only the buckets themselves (4 bytes each) are held at once.
    """
    import numpy as np
    size, blocks, at = len(ratios), [], 0
    while at < len(rows):
        stop, n = at, 0
        while stop < len(rows) and (stop == at or n + len(rows[stop]) <= BLOCK_FEATURES):
            n += len(rows[stop])
            stop += 1
        part = [r if len(r) else np.zeros(1, dtype=np.int32) for r in rows[at:stop]]
        lens = np.array([len(r) for r in part])
        blocks.append((np.concatenate(part), lens, np.append(0, np.cumsum(lens)[:-1]), slice(at, stop)))
        at = stop
    norms = [np.sqrt(np.add.reduceat(ratios[idx] ** 2, first) + 1e-9) for idx, _, first, _ in blocks]

    def loss(x):
        w, f, g, b = x[:size] * ratios, 0.0, np.zeros(size), 0.0
        for (idx, lens, first, of), norm in zip(blocks, norms):
            z = np.add.reduceat(w[idx], first) / norm + x[size]
            f += float((np.logaddexp(0, z) - labels[of] * z).sum())
            e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels[of]) / len(rows)
            g += np.bincount(idx, weights=np.repeat(e / norm, lens), minlength=size)
            b += float(e.sum())
        return f / len(rows) + PENALTY / 2 * (x[:size] @ x[:size]), np.append(g * ratios + PENALTY * x[:size], b)

    x = descend(loss, np.zeros(size + 1), STEPS)
    return x[:size], float(x[size])


def calibrate(margins, labels) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (smoothed targets, damped Newton steps)."""
    import numpy as np
    n1, n0 = labels.sum(), (1 - labels).sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    unit = max(float(np.std(margins)), 1e-6)
    m, a, b = margins / unit, 1.0, float(np.log((n1 + 1) / (n0 + 1)))

    def loss(v):
        z = v[0] * m + v[1]
        return (np.logaddexp(0, z) - goal * z).sum() + 0.05 * v[0] ** 2

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - goal) * m).sum() + 0.1 * a, (p - goal).sum()])
        step = np.linalg.solve(np.array([[(q * m * m).sum() + 0.1, (q * m).sum()], [(q * m).sum(), q.sum()]]), g)
        t = 1.0
        while t > 1e-6 and loss((a - t * step[0], b - t * step[1])) > loss((a, b)):
            t /= 2
        a, b = a - t * float(step[0]), b - t * float(step[1])
    return a / unit, b


@dataclass
class Model:
    """``weighted`` and ``squares`` hold, a bucket, weight x ratio and ratio squared."""
    weighted: object
    squares: object
    intercept: float
    slope: float
    offset: float
    bits: int = BITS

    def score(self, text: str) -> float:
        import math
        at = buckets(text, bits=self.bits)
        margin = float(self.weighted[at].sum()) / math.sqrt(float(self.squares[at].sum()) + 1e-9) + self.intercept
        z = max(-700.0, min(700.0, self.slope * margin + self.offset))
        return 1 / (1 + math.exp(-z))


@dataclass
class Constant:
    """What can be said when all labels are alike."""
    value: float

    def score(self, text: str) -> float:
        return self.value


def _fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.lit(3), doc_id), F.lit(FOLDS)).cast("int")


def _counter(bits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        counts = np.zeros((FOLDS, 2, 1 << bits), dtype=np.int64)
        rows = np.zeros((FOLDS, 2), dtype=np.int64)
        for batch in batches:
            for text, toxic, fold in zip(batch.column("text"), batch.column("toxic"), batch.column("fold")):
                k, y = fold.as_py(), toxic.as_py()
                counts[k, y, buckets(text.as_py(), bits=bits)] += 1
                rows[k, y] += 1
        # Cells of buckets, then those of the numbers of rows.
        flat = np.concatenate([counts.ravel(), rows.ravel()])
        at = np.flatnonzero(flat)
        for lo in range(0, len(at), CHUNK):
            part = at[lo:lo + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(flat[part], pa.int64())], names=["cell", "n"])
    return run


def _packed(key, group):
    import numpy as np
    import pyarrow as pa
    out = np.zeros(PACK, dtype=np.int64)
    out[group.column("cell").to_numpy() % PACK] = group.column("n").to_numpy()
    return pa.table({"pack": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})


def labelled(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """``(doc_id, text, toxic, fold)`` of the rows to learn from."""
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)"))
    if learn_from is not None:
        marks = marks.where(learn_from)
    if labels.count() * LABEL_BYTES <= LABELS_BROADCAST_BYTES:
        marks = F.broadcast(marks)
    return docs.select("doc_id", whole_text().alias("text")).join(marks, "doc_id").withColumn("fold", _fold())


def _sample(rows: DataFrame, most: int, n_rows: int) -> DataFrame:
    """``(text, toxic, fold)`` of the first ``most`` doc_ids in hash order, one row a doc_id; texts follow when the ids are chosen."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 1) / F.lit(float(1 << 63))
    ids = rows.select("doc_id", place.alias("_place")).distinct()
    share = min(1.0, 2.0 * most / max(1, n_rows))
    while share < 1.0 and ids.where(F.col("_place") < share).count() < most:  # a cut-off that leaves few more than wanted
        share = min(1.0, 2 * share)
    few = (ids if share >= 1.0 else ids.where(F.col("_place") < share)).orderBy("_place", "doc_id").limit(most).select("doc_id")
    # Copies of one id merge before they are shuffled.
    return (rows.join(F.broadcast(few), "doc_id", "left_semi").groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text"))
            .orderBy("doc_id").select("text", "toxic", "fold"))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, max_rows: int = MAX_ROWS, bits: int = BITS):
    """Train on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``; ``learn_from`` filters by doc_id."""
    import numpy as np
    rows = labelled(docs, labels, learn_from)
    parts = rows.select("text", "toxic", "fold").mapInArrow(_counter(bits), "cell long, n long")
    summed = parts.groupBy("cell").agg(F.sum("n").alias("n"))
    packed = summed.groupBy(F.floor(F.col("cell") / PACK).cast("int").alias("pack")).applyInArrow(_packed, "pack int, counts binary")
    flat = np.zeros(-(-(FOLDS * 2 * (1 << bits) + FOLDS * 2) // PACK) * PACK)
    for r in packed.collect():  # one row of numbers a stretch of cells: a fixed number
        flat[r["pack"] * PACK:(r["pack"] + 1) * PACK] = np.frombuffer(r["counts"], dtype=np.int64)
    flat = flat[:FOLDS * 2 * (1 << bits) + FOLDS * 2]
    counts, n = flat[:-FOLDS * 2].reshape(FOLDS, 2, 1 << bits), flat[-FOLDS * 2:].reshape(FOLDS, 2)
    if not n[:, 1].sum() or not n[:, 0].sum():
        return Constant(float(n[:, 1].sum() > 0))
    sent = rows.sparkSession.sparkContext.broadcast((counts, n))

    def train(batches):
        import pyarrow as pa
        counts, n = sent.value
        texts, marks, folds = [], [], []
        for batch in batches:
            texts += [buckets(t.as_py(), bits=bits).astype(np.int32) for t in batch.column("text")]
            marks += batch.column("toxic").to_pylist()
            folds += batch.column("fold").to_pylist()
        if not texts:
            return
        y, k = np.array(marks, dtype=float), np.array(folds)
        out = []
        for fold in range(FOLDS):
            other = [f for f in range(FOLDS) if f != fold]
            mine, rest = np.flatnonzero(k == fold), np.flatnonzero(k != fold)
            if len(mine) and 0 < y[rest].sum() < len(rest):
                ratio = log_ratios(counts[other, 1].sum(0), counts[other, 0].sum(0), n[other, 1].sum(), n[other, 0].sum())
                w, b = fit_weights([texts[i] for i in rest], y[rest], ratio)
                out += [(float((w * ratio)[texts[i]].sum() / np.sqrt((ratio[texts[i]] ** 2).sum() + 1e-9)) + b, y[i]) for i in mine]
        ratio = log_ratios(counts[:, 1].sum(0), counts[:, 0].sum(0), n[:, 1].sum(), n[:, 0].sum())
        w, b = fit_weights(texts, y, ratio)
        margins, seen = (np.array(v) for v in zip(*out)) if out else (np.zeros(1), np.zeros(1))
        slope, offset = calibrate(margins, seen) if 0 < seen.sum() < len(seen) else (1.0, 0.0)
        model = Model(w * ratio, ratio * ratio, b, slope, offset, bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.weighted.tobytes()], pa.binary()), pa.array([model.squares.tobytes()], pa.binary()),
                                          pa.array([[b, slope, offset]], pa.list_(pa.float64()))], names=["weighted", "squares", "numbers"])

    got = _sample(rows, max_rows, int(n.sum())).coalesce(1).mapInArrow(train, "weighted binary, squares binary, numbers array<double>").first()
    return Model(np.frombuffer(got["weighted"]), np.frombuffer(got["squares"]), *got["numbers"], bits)


def score(docs: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the probability that the whole text is toxic."""
    # Plain arrays and numbers: a worker unpickles a broadcast without this package.
    kind, state = type(model), docs.sparkSession.sparkContext.broadcast(astuple(model))

    @F.arrow_udf("double")
    def scored(texts):
        import pyarrow as pa
        m = kind(*state.value)
        return pa.array([m.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(out, scored(whole_text(text)))


ship(__name__)

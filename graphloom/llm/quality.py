"""Quality: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and so has each chosen pair of features over a
coarser grid.  Tables are learnt by cyclic boosting: in turn, each gets a shallow tree over its own bins,
fitted to the log loss's gradients and added at a small rate.  A score is a sum of table entries.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, chunks, col, fresh
from .sampling import labelled

#: Bound of the training sample in rows; bins of a feature, of a feature in a pair; pairs kept.
SAMPLE_ROWS, BINS, COARSE, PAIRS = 20_000, 48, 8, 6
FEATURES = (
    "log_words", "word_length", "distinct_words", "same_as_last", "marks", "upper", "digits", "exclaims", "bars",
    "stars", "stops", "lines_repeated", "line_words", "non_ascii", "longest_word", "blanks",
)
_BYTES = np.arange(256)
_CLASS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "high": _BYTES >= 128,
    "blank": (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)),
}


def features(text: bytes | None) -> list[float]:
    """Sixteen figures of a whole text, all 0 for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    n, w, share = len(text), max(1, len(words)), {k: int(counts[m].sum()) for k, m in _CLASS.items()}
    letters = share["upper"] + share["lower"] + share["high"]
    marks = n - letters - share["digits"] - share["blank"]
    return [
        float(np.log1p(len(words))), (n - share["blank"]) / w, len(set(words)) / w, sum(map(eq, words, words[1:])) / w, marks / n,
        share["upper"] / max(1, letters), share["digits"] / n, int(counts[33]) / w, int(counts[124]) / w,
        int(counts[[35, 36, 37, 38, 42, 64, 94, 126]].sum()) / w, int(counts[46]) / w, 1 - len(set(lines)) / max(1, len(lines)),
        w / max(1, len(lines)), share["high"] / n, float(np.log1p(max(map(len, words), default=0))), share["blank"] / n,
    ]


@dataclass
class Model:
    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    grids: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        fine = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        for j, b in enumerate(fine):
            out += self.tables[j, b]
        rough = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.coarse)]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[rough[a], rough[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -60, 60)))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """A tree of up to ``leaves`` leaves over ordered bins: its value in each bin, from gradient and hessian sums."""
    parts, k = [(0, len(g))], 0
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(parts) < leaves and k < leaves:
        best = (1e-9, None, None)
        for p in parts:
            at = np.arange(p[0] + 1, p[1])
            at = at[(ch[at] - ch[p[0]] >= least) & (ch[p[1]] - ch[at] >= least)] if len(at) else at
            if len(at):
                won = gain(p[0], at) + gain(at, p[1]) - gain(*p)
                i = int(won.argmax())
                if won[i] > best[0]:
                    best = (won[i], p, int(at[i]))
        if best[1] is None:
            break
        p, at = best[1], best[2]
        parts.remove(p)
        parts += [(p[0], at), (at, p[1])]
        k += 1
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def shallow_grid(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Two levels over a grid: the best cut of the rows, then one of the columns on each side."""
    out = np.zeros(g.shape)
    rows = shallow(g.sum(1), h.sum(1), 2)
    for side in np.unique(rows):
        own = rows == side
        out[own] = shallow(g[own].sum(0), h[own].sum(0), 2)
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 60, rate: float = 0.1) -> Model:
    """Fit tables to rows of features of which ``y`` is 1 if good; one class alone gives a constant."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    bias, n = float(np.log(p / (1 - p))), x.shape[1]
    cuts = [quantile_cuts(x[:, j], BINS) for j in range(n)]
    coarse = [quantile_cuts(x[:, j], COARSE) for j in range(n)]
    tables, grids = np.zeros((n, BINS)), np.zeros((0, COARSE, COARSE))
    if not 0 < y.sum() < len(y):
        return Model(cuts, coarse, tables, [], grids, bias)
    fine = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    rough = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    z = np.full(len(y), bias)
    slope = lambda: (lambda q: (q - y, q * (1 - q)))(1 / (1 + np.exp(-np.clip(z, -60, 60))))
    for _ in range(rounds):
        for j in range(n):
            g, h = slope()
            step = rate * shallow(np.bincount(fine[j], g, BINS), np.bincount(fine[j], h, BINS))
            tables[j] += step
            z += step[fine[j]]
    flat = {(a, b): rough[a] * COARSE + rough[b] for a, b in combinations(range(n), 2)}
    sums = lambda ab, v: np.bincount(flat[ab], v, COARSE * COARSE).reshape(COARSE, COARSE)
    g, h = slope()
    worth = {ab: float((-2 * s * sums(ab, g) - s * s * sums(ab, h)).sum()) for ab in flat for s in [shallow_grid(sums(ab, g), sums(ab, h))]}
    pairs = sorted(worth, key=lambda ab: (-worth[ab], ab))[:PAIRS]
    grids = np.zeros((len(pairs), COARSE, COARSE))
    for _ in range(pair_rounds):
        for k, ab in enumerate(pairs):
            g, h = slope()
            step = rate * shallow_grid(sums(ab, g), sums(ab, h))
            grids[k] += step
            z += step.reshape(-1)[flat[ab]]
    return Model(cuts, coarse, tables, pairs, grids, bias)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The features of each text."""
    for texts in batches:
        yield pa.array([features(t) for part in chunks(texts) for t in as_bytes(part)], pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 4, held: int = 2, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on the features of at most ``rows`` labelled documents, chosen by a hash of the id.

    Labels of ids whose crc32 modulo ``mod`` is ``held`` are not learnt from.  An id that several documents have
    counts with the smallest of their texts; null texts don't count.  Only features come to the driver.
    """
    got = labelled(docs, labels, label, mod, held, rows, col(text_col).cast("string"), id_col).select(measured(F.col("_value")).alias("x"), F.xxhash64("_id").alias("h"), "_y").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, np.asarray(got["h"])])
    return train(x[order], np.asarray(got["_y"]).astype(float)[order])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with a column (``name``, or one after it that clashes with none) of the probability that a text is good.

    Whole texts count.  A null or empty text is scored by features that are all 0.  Other columns, nulls and
    repeated rows pass through.  One scan, no shuffle; the model has a fixed size.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = [features(t) for part in chunks(texts) for t in as_bytes(part)]
            yield pa.array(held.value.score(np.array(x, float).reshape(-1, len(FEATURES))))

    return docs.withColumn(fresh(docs.columns, name), good(col(text_col).cast("string")))

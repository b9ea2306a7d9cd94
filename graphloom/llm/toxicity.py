"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its units: the word itself and its byte n-grams between
boundary marks, so an unseen misspelling shares units with the word.  A text's vector is the mean of its words'
vectors, over all of the text; a linear softmax over SCALE times that gives two classes.  Vectors and softmax
are trained jointly in numpy, with Adagrad.  Units whose document frequency doesn't differ between the
classes keep a vector of zeros: they count in the average and say nothing, so that an average over
thousands of words isn't noise, and one word in a thousand can still tell.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, Scratch, as_bytes, chunks, col, fresh, mix64, trim
from .sampling import labelled

BITS, DIM, GRAMS = 18, 8, (3, 4, 5, 6)
#: What a text's average is multiplied by; words that a shorter text counts as having; the least difference of document frequencies, in standard errors, and texts, of a unit that is learnt.
SCALE, SHORT, LEAST_Z, LEAST_TEXTS = 100.0, 8, 6.0, 5
#: Bounds of the training sample, in rows and bytes of text, and of the words whose scores a worker keeps.
SAMPLE_ROWS, SAMPLE_BYTES, CACHE = 6_000, 20 << 20, 200_000
#: Bytes of a word beyond which it counts as several words, and of these pieces; they overlap so that no n-gram is lost.
LONG_WORD, PIECE = 256, 32


def words_of(text: bytes | None) -> list[bytes]:
    words = text.translate(WORD_TABLE).split() if text else []
    return [p for w in words for p in pieces(w)] if words and max(map(len, words)) > LONG_WORD else words


def pieces(word: bytes) -> list[bytes]:
    """All of a word, in pieces of PIECE bytes if it is long: a paragraph without spaces is one word."""
    if len(word) <= LONG_WORD:
        return [word]
    overlap = GRAMS[-1] - 1
    return [word[i : i + PIECE] for i in range(0, len(word) - overlap, PIECE - overlap)]


def units(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(unit number, index of its word) of all units of some words, word after word."""
    marked = [b"<" + w + b">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))).astype(np.int32)
    number = lambda x: (mix64(x) >> np.uint64(64 - BITS)).astype(np.int32)
    found, owners = [number(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))], [np.arange(len(words), dtype=np.int32)]
    rolled = data
    with np.errstate(over="ignore"):
        for n in range(2, GRAMS[-1] + 1):
            if len(rolled) < 2:
                break
            rolled = rolled[:-1] * np.uint64(0x100000001B3) + data[n - 1 :]
            if n in GRAMS:
                at = np.flatnonzero(left[: len(rolled)] >= n)
                found.append(number(rolled[at] + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)))
                owners.append(owner[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], owner[order]


@dataclass
class Model:
    """``unit``: each unit's part of the toxic logit (SCALE times its vector times the softmax's weight difference)."""

    unit: np.ndarray
    bias: float

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        unit, owner = units(words)
        return np.bincount(owner, self.unit[unit], len(words)) / np.bincount(owner, minlength=len(words))

    def score(self, texts: list[bytes | None], known: dict[bytes, float]) -> np.ndarray:
        """The probability that each text is toxic; of no words at all, that of the bias.  ``known`` keeps words' scores from call to call."""
        split = [words_of(t) for t in texts]
        if len(known) > CACHE:
            known.clear()
        new = list({w for ws in split for w in ws}.difference(known))
        for lo in range(0, len(new), 1 << 16):
            part = new[lo : lo + (1 << 16)]
            known.update(zip(part, self.word_scores(part).tolist(), strict=True))
        out = np.full(len(texts), self.bias)
        for i, ws in enumerate(split):
            if ws:
                out[i] += sum(map(known.__getitem__, ws)) / max(SHORT, len(ws))
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def batches(order: np.ndarray, rows: int = 32) -> Iterator[np.ndarray]:
    return (order[lo : lo + rows] for lo in range(0, len(order), rows))


def bag(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(units, their weights) of a text: shares of its average.  A word's units share its weight alike."""
    words = words_of(text)
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    if not kinds:
        return np.zeros(0, np.int32), np.zeros(0)
    unit, owner = units(list(kinds))
    own = np.fromiter(kinds.values(), float, len(kinds)) / np.bincount(owner, minlength=len(kinds))
    used, at = np.unique(unit, return_inverse=True)
    return used, np.bincount(at, own[owner], len(used)) / max(SHORT, len(words))


def telling(texts: list[bytes | None], y: np.ndarray) -> np.ndarray:
    """Whether each unit's share of toxic texts differs from its share of the others by LEAST_Z standard errors; equal texts count once."""
    with_, many, known = np.zeros((2, 1 << BITS)), np.zeros(2), set()
    for text, t in zip(texts, y.astype(int), strict=True):
        words = sorted(set(words_of(text)))
        key = (t, hash(tuple(words)))
        if words and key not in known:
            known.add(key)
            many[t] += 1
            with_[t, np.unique(units(words)[0])] += 1
    share, both = (with_ + 0.5) / (many + 1)[:, None], (with_.sum(0) + 1) / (many.sum() + 2)
    z = (share[1] - share[0]) / np.sqrt(both * (1 - both) * (1 / np.maximum(many, 1)).sum())
    return (np.abs(z) >= LEAST_Z) & (with_.sum(0) >= LEAST_TEXTS)


def step_gradients(vectors: np.ndarray, weight: np.ndarray, bias: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log loss, units met, gradients of their vectors, of the softmax's weights, of its bias) of a batch of bags."""
    text = np.repeat(np.arange(len(own)), [len(u) for u, _ in own])
    unit, share = np.concatenate([u for u, _ in own]), SCALE * np.concatenate([s for _, s in own]).astype(float)
    used, at = np.unique(unit, return_inverse=True)
    mean = np.stack([np.bincount(text, share * vectors[unit, k], len(own)) for k in range(vectors.shape[1])], 1)
    z = mean @ weight + bias
    z -= z.max(1, keepdims=True)
    prob = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    target = np.stack([1 - y, y], 1)
    g = prob - target
    pull = g @ weight.T
    gv = np.stack([np.bincount(at, share * pull[text, k], len(used)) for k in range(vectors.shape[1])], 1)
    return -float(np.log(np.maximum((prob * target).sum(1), 1e-300)).sum()), used, gv, mean.T @ g, g.sum(0)


def train(texts: list[bytes | None], y: np.ndarray, passes: int = 20, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> Model:
    """Fit vectors and softmax to texts of which ``y`` is 1 if toxic.

    Without both labels, or a unit that tells them apart, every text gets the share of toxic ones.
    ``decay`` shrinks what a step touches.  Texts are cut twice, so that only their telling units are held.
    """
    rng = np.random.default_rng(seed)
    live = telling(texts, y) if 0 < y.sum() < len(y) else np.zeros(1 << BITS, bool)
    if not live.any():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(1 << BITS), float(np.log(p / (1 - p))))
    place = np.cumsum(live) - 1
    own = [(place[u[live[u]]], s[live[u]]) for u, s in map(bag, texts)]
    vectors, weight = rng.normal(0, 0.1, (int(live.sum()), DIM)), rng.normal(0, 0.3, (DIM, 2))
    bias = np.log(np.array([1 - y.mean(), y.mean()]))
    seen_v, seen_w = np.full(len(vectors), 1e-6), np.full((DIM, 2), 1e-6)
    for p in range(passes):
        step = rate * (1 - p / passes) + 0.01
        for batch in batches(rng.permutation(len(y))):
            _, used, gv, gw, gb = step_gradients(vectors, weight, bias, [own[i] for i in batch], y[batch])
            seen_w += gw**2
            weight -= step * gw / np.sqrt(seen_w)
            seen_v[used] += (gv**2).mean(1)
            vectors[used] = vectors[used] * (1 - step * decay) - step * gv / np.sqrt(seen_v[used])[:, None]
            bias -= 0.05 * step * gb / len(batch)
    unit = np.zeros(1 << BITS)
    unit[live] = SCALE * vectors @ (weight[:, 1] - weight[:, 0])
    return Model(unit, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, held: int = 0, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``rows`` labelled ids and ``most_bytes`` of their text, chosen by a hash of the id.

    Labels of ids whose crc32 modulo ``mod`` is ``held`` are not learnt from.  An id that several documents
    have counts with the smallest of their texts; null texts don't count.  Texts are taken in the hash's order, those that would
    exceed ``most_bytes`` passed over.  Without both labels in the sample every text scores the same.
    """
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        got = labelled(docs, labels, label, mod, held, rows, col(text_col).cast("string"), id_col)
        got = scratch.cut(got.select(F.xxhash64("_id").alias("h"), "_id", F.octet_length("_value").cast("long").alias("n"), "_y", F.col("_value").alias("t")), "sample")
        sizes = sorted(map(tuple, got.select("h", "_id", "n").collect()), key=lambda r: (r[0], str(r[1])))
        chosen, total = [], 0
        for h, i, n in sizes:
            if total + n <= most_bytes:
                chosen.append((i,))
                total += n
        ids = docs.sparkSession.createDataFrame(chosen, got.select(F.col("_id").alias("_of")).schema)
        got = got.join(F.broadcast(ids), F.col("_id") == F.col("_of")).select("h", "_y", "t").toArrow()
    texts, y = as_bytes(got["t"]), np.asarray(got["_y"]).astype(float)
    order = sorted(range(len(texts)), key=lambda i: (got["h"][i].as_py(), texts[i]))
    return train([texts[i] for i in order], y[order])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column (``name``, or one after it that clashes with none) of the probability that a text is toxic.

    Whole texts count.  A null, empty or wordless text gets the probability of no evidence.  Other columns,
    nulls and repeated rows pass through.  One scan, no shuffle; the model has a fixed size.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, float] = {}
        for texts in batches:
            parts = [held.value.score(as_bytes(x), known) for x in chunks(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))
        known.clear()
        trim()

    return docs.withColumn(fresh(docs.columns, name), toxic(col(text_col).cast("string")))

"""Language ID by word-first backoff.

A known word scores by its log frequency in each language.  An unseen word falls back to its longest
character n-grams that are known, and from there to shorter ones.  Log frequencies are add-one smoothed.
Words and n-grams are kept as 64-bit hashes beside their rows of log frequencies, in numpy, so that a
million of them takes some 30 MB and many words are looked up at once.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, Scratch, as_bytes, chunks, col, fresh, has_letter, mix64, remainder, trim

#: Bound of the sample: documents learnt from; all their words and n-grams are kept.  The longest n-gram.
SAMPLE_ROWS, LONGEST = 20_000, 5
#: Words whose scores or counts a worker keeps; characters of a word beyond which it counts as several words, its pieces of so many characters; words that are looked up at once.
CACHE, LONG_WORD, BLOCK = 150_000, 64, 8_192
UNKNOWN = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Words without ASCII marks; digits stay, and score nothing where no language knows them."""
    return text.translate(WORD_TABLE).split() if text else []


def folded(word: bytes) -> str:
    """Lower case beyond ASCII too, without marks and digits."""
    word = word.decode("utf-8", "ignore").lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def pieces(word: str) -> list[str]:
    """All of a word, in pieces of LONG_WORD characters at most that overlap so that no n-gram is lost: a paragraph without spaces is one word."""
    if len(word) <= LONG_WORD:
        return [word]
    overlap = LONGEST - 1
    return [word[i : i + LONG_WORD] for i in range(0, len(word) - overlap, LONG_WORD - overlap)]


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def hashed(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray], np.ndarray]]:
    """Of blocks of words of similar lengths: their places in the list, hashes of the words, hashes of the n-grams by length (a row a word), and the words' lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for lo in range(0, len(order), BLOCK):
        own = order[lo : lo + BLOCK]
        most = int(size[own[-1]])
        raw = np.array([f"^{words[i]}$".ljust(most + 2, "\0") for i in own.tolist()])
        c = raw.view(np.uint32).reshape(len(own), most + 2).astype(np.uint64)
        parts = {}
        with np.errstate(over="ignore"):
            h = np.zeros(len(own), np.uint64)
            for j in range(1, most + 1):
                h = np.where(j <= size[own], h * _ODD + c[:, j] + np.uint64(1), h)
            rolled = np.zeros_like(c)
            for n in range(1, min(LONGEST, most + 2) + 1):
                rolled = rolled[:, : most + 3 - n] * _ODD + c[:, n - 1 :] + np.uint64(1)
                parts[n] = mix64(rolled + np.uint64(n) * _ODD)
            yield own, mix64(h + size[own].astype(np.uint64)), parts, size[own]


@dataclass
class Model:
    """By length of n-grams, words at 0: sorted hashes, and beside each its log frequencies less their mean over the languages."""

    langs: list[str]
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def rows(self, size: int, h: np.ndarray) -> np.ndarray:
        """The row of ``logs`` of each hash, -1 for unknown ones."""
        keys = self.keys[size]
        if not len(keys):
            return np.full(h.shape, -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Log likelihoods of words less their mean, summed over the pieces of a long one; zeros where nothing of a word is known."""
        own, owner = [], []
        for k, w in enumerate(words):
            for piece in pieces(folded(w)):
                if piece:
                    own.append(piece)
                    owner.append(k)
        got = np.zeros((len(own), len(self.langs)))
        for place, whole, parts, size in hashed(own):
            at = self.rows(0, whole)
            known = at >= 0
            got[place[known]] = self.logs[0][at[known]]
            left = np.flatnonzero(~known)
            for n in sorted(parts, reverse=True):
                at = self.rows(n, parts[n][left])
                at[np.arange(at.shape[1]) > (size[left] + 2 - n)[:, None]] = -1
                count = (at >= 0).sum(1)
                met = count > 0
                row, _ = np.nonzero(at[met] >= 0)
                total = np.zeros((int(met.sum()), len(self.langs)))
                np.add.at(total, row, self.logs[n][at[met][at[met] >= 0]])
                got[place[left[met]]] = total / count[met, None]
                left = left[~met]
        out = np.zeros((len(words), len(self.langs)))
        np.add.at(out, np.array(owner, np.int64), got)
        return out

    def predict(self, texts: list[bytes | None], seen: "Seen") -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; ``seen`` keeps words' scores from call to call.

        All languages are equally likely beforehand, so that a rare language's short texts are not lost.
        """
        langs, scores = [], np.zeros(len(texts))
        if not self.langs:
            return [UNKNOWN] * len(texts), scores
        split = [words_of(t) for t in texts]
        seen.add(set(chain.from_iterable(split)), self)
        ends = np.concatenate([[0], np.cumsum([len(ws) for ws in split])])
        ids = np.fromiter(map(seen.place.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]))
        for i, text in enumerate(texts):
            if not text or not has_letter(text):
                langs.append(UNKNOWN)
                continue
            total = seen.matrix[ids[ends[i] : ends[i + 1]]].sum(0)
            p = np.exp(total - total.max())
            k = int(p.argmax())
            langs.append(self.langs[k])
            scores[i] = p[k] / p.sum()
        return langs, scores


class Seen:
    """Scores of words met before: each word's row of a matrix.  Where there would be more than CACHE, only those of the last call stay."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.matrix = np.zeros((0, 0))

    def add(self, words: set[bytes], model: Model) -> None:
        new = list(words.difference(self.place))
        if not new:
            return
        n = len(self.place)
        if n + len(new) > CACHE:
            stay = [w for w in words if w in self.place]
            kept = self.matrix[[self.place[w] for w in stay]]
            self.place, n = {w: k for k, w in enumerate(stay)}, len(stay)
            self.matrix[:n] = kept
        if n + len(new) > len(self.matrix):
            grown = np.zeros((max(CACHE, n + len(new)), len(model.langs)))  # untouched rows take no memory
            grown[:n] = self.matrix[:n] if n else 0
            self.matrix = grown
        self.matrix[n : n + len(new)] = model.scores(new)
        self.place.update(zip(new, range(n, n + len(new)), strict=True))


def counts_of(texts: list[bytes | None], own: Counter) -> None:
    """Add the folded words of some texts, long ones in pieces, to ``own``."""
    for text in texts:
        for w, n in Counter(words_of(text)).items():
            for f in pieces(folded(w)):
                if f:
                    own[f] += n


def gram_counts(words: list[str], counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length of n-gram, distinct hashes, counts) of blocks of distinct words with their counts; words are at length 0."""
    for place, whole, parts, size in hashed(words):
        n = counts[place]
        yield 0, whole, n
        for k, h in parts.items():
            inside = np.arange(h.shape[1]) <= (size + 2 - k)[:, None]
            found, at = np.unique(h[inside], return_inverse=True)
            yield k, found, np.bincount(at, np.broadcast_to(n[:, None], h.shape)[inside], len(found)).astype(np.int64)


def fit(docs: DataFrame, lang_col: str = "lang", mod: int = 4, held: int = 2, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from text and language of at most ``rows`` documents, chosen by a hash of id and text.

    Documents whose crc32 of the id modulo ``mod`` is ``held``, without an id, a text or a language, are
    not learnt from; documents alike in id and text are one.  Words, and the n-grams of all of them, are counted on the executors; hashes and
    counts of all that the sample holds come to the driver, so the sample bounds the model.  Without any such document the model
    knows no language.
    """
    own = docs.where((remainder(col(id_col), mod) != held) & col(text_col).isNotNull() & col(lang_col).isNotNull())
    own = own.select(col(text_col).cast("string").alias("t"), col(lang_col).cast("string").alias("lang"), F.xxhash64(col(id_col).cast("string"), col(text_col).cast("string")).alias("h"))
    last = own.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h").alias("h")).first().h
    own = own.where(F.col("h") <= F.lit(last if last is not None else 0)).dropDuplicates(["h", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            each = [pa.array(x, t) for x, t in (([g for g, c in counts.items() for _ in c], pa.string()), ([w for c in counts.values() for w in c], pa.string()), ([n for c in counts.values() for n in c.values()], pa.int64()))]
            counts.clear()
            return pa.RecordBatch.from_arrays(each, ["lang", "w", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), as_bytes(batch["t"]), strict=True):
                counts_of([text], counts[lang])
                if sum(map(len, counts.values())) > CACHE:
                    yield out()
        if counts:
            yield out()
        trim()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words, n = np.array(batch["lang"].to_pylist(), object), batch["w"].to_pylist(), np.asarray(batch["n"])
            for lang in sorted(set(langs)):
                at = np.flatnonzero(langs == lang)
                for size, h, c in gram_counts([words[i] for i in at.tolist()], n[at]):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64)), pa.array(c)], ["lang", "size", "h", "n"])
        trim()

    with Scratch(docs.sparkSession, "lang") as scratch:
        words = scratch.cut(own.select("lang", "t").mapInArrow(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")), "words")
        every = words.mapInArrow(cut, "lang string, size int, h long, n long").groupBy("lang", "size", "h").agg(F.sum("n").alias("n")).toArrow()
        langs = [r.lang for r in own.select("lang").distinct().collect()] if last is not None else []
    return modelled(every["lang"], *(np.asarray(every[c]) for c in ("size", "h", "n")), langs)


def build(counts: list[tuple[str, str, int]]) -> Model:
    """A model from (language, word, count)."""
    parts = [(lang, *x) for lang in sorted({c[0] for c in counts}) for own in [[c for c in counts if c[0] == lang]] for x in gram_counts([c[1] for c in own], np.array([c[2] for c in own], np.int64))]
    flat = lambda k, kind: np.concatenate([x[k] for x in parts]).astype(kind) if parts else np.zeros(0, kind)
    sizes = np.concatenate([np.full(len(x[2]), x[1]) for x in parts]) if parts else np.zeros(0, np.int64)
    return modelled(pa.array([x[0] for x in parts for _ in x[2]], pa.string()), sizes, flat(2, np.uint64).view(np.int64), flat(3, np.int64), [c[0] for c in counts])


def modelled(lang: pa.Array, size: np.ndarray, h: np.ndarray, n: np.ndarray, langs: list[str]) -> Model:
    """A model from counts: language, length, hash and number, side by side; the same key may come in several rows."""
    langs = sorted(set(langs))
    code = np.asarray(pa.compute.index_in(lang, pa.array(langs, pa.string()))).astype(np.int64) if len(lang) else np.zeros(0, np.int64)
    keys, logs = {}, {}
    for k in range(LONGEST + 1):
        at = np.flatnonzero(size == k)
        keys[k], row = np.unique(h[at].view(np.uint64), return_inverse=True)
        seen = np.zeros((len(keys[k]), len(langs)))
        np.add.at(seen, (row, code[at]), n[at])
        got = np.log(seen + 1) - np.log(seen.sum(0) + len(seen) + 1)
        logs[k] = (got - got.mean(1, keepdims=True)).astype(np.float32) if langs else got
    return Model(langs, keys, logs)


def identify(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name`` (under a name that clashes with none): lang_pred, score.

    ``score`` is the posterior of the predicted language.  A text that is null or has no letter is ``und``
    with score 0, and so is any text if the model knows no language; ties go to the language first by code
    point.  Whole texts count; other columns, nulls and repeated rows pass through.  One scan, no shuffle;
    the model is bounded by the sample it was fitted on.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def lang(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = Seen()
        for texts in batches:
            langs, scores = [], []
            for part in chunks(texts):
                g, s = held.value.predict(as_bytes(part), seen)
                langs += g
                scores += s.tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))
        del seen
        trim()

    return docs.withColumn(fresh(docs.columns, name), lang(col(text_col).cast("string")))

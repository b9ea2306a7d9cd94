"""N-gram Jaccard join with signature trees.

Documents with the same set of word n-grams are one class.  Two classes can only reach the similarity if they
share tokens of their prefixes, at least L of the first n - ceil(t n) + L in a global order that puts tokens made of
words which are rare in the corpus first; L grows with the size.  Classes of near sizes that hang together by shared prefix tokens
form a cluster, and a cluster too large for one task is parted by hashes of whole parts of its sets; in a cluster a signature tree, whose nodes hold the OR of their classes' token bitmaps and their range of sizes, is
traversed against itself: a pair of nodes whose largest possible overlap is too small is left out, and so
is one whose classes are known to hang together already.  Pairs of classes that remain are confirmed by
their exact overlap.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, Scratch, as_bytes, bits_at, chunks, col, free_shuffles, fresh, mix64, trim
from ..operators.components import components

#: Words whose frequency makes the order of tokens, all others being rare; the least count within a block of words to be counted.
COMMON, BLOCK_COUNT, BLOCK_WORDS = 65_536, 8, 1 << 20
#: A prefix has a SPARE-th of its set more than it must; tokens of more than FEW classes of a band link all to one of them.
SPARE, FEW = 20, 64
#: Tokens of a cluster that one task takes whole; a larger cluster is dealt into buckets of half as many.
CLUSTER_TOKENS = 1 << 20
#: Prefix tokens that are joined at a time, in at most so many spans of sizes; tokens of large clusters that are counted at a time.
SPAN_TOKENS, SPANS, COUNT_TOKENS = 1 << 23, 8, 1 << 25
#: Tokens of sets that stand on disk at a time, in at most so many rounds, each of which reads the texts again.
SET_TOKENS, ROUNDS = 1 << 26, 4
#: Bits of a signature in words of 64, members of a leaf, pivots taken from a bucket of a large cluster.
WORDS, LEAF, PIVOTS = 16, 48, 8
#: Bytes of the filter by which documents that need not be read again are passed over: 8 bits a document, up to this.
FILTER_BYTES = 16 << 20
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mix64(np.arange(256 * 256, dtype=np.uint64) * _ODD + np.uint64(0x1234567))


def needed(n: int, m: int, num: int, den: int) -> int:
    """The least overlap of sets of ``n`` and ``m`` tokens at a similarity of num/den: den * o >= num * (n + m - o)."""
    return -(-num * (n + m) // (num + den))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, start) of each word ``[^\\x20\\x09-\\x0D]+`` of lower-cased bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    size = end - start
    at = np.flatnonzero(inside)
    place = at - np.repeat(start, size)
    with np.errstate(over="ignore"):
        h = _TABLE[((place & 255) << 8) | raw[at]]
        if size.max() > 256:
            h = h * ((place >> 8).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        out = np.add.reduceat(h, np.cumsum(size) - size)
        return mix64(out + size.astype(np.uint64) * _ODD), start


def words_in(texts: list[bytes | None], block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, where each text's begin and the last one's end) of runs of texts of about ``block`` bytes."""
    pending: list[bytes] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        h, start = word_hashes(b"\n".join(pending).lower())
        ends = np.cumsum([len(x) + 1 for x in pending])
        pending.clear()
        return h, np.concatenate([[0], np.searchsorted(start, ends)])

    size = 0
    for t in texts:
        t = t or b""
        if len(t) > 4 * block:  # a very long text goes alone, in pieces that end at a space
            if pending:
                yield joined()
                size = 0
            parts, at = [], 0
            low = t.lower()
            while at < len(low):
                end = min(len(low), at + block)
                while end < len(low) and not _SPACE[low[end]]:
                    end += 1
                parts.append(word_hashes(low[at:end])[0])
                at = end
            h = np.concatenate(parts)
            yield h, np.array([0, len(h)])
            continue
        pending.append(t)
        size += len(t)
        if size >= block:
            yield joined()
            size = 0
    if pending:
        yield joined()


def shingle_sets(texts: list[bytes | None], k: int, block: int = 1 << 20) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles; all words of a shorter text are one."""
    return [s for h, cut in words_in(texts, block) for s, _ in shingles(h, cut, k)]


def shingles(h: np.ndarray, cut: np.ndarray, k: int, weight: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(sorted distinct shingles, the sum of their words' ``weight``) of each text."""
    with np.errstate(over="ignore"):
        s, w = h, weight
        for j in range(1, k):
            s = mix64(s[: max(0, len(h) - j)] * np.uint64(0xD6E8FEB86659FD93) + h[j:])
            w = w if w is None else w[: max(0, len(h) - j)] + weight[j:]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= k:
                if w is None:
                    yield np.unique(s[a : b - k + 1]), None
                else:
                    own, first = np.unique(s[a : b - k + 1], return_index=True)
                    yield own, w[a + first]
            elif b > a:
                x = h[a]
                for j in range(a + 1, b):
                    x = mix64(np.array([x * np.uint64(0xD6E8FEB86659FD93) + h[j]]))[0]
                yield np.array([x ^ np.uint64(b - a)], np.uint64), np.zeros(1, np.int64)
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def first_half(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def half_key():
    """``first_half`` of the column ``key``."""
    return F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")


def common_words(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur BLOCK_COUNT times at least, with how often."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, counts = np.unique(np.concatenate(words), return_counts=True)
    often = counts >= BLOCK_COUNT
    return found[often], counts[often]


def weights_of(h: np.ndarray, common: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weight of each word, 0 for one that is not common."""
    if not len(common):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return np.where(common[at] == h, weight[at], 0)


def prefix(s: np.ndarray, weight: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first tokens of a set in the global order: by the weight of their words, then by hash.

    One more than linked sets can lack, and ``spare`` tokens more, so that linked sets share 1 + ``spare``.
    """
    n = len(s) + (-num * len(s) // den) + 1 + len(s) // SPARE
    return s[np.lexsort([s, weight])[:n]]


def band_width(num: int, den: int) -> float:
    """How far the logarithms of sizes in one band may differ."""
    return -log(num / den) * (1 + 1e-9) if num < den else 1.0


def band_of(num: int, den: int):
    """The band of a size ``n``: sizes of a band differ by a factor of num / den at most, so linked classes are in one band or in adjoining ones."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(band_width(num, den))).cast("long")


def part_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of parts of a set, of which linked sets have at least one in common.

    Sets that link, the larger one in a band, differ by ``lack`` tokens at most.  Dealt by hash into ``lack`` + 1 parts and two more for
    each of ``spare``, they differ in ``lack`` parts; each set leaves out its ``spare`` smallest, which say least, so one
    part that is alike stays in both.  A set has parts for its own band and for the next one, where a larger partner may be.
    """
    width, out = band_width(num, den), []
    own = int(log(len(s)) / width)
    for band in (own, own + 1):
        lack = 2 * int(exp((band + 1) * width) * (1 + 1e-9)) * (den - num) // (num + den)
        spare = (lack + 1) // 8
        parts = lack + 1 + 2 * spare
        part = (s % np.uint64(parts)).astype(np.int64)
        count = np.bincount(part, minlength=parts)
        total, filled = np.zeros(parts, np.uint64), count > 0
        with np.errstate(over="ignore"):
            total[filled] = np.add.reduceat(s[np.argsort(part, kind="stable")], (np.cumsum(count) - count)[filled])
            name = mix64(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32))
            out.append(mix64(total + name + count.astype(np.uint64) * _ODD)[np.argsort(count, kind="stable")[spare:]])
    return np.concatenate(out).view(np.int64)


def spans_of(tokens: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Runs of bands, first and last, that together hold every band: at most SPANS, of about equally many ``tokens``."""
    if not tokens:
        return [(0, 0)]
    total = sum(tokens.values())
    parts = min(SPANS, max(1, -(-total // most)))
    out, low, held = [], None, 0
    for b in sorted(tokens):
        low = b if low is None else low
        held += tokens[b]
        if held * parts >= total * (len(out) + 1):
            out.append((low, b))
            low = None
    return out


class Forest:
    """Which members hang together; edges are those that joined two groups."""

    def __init__(self, labels: np.ndarray):
        first: dict = {}
        self.up = np.array([first.setdefault(x, i) for i, x in enumerate(labels.tolist())], np.int64)
        self.edges: list[tuple[int, int]] = []

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            n = self.up[r]
            if (n == r).all():
                self.up[at] = r
                return r
            r = n

    def join(self, a: int, b: int) -> None:
        x, y = self.roots(np.array([a, b])).tolist()
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


class SignatureTree:
    """Members in the order of their sizes, in leaves; nodes above hold the OR of bitmaps and the range of sizes."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, leaf: int = LEAF):
        self.order = np.argsort(sizes, kind="stable")
        n = len(self.order)
        starts = np.arange(0, max(n, 1), leaf)
        s = sizes[self.order]
        ends = np.minimum(starts + leaf, n)
        # Tokens of a member beyond its bits: what shares a bit with another of its tokens.
        slack = (sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64))[self.order] if n else sizes
        level = [(int(a), int(b), np.bitwise_or.reduce(bitmaps[self.order[a:b]], axis=0), int(s[a]), int(s[b - 1]), None, int(slack[a:b].max())) for a, b in zip(starts, ends, strict=True) if b > a]
        while len(level) > 1:
            up = []
            for i in range(0, len(level), 4):
                kids = level[i : i + 4]
                up.append((kids[0][0], kids[-1][1], np.bitwise_or.reduce([x[2] for x in kids], axis=0), kids[0][3], kids[-1][4], kids, max(x[6] for x in kids)))
            level = up
        self.root = level[0] if level else None


def bitmap(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    bits = np.zeros(words * 64, np.uint8)
    bits[(s % np.uint64(words * 64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def match(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int, sides: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(edges that join members, number of partners confirmed for each) by dual traversal of a signature tree.

    ``labels`` tells which members hang together already.  With ``sides`` only pairs of a member of side 0
    with one of side 1 count.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    bitmaps = np.stack([bitmap(s) for s in sets]) if n else np.zeros((0, WORDS), np.uint64)
    forest, degree, tree = Forest(labels), np.zeros(n, np.int64), SignatureTree(sizes, bitmaps)
    if tree.root is None:
        return [], degree
    flat, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(flat), np.int32)
    order = tree.order

    def leaves(x, y) -> None:
        a, b = order[x[0] : x[1]], order[y[0] : y[1]]
        ra, rb = forest.roots(a), forest.roots(b)
        open_ = ra[:, None] != rb[None, :]
        if x is y:
            open_ &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        if sides is not None:
            open_ &= sides[a][:, None] != sides[b][None, :]
        least = -(-num * (sizes[a][:, None] + sizes[b][None, :]) // (num + den))
        open_ &= np.minimum(sizes[a][:, None], sizes[b][None, :]) >= least
        if not open_.any():
            return
        i, j = np.nonzero(open_)
        # Each bit that only one side has stands for at least one token that the other lacks.
        only_a = np.bitwise_count(bitmaps[a[i]] & ~bitmaps[b[j]]).sum(1, dtype=np.int64)
        only_b = np.bitwise_count(bitmaps[b[j]] & ~bitmaps[a[i]]).sum(1, dtype=np.int64)
        good = np.minimum(sizes[a[i]] - only_a, sizes[b[j]] - only_b) >= least[i, j]
        i, j = i[good], j[good]
        for r in np.unique(i):
            p = int(a[r])
            q = b[j[i == r]]
            q = q[forest.roots(q) != forest.roots(np.array([p]))[0]]
            if not len(q):
                continue
            own = code[start[p] : start[p + 1]]
            marked[own] = 1
            got = np.array([int(marked[code[start[m] : start[m + 1]]].sum()) for m in q.tolist()])
            marked[own] = 0
            for m in q[den * got >= num * (sizes[p] + sizes[q] - got)].tolist():
                degree[p] += 1
                degree[m] += 1
                forest.join(p, m)

    stack = [(tree.root, tree.root)]
    while stack:
        x, y = stack.pop()
        # Sizes too far apart.
        if den * x[4] < num * y[3] or den * y[4] < num * x[3]:
            continue
        # An overlap of o tokens has o - slack bits at least, all of them in both nodes.
        most = min(x[6], y[6]) + int(np.bitwise_count(x[2] & y[2]).sum())
        if x is not y and most < needed(x[3], y[3], num, den):
            continue
        if x[5] is None and y[5] is None:
            leaves(x, y)
        elif x is y:
            kids = x[5]
            stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
        elif y[5] is None or x[5] is not None and x[1] - x[0] >= y[1] - y[0]:
            stack += [(k, y) for k in x[5]]
        else:
            stack += [(x, k) for k in y[5]]
    return forest.edges, degree


def similar(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", cluster_tokens: int = CLUSTER_TOKENS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, set_key, digest (MD5 of the text).

    The set of a document: the distinct ``k``-word shingles of its whole text, A-Z lower-cased, words being
    ``[^\\x20\\x09-\\x0D]+``; all words of a shorter text are one shingle.  Two documents link when
    den * |A and B| >= num * |A or B|.  component_id is the smallest doc_id reachable by links, itself
    included.  A null or wordless text has no set and links with nothing.  Rows that repeat an id are
    rows of their own; a row with a null id takes part, but is never a component's id (null if there is no other).

    Shingles count by 64-bit hashes, sets by 128-bit digests.

    Scale: texts are read twice, then those whose set is in a cluster, in ROUNDS at most, so that only one round's sets stand on
    disk; those of large clusters are read before that for the parts of their sets.  Between the passes go a row a document, and prefix tokens, a tenth of a set at 0.9.  The list of common words is
    bounded and changes only the order.  Prefix tokens are joined for one span of sizes after the other, so what
    stands on disk is one span's.  A cluster beyond ``cluster_tokens`` is parted by parts of its sets that are alike, and what is
    still beyond by prefixes in the order of exact counts; what then still is beyond is dealt into buckets by size and hash: each is matched by itself, then with pivots of the others, the members with
    most partners; buckets are then dealt anew by component, so that only members outside the main one
    meet all others.  Copies and near copies of one text thus never make all their pairs.
    """
    spark = docs.sparkSession
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    marked = texts.withColumn("digest", F.md5("text"))
    with Scratch(spark, "jaccard") as scratch:

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            known: set[bytes] = set()
            size = 0

            def rows(ids, digests, n, keys, words, counts) -> pa.RecordBatch:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([ids, digests, n, keys, words, counts], kinds, strict=True)], ["doc_id", "digest", "n", "key", "word", "count"])

            def common() -> pa.RecordBatch:
                words, counts = common_words(held)
                held.clear()
                known.clear()
                none = [None] * len(words)
                return rows(none, none, none, none, words.view(np.int64), counts)

            for batch in batches:
                ids, digests, at = batch["doc_id"], batch["digest"], 0
                for part in chunks(batch["text"]):
                    for h, cut in words_in(as_bytes(part)):
                        sets = [s for s, _ in shingles(h, cut, k)]
                        keys = [set_key(s) if len(s) else None for s in sets]
                        none = [None] * len(sets)
                        yield rows(ids.slice(at, len(sets)), digests.slice(at, len(sets)), [len(s) for s in sets], keys, none, none)
                        at += len(sets)
                        for key, a, b in zip(keys, cut[:-1], cut[1:], strict=True):
                            if key and key not in known:  # a copy says nothing new about words
                                known.add(key)
                                held.append(h[a:b])
                                size += int(b - a)
                                if size >= BLOCK_WORDS:
                                    yield common()
                                    size = 0
            yield common()
            trim()

        seen = scratch.cut(marked.mapInArrow(first, "doc_id long, digest string, n long, key binary, word long, count long"), "seen")
        rows = seen.where("n is not null").select("doc_id", "digest", "n", "key")
        often = seen.where("word is not null").groupBy("word").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "word").limit(COMMON).toPandas()
        words = often["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(words)
        held_common = spark.sparkContext.broadcast((words[order], np.ceil(4 * np.log2(1 + often["c"].to_numpy(np.int64)[order])).astype(np.int64)))

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch["text"]):
                    for h, cut in words_in(as_bytes(part)):
                        sets = [(s, w) for s, w in shingles(h, cut, k, weights_of(h, *held_common.value)) if len(s)]
                        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s, _ in sets], pa.binary()), pa.array([len(s) for s, _ in sets], pa.int64()), pa.array([prefix(s, w, num, den).tobytes() for s, w in sets], pa.binary())], ["key", "n", "prefix"])
            trim()

        classes = scratch.cut(texts.mapInArrow(second, "key binary, n long, prefix binary").groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "classes")

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, own = batch["key"].to_pylist(), [np.frombuffer(p, np.int64) for p in batch["prefix"].to_pylist()]
                if own:
                    times = [len(p) for p in own]
                    node, n = (np.repeat(np.array(x, np.int64), times) for x in ([first_half(x) for x in keys], batch["n"].to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(node), pa.array(n)], ["token", "node", "n"])

        free_shuffles(spark)
        band = band_of(num, den)
        tokens = {r.own: int(r.t * (1 - num / den + 1 / SPARE)) for r in rows.where("n > 0").groupBy(band.alias("own")).agg(F.sum("n").alias("t")).collect()}
        links = []
        for i, (low, high) in enumerate(spans_of(tokens, SPAN_TOKENS)):
            # A class meets its own band and the next one; a pair counts in the higher of its bands, so within one span.
            inside = classes.where(band.between(low - 1, high)).mapInArrow(spell, "token long, node long, n long")
            links.append(links_of(scratch, inside, low, high, num, den, str(i)))
        links = reduce(DataFrame.unionByName, links).distinct()
        clusters = components(links, checkpoint="jaccard-clusters").select("node", F.col("component").alias("cluster"))
        scratch.drop("classes")
        free_shuffles(spark)

        # One document for each class of a cluster: its set is made again, and only its.
        reps = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")).withColumn("node", half_key())
        members = scratch.cut(reps.join(clusters, "node").select("key", "doc_id", "n", "cluster"), "members")
        edges = edges_of(spark, scratch, texts, members, k, num, den, cluster_tokens)
        parts = components(edges, checkpoint="jaccard-parts")
        info = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
        info = info.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        low = info.groupBy("component").agg(F.min("least").alias("component_id")).select(F.hex("component").alias("_component"), "component_id")
        info = info.withColumn("_component", F.hex("component")).join(low, "_component").select(F.hex("key").alias("set_key"), "component_id")
        # Joined by another form of the key, here as above: both sides exchange, and adaptive execution splits a text that many documents have.
        out = rows.select("doc_id", "digest", F.col("n").alias("n_shingles"), F.hex("key").alias("set_key")).join(info, "set_key", "left")
        return scratch.keep(out.select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "set_key", "digest"))


def links_of(scratch: Scratch, spelt: DataFrame, low: int, high: int, num: int, den: int, name: str) -> DataFrame:
    """Links (a, b) between classes that may reach the similarity, of the bands ``low`` to ``high``, from prefix tokens (token, node, n)."""
    shared = scratch.cut(spelt.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("token").alias("t")), f"shared{name}")
    met = spelt.join(shared, F.col("token") == F.col("t")).select("token", "node", "n", band_of(num, den).alias("own"))
    met = scratch.cut(met.withColumn("band", F.explode(F.array("own", F.col("own") + 1))).where(F.col("band").between(low, high)), f"met{name}")
    scratch.drop(f"shared{name}")
    free_shuffles(scratch.spark)
    stats = met.groupBy("token", "band").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("hub")).where("c > 1")
    stats = scratch.cut(stats.select(F.col("token").alias("t"), F.col("band").alias("b"), "c", "hub"), f"stats{name}")
    at = (F.col("token") == F.col("t")) & (F.col("band") == F.col("b"))
    hot = met.join(stats.where(F.col("c") > FEW), at).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    # Of other tokens each pair of near sizes counts, once in the higher of its bands: linked classes that no hot token
    # joins share as many as the smaller one's spare tokens and one.
    few = met.join(stats.where(F.col("c") <= FEW), at).groupBy("token", "band").agg(F.collect_list(F.struct("node", "n", "own")).alias("m"))
    close = lambda x, y: F.lit(num) * F.greatest(x["n"], y["n"]) <= F.lit(den) * F.least(x["n"], y["n"])
    couples = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (x["node"] < y["node"]) & (F.greatest(x["own"], y["own"]) == F.col("band")) & close(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), F.least(x["n"], y["n"]).alias("n")))))
    pairs = few.select(F.explode(couples).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("c"), F.min("p.n").alias("n"))
    links = scratch.cut(hot.unionByName(pairs.where(F.col("c") >= 1 + F.floor(F.col("n") / SPARE)).select("a", "b")).distinct(), f"links{name}")
    for table in ("met", "stats"):
        scratch.drop(table + name)
    free_shuffles(scratch.spark)
    return links


def edges_of(spark, scratch: Scratch, texts: DataFrame, members: DataFrame, k: int, num: int, den: int, cluster_tokens: int) -> DataFrame:
    """Links (a, b) between classes that connect all classes which links connect."""

    def made(rows: DataFrame, what, column: str, kind: pa.DataType) -> DataFrame:
        """(cluster, key, n and ``column``: ``what`` of the set) of members; the texts are read again, and only theirs taken."""
        named = KeyFilter(rows.where("doc_id is not null"), F.col("doc_id"), FILTER_BYTES)
        nulls = rows.where("doc_id is null").limit(1).count() > 0
        held = named.found

        def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = bits_at(held.value, np.asarray(batch["place"].fill_null(-1))) | (np.asarray(batch["doc_id"].is_null()) & nulls)
                batch = batch.filter(pa.array(keep))
                ids, done = batch["doc_id"], 0
                for part in chunks(batch["text"]):
                    sets = shingle_sets(as_bytes(part), k)
                    yield pa.RecordBatch.from_arrays([ids.slice(done, len(part)), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()), pa.array([what(s) if len(s) else None for s in sets], kind)], ["id", "k", column])
                    done += len(part)
            trim()

        spelt = texts.withColumn("place", named.place(F.col("doc_id"))).mapInArrow(third, f"id long, k binary, {column} {'binary' if kind == pa.binary() else 'array<bigint>'}").where("k is not null")
        # Rows that repeat an id and a text give a class twice; matching takes the first.
        return spelt.join(rows, (F.col("k") == F.col("key")) & F.col("id").eqNullSafe(F.col("doc_id"))).select("cluster", "key", "n", column)

    def sets(rows: DataFrame) -> DataFrame:
        return made(rows, lambda s: s.tobytes(), "tokens", pa.binary())

    def beyond(rows: DataFrame, name: str) -> DataFrame:
        """The clusters too large for one task."""
        return scratch.cut(rows.groupBy("cluster").agg(F.sum("n").alias("total")).where(F.col("total") > cluster_tokens).select("cluster"), name)

    def tokens_of(rows: DataFrame) -> int:
        return int(rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t)

    def small(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        part = part.drop_duplicates("key")
        for _, own in part.groupby("cluster", sort=False):
            keys = own["key"].tolist()
            got, _ = match([np.frombuffer(t, np.uint64) for t in own["tokens"]], np.arange(len(own)), num, den)
            out += [(keys[a], keys[b]) for a, b in got]
        return pd.DataFrame(out, columns=["a", "b"])

    def matched(rows: DataFrame, total: int, name: str) -> DataFrame:
        packs = max(1, -(-total // cluster_tokens))
        return scratch.cut(rows.withColumn("pack", F.pmod(F.xxhash64("cluster"), F.lit(packs))).groupBy("pack").applyInPandas(small, "a binary, b binary"), name)

    big = beyond(members, "large")
    any_big = not big.isEmpty()
    if any_big:
        # Large clusters are parted before sets are made: a passage that many texts have brings most of a large corpus together.
        own = members.join(big, "cluster", "left_semi")
        wide = scratch.cut(made(own, lambda s: part_keys(s, num, den), "parts", pa.list_(pa.int64())).select("cluster", half_key().alias("node"), "parts"), "wide")
        free_shuffles(spark)
        finer = parted(scratch, wide)
        scratch.drop("wide")
        rest = members.join(big, "cluster", "left_anti")
        members = scratch.cut(rest.unionByName(own.withColumn("node", half_key()).drop("cluster").join(finer, "node").drop("node")), "parted")
        big = beyond(members, "larger")
        any_big = not big.isEmpty()
    rest = members.join(big, "cluster", "left_anti") if any_big else members
    rounds = max(1, min(ROUNDS, -(-tokens_of(rest) // SET_TOKENS)))
    found = []
    for i in range(rounds):
        own = rest.where(F.pmod(F.xxhash64("cluster", F.lit(rounds)), F.lit(rounds)) == i)
        found.append(matched(sets(own), tokens_of(own), f"edges{i}"))
        free_shuffles(spark)
    edges = reduce(DataFrame.unionByName, found)
    if not any_big:
        return edges
    full = scratch.cut(sets(members.join(big, "cluster", "left_semi")).dropDuplicates(["key"]), "sets")
    free_shuffles(spark)
    finer = refined(scratch, full, num, den)
    full = scratch.cut(full.withColumn("node", half_key()).drop("cluster").join(finer, "node").drop("node"), "finer")
    scratch.drop("sets")
    free_shuffles(spark)
    big = beyond(full, "largest")
    rest = full.join(big, "cluster", "left_anti")
    edges = edges.unionByName(matched(rest, tokens_of(rest), "more"))
    if big.isEmpty():
        return edges
    return edges.unionByName(large(scratch, full.join(big, "cluster"), num, den, cluster_tokens))


def parted(scratch: Scratch, wide: DataFrame) -> DataFrame:
    """(node, cluster) of the members of large clusters (cluster, node, parts) that may link, in finer clusters: those that have a part in common."""
    pieces = max(1, -(-int(wide.agg(F.sum(F.size("parts")).alias("t")).first().t or 0) // COUNT_TOKENS))
    rows = wide.select("cluster", "node", F.explode("parts").alias("part"))
    links = []
    for i in range(pieces):
        own = rows.where(F.pmod("part", F.lit(pieces)) == i)
        hubs = own.groupBy("cluster", "part").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
        hubs = scratch.cut(hubs.select(F.col("cluster").alias("_c"), F.col("part").alias("p"), "hub"), f"alike{i}")
        at = (F.col("cluster") == F.col("_c")) & (F.col("part") == F.col("p"))
        links.append(scratch.cut(own.join(hubs, at).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), f"joined{i}"))
        scratch.drop(f"alike{i}")
        free_shuffles(scratch.spark)
    finer = components(reduce(DataFrame.unionByName, links), checkpoint="jaccard-parted").select("node", F.col("component").alias("cluster"))
    for i in range(pieces):
        scratch.drop(f"joined{i}")
    free_shuffles(scratch.spark)
    return finer


def refined(scratch: Scratch, full: DataFrame, num: int, den: int) -> DataFrame:
    """(node, cluster) of the members of large clusters that may link, in finer clusters.

    Prefixes again, now in the order of how many members of the cluster have a token, by exact counts.  A member that alone has
    more tokens than it may lack links with none, so texts that only a common passage brought together part here.
    """
    spark = scratch.spark
    parts = max(1, -(-int(full.agg(F.sum("n").alias("t")).first().t) // COUNT_TOKENS))

    def spell(part: int):
        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [np.frombuffer(t, np.uint64) for t in batch["tokens"].to_pylist()]
                own = [t[t % np.uint64(parts) == part].view(np.int64) for t in own]
                if own:
                    nodes = [first_half(x) for x in batch["key"].to_pylist()]
                    cluster, node, n = (np.repeat(np.array(x, np.int64), [len(t) for t in own]) for x in (batch["cluster"].to_pylist(), nodes, batch["n"].to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(np.concatenate(own)), pa.array(node), pa.array(n)], ["cluster", "token", "node", "n"])

        return full.select("cluster", "key", "n", "tokens").mapInArrow(tokens, "cluster long, token long, node long, n long")

    held = []
    for i in range(parts):
        counts = spell(i).groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        counts = scratch.cut(counts.select(F.col("cluster").alias("_c"), F.col("token").alias("t"), "c"), f"counts{i}")
        same = (F.col("cluster") == F.col("_c")) & (F.col("token") == F.col("t"))
        held.append(scratch.cut(spell(i).join(counts, same).select("cluster", "token", "node", "n", "c"), f"held{i}"))
        scratch.drop(f"counts{i}")
        free_shuffles(spark)
    least = F.ceil(F.lit(num) * F.col("n") / F.lit(den) - 1e-6).cast("int")
    # Tokens of one member alone come first in the order; the prefix has as many of the others as they leave room for.
    member = Window.partitionBy("cluster", "node", "n")
    own = reduce(DataFrame.unionByName, held).withColumn("i", F.row_number().over(member.orderBy("c", "token"))).withColumn("s", F.count(F.lit(1)).over(member))
    first = own.where(F.col("i") <= F.col("s") - least + 1)
    first = first.select("cluster", "node", "token", F.explode(F.array(band_of(num, den), band_of(num, den) + 1)).alias("band"))
    first = scratch.cut(first, "first")
    for i in range(parts):
        scratch.drop(f"held{i}")
    free_shuffles(spark)
    hubs = first.groupBy("cluster", "token", "band").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("hub")).where("c > 1")
    hubs = scratch.cut(hubs.select(F.col("cluster").alias("_c"), F.col("token").alias("t"), F.col("band").alias("b"), "hub"), "hubs")
    at = (F.col("cluster") == F.col("_c")) & (F.col("token") == F.col("t")) & (F.col("band") == F.col("b"))
    links = first.join(hubs, at).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    finer = components(links, checkpoint="jaccard-finer").select("node", F.col("component").alias("cluster"))
    for name in ("first", "hubs"):
        scratch.drop(name)
    free_shuffles(spark)
    return finer


def large(scratch: Scratch, full: DataFrame, num: int, den: int, cluster_tokens: int) -> DataFrame:
    """Links within clusters too large for one task."""
    each = max(1, cluster_tokens // 2)
    full = full.withColumn("band", band_of(num, den))

    def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
        """With ``bucket``: a part of about ``each`` tokens of the rows alike in ``by``."""
        parts = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / each)).cast("long").alias("parts"))
        rows = rows.join(parts, by).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
        return rows.withColumn("bucket", F.concat_ws("/", *[F.col(c).cast("string") for c in by], F.col("part").cast("string"))).drop("parts", "part")

    def run(rows: DataFrame, name: str) -> DataFrame:
        """Match the rows of each ``task``; sides 0 and 1, or all with all where there is one side."""

        def one(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("side").drop_duplicates(["key", "side"]).reset_index(drop=True)
            sides = part["side"].to_numpy()
            keys = part["key"].tolist()
            got, degree = match([np.frombuffer(t, np.uint64) for t in part["tokens"]], part["label"].to_numpy(), num, den, sides if (sides == 1).any() else None)
            out = [(keys[a], keys[b], 0) for a, b in got if keys[a] != keys[b]]
            best = np.argsort(-degree, kind="stable")[:PIVOTS]
            return pd.DataFrame(out + [(keys[i], keys[i], 1) for i in best.tolist()], columns=["a", "b", "pivot"])

        return scratch.cut(rows.groupBy("task").applyInPandas(one, "a binary, b binary, pivot int"), name)

    start = dealt(full, ["cluster", "band"])
    alone = run(start.select(F.col("bucket").alias("task"), F.lit(0).alias("side"), "key", "tokens", F.hex("key").alias("label")), "alone")
    edges = alone.where("pivot = 0").select("a", "b")
    labels = components(edges, checkpoint="jaccard-alone").withColumnRenamed("node", "key")
    label = lambda rows: rows.join(labels, "key", "left").withColumn("label", F.hex(F.coalesce("component", "key"))).drop("component")
    pivots = label(full.join(alone.where("pivot = 1").select(F.col("a").alias("key")), "key", "left_semi"))
    named = start.select("cluster", "band", "bucket").distinct()
    near = lambda d: F.abs(F.col("band") - F.col("_band")) <= d
    asked = pivots.select(F.col("cluster").alias("_c"), F.col("band").alias("_band"), "key", "tokens", "label")
    asked = asked.join(named, (F.col("_c") == F.col("cluster")) & near(1)).select(F.col("bucket").alias("task"), F.lit(1).alias("side"), "key", "tokens", "label")
    met = run(label(start).select(F.col("bucket").alias("task"), F.lit(0).alias("side"), "key", "tokens", "label").unionByName(asked), "pivots")
    edges = scratch.cut(edges.unionByName(met.where("pivot = 0").select("a", "b")), "most")
    labels = components(edges, checkpoint="jaccard-most").withColumnRenamed("node", "key")
    # Dealt anew: the main component of a cluster in buckets of its own; two of these need not meet.
    known = scratch.cut(label(full), "known")
    counts = known.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    known = dealt(known.join(main, "cluster").withColumn("rest", F.when(F.col("label") == F.col("main"), 0).otherwise(1)), ["cluster", "band", "rest"])
    named = known.select("cluster", "band", "rest", "bucket").distinct()
    other = named.select(F.col("cluster").alias("_c"), F.col("band").alias("_band"), F.col("rest").alias("_rest"), F.col("bucket").alias("_bucket"))
    tasks = named.join(other, (F.col("cluster") == F.col("_c")) & near(1) & (F.col("bucket") <= F.col("_bucket")) & (F.col("rest") + F.col("_rest") > 0))
    tasks = tasks.select(F.concat_ws("|", "bucket", "_bucket").alias("task"), "bucket", "_bucket")
    sides = tasks.select("task", F.lit(0).alias("side"), "bucket").unionByName(tasks.where("bucket <> _bucket").select("task", F.lit(1).alias("side"), F.col("_bucket").alias("bucket")))
    last = run(known.join(sides, "bucket").select("task", "side", "key", "tokens", "label"), "rest")
    return edges.unionByName(last.where("pivot = 0").select("a", "b"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that whose id is the component's.

    Of rows that repeat this id, the text with the smallest MD5 stays; rows that repeat id and text give one.
    Documents without a set and rows without an id stay as they are.
    """
    found = similar(docs, k, num, den, id_col, text_col).where("doc_id is not null and set_key is not null")
    digest = F.coalesce(F.md5(col(text_col).cast("string")), F.lit(""))
    mark = fresh(docs.columns, "_digest")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest")).alias("f"))
    # Each row of the first's is told by itself: its id is the component's.
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"))
    twins = found.where("doc_id = component_id").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d")).join(first.select(F.col("f.doc_id").alias("_f"), F.col("f.digest").alias("_fd")), F.col("_id") == F.col("_f")).where("_d <> _fd").select("_id", "_d")
    again = found.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id", "_d", F.lit("once").alias("_what"))
    gone = others.unionByName(twins).distinct().withColumn("_what", F.lit("gone"))
    # One decision a row that is not simply kept; "gone" comes before "once".
    decided = gone.unionByName(again).groupBy("_id", "_d").agg(F.min("_what").alias("_what"))
    rows = docs.withColumn(mark, digest).join(decided, (col(id_col) == F.col("_id")) & (col(mark) == F.col("_d")), "left").drop("_id", "_d")
    once = rows.where("_what = 'once'").dropDuplicates([id_col, mark])
    return rows.where("_what is null").unionByName(once).drop(mark, "_what")

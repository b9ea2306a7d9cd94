"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of a benchmark item's words.  A text is read from the end of a window of m words on, m
the least pattern length of a class: a shift table, looked up by the hash of the block of two words that ends
there, tells how many words can be skipped; at a shift of zero the hash of the window's last block (its suffix)
selects a bucket of patterns, which are tried by their first block and confirmed by direct comparison of
bytes.  All tables are numpy arrays, about 12 bytes a byte of benchmark text; many stretches of text are searched side by side.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, Scratch, as_bytes, chunks, col, fresh, mix64, trim

#: Least lengths of the classes into which patterns shorter than the window go, so that one short item
#: doesn't spoil the skips of the others.
CLASSES = (1, 2, 3, 6)
#: Benchmark text for which one search table is made and broadcast; blocks that are searched in one pass over the documents.
BLOCK_BYTES, PASS_BLOCKS = 4 << 20, 4
#: Words of a text that are searched as one stretch, beside others.
STRETCH = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


class Words:
    """Texts as one buffer of words joined by single spaces: where each word begins and ends, its hash, the block that ends at it, where each text's words begin."""

    def __init__(self, texts: list[bytes | None]):
        parts = [b" ".join(words_of(t)) for t in texts]
        self.data = b" ".join(x for x in parts if x)
        raw = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.start = np.concatenate([[0], gaps + 1]) if len(raw) else np.zeros(0, np.int64)
        self.end = np.concatenate([gaps, [len(raw)]]) if len(raw) else np.zeros(0, np.int64)
        self.texts = np.concatenate([[0], np.cumsum([x.count(b" ") + 1 if x else 0 for x in parts])])
        with np.errstate(over="ignore"):
            if len(raw):
                place = (np.arange(len(raw)) - np.repeat(self.start, np.diff(np.append(self.start, len(raw))))).astype(np.uint64)
                h = mix64((raw.astype(np.uint64) + np.uint64(1)) * _ODD + place)
                h[gaps] = 0
                self.hash = mix64(np.add.reduceat(h, self.start))
            else:
                self.hash = np.zeros(0, np.uint64)
            before = np.concatenate([[np.uint64(0)], self.hash[:-1]]) if len(self.hash) else self.hash
            self.block = mix64(before * _ODD + self.hash)

    def slice(self, at: int, n: int) -> bytes:
        """``n`` words from the one at ``at`` on, joined by spaces."""
        return self.data[self.start[at] : self.end[at + n - 1]]


class Table:
    """Shift table and suffix buckets of patterns: ``size`` words of ``own`` from those at ``first`` on, and the items of each."""

    def __init__(self, own: Words, first: np.ndarray, size: np.ndarray, items: list[list[int]]):
        self.m = int(size.min())
        self.b = b = min(2, self.m)
        self.keys = "hash" if b == 1 else "block"
        keys = getattr(own, self.keys)
        self.bits = max(8, int(4 * len(first)).bit_length())
        self.most = self.m - b + 1
        self.shift = np.full(1 << self.bits, self.most, np.uint16 if self.most < 65_536 else np.int64)
        for end in range(b, self.m + 1):  # falling shifts, so that the smallest of a slot stays
            self.shift[self.slot(keys[first + end - 1])] = self.m - end
        last = self.slot(keys[first + self.m - 1])
        order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.size, self.head = size[order].astype(np.int32), keys[first + b - 1][order]
        self.begin, self.stop, self.data = own.start[first][order], own.end[first + size - 1][order], own.data
        self.item_start = np.concatenate([[0], np.cumsum([len(items[i]) for i in order.tolist()])]).astype(np.int32)
        self.items = np.array([x for i in order.tolist() for x in items[i]], np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def ends(self, text: Words) -> np.ndarray:
        """Words at which the shift is zero, found by skipping, all stretches side by side."""
        slots = self.slot(getattr(text, self.keys))
        lo, hi = text.texts[:-1] + self.m - 1, text.texts[1:]
        count = np.maximum(0, -(-(hi - lo) // STRETCH))
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(lo, count) + place * STRETCH
        stop = np.minimum(at + STRETCH, np.repeat(hi, count))
        found = []
        while len(at):
            skip = self.shift[slots[at]].astype(np.int64)
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found)) if found else at

    def find(self, text: Words) -> Iterator[tuple[int, int, int]]:
        """(first word, words, pattern) of every occurrence."""
        ends = self.ends(text)
        slots = self.slot(getattr(text, self.keys)[ends])
        upto = np.repeat(text.texts[1:], np.diff(text.texts))  # of each word, where its text ends
        lo, n = self.bucket[slots].astype(np.int64), np.diff(self.bucket)[slots].astype(np.int64)
        for a in range(0, len(ends), 1 << 14):  # so that few of the pairs are there at once
            part = slice(a, a + (1 << 14))
            times = n[part]
            at = np.repeat(ends[part] - self.m + 1, times)
            p = np.repeat(lo[part] - np.cumsum(times) + times, times) + np.arange(times.sum())
            good = (getattr(text, self.keys)[at + self.b - 1] == self.head[p]) & (at + self.size[p] <= upto[at])
            for i, k in zip(at[good].tolist(), p[good].tolist(), strict=True):
                w = int(self.size[k])
                if text.slice(i, w) == self.data[self.begin[k] : self.stop[k]]:
                    yield i, w, k


class WuManber:
    """Search tables of the windows of items (number, text): runs of ``window`` words, or all words of a shorter item; none of one without words."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int):
        own = Words([t for _, t in items])
        place: dict[bytes, int] = {}
        first, size, found = [], [], []
        for (number, _), lo, hi in zip(items, own.texts[:-1].tolist(), own.texts[1:].tolist(), strict=True):
            n = min(window, hi - lo)
            for at in range(lo, hi - n + 1) if n else ():
                k = place.setdefault(hashlib.sha256(own.slice(at, n)).digest(), len(first))
                if k == len(first):
                    first.append(at)
                    size.append(n)
                    found.append([])
                if number not in found[k][-1:]:
                    found[k].append(number)
        first, size = np.array(first, np.int64), np.array(size, np.int64)
        edges = [*CLASSES, max([window, CLASSES[-1]]) + 1]
        self.tables = []
        for least, beyond in zip(edges, edges[1:], strict=False):
            at = np.flatnonzero((size >= least) & (size < beyond))
            if len(at):
                self.tables.append(Table(own, first[at], size[at], [sorted(set(found[i])) for i in at.tolist()]))

    def search(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int, list[int]]]]]:
        """(number of words of each text; of each text every occurrence: first word, number of words, items)."""
        words, out = Words(texts), [[] for _ in texts]
        for table in self.tables:
            for at, n, k in table.find(words):
                i = int(np.searchsorted(words.texts, at, side="right")) - 1
                out[i].append((at - int(words.texts[i]), n, table.items[table.item_start[k] : table.item_start[k + 1]].tolist()))
        return np.diff(words.texts), out


def covered(found: list[tuple[int, int, list[int]]]) -> list[list[int]]:
    """Merged [first word, end) stretches."""
    out: list[list[int]] = []
    for at, length, _ in sorted(found, key=lambda x: x[:2]):
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], at + length)
        else:
            out.append([at, at + length])
    return out


SEARCHED = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
_LONG, _TEXT = T.LongType(), T.StringType()
VERDICT = [("n_words", _LONG), ("n_hit", _LONG), ("n_items", _LONG), ("items_sha256", _TEXT), ("contaminated", T.BooleanType()), ("spans", T.ArrayType(T.ArrayType(_LONG))), ("items", T.ArrayType(_TEXT))]
JUDGED = pa.struct([SEARCHED[0], pa.field("n_hit", pa.int64()), pa.field("n_items", pa.int64()), pa.field("items_sha256", pa.string()), pa.field("contaminated", pa.bool_()), SEARCHED[1], SEARCHED[2]])


def verdict(n_words: int, spans: list[list[int]], items: list[str], ratio: int) -> dict:
    """From the number of words, merged hit stretches and the sorted ids of the items found."""
    hit = sum(b - a for a, b in spans)
    sha = hashlib.sha256(",".join(items).encode()).hexdigest()
    return {"n_words": n_words, "n_hit": hit, "n_items": len(items), "items_sha256": sha, "contaminated": hit > 0 and ratio * hit >= n_words, "spans": spans, "items": items}


def searcher(tables, ratio: int | None = None) -> Callable:
    """An Arrow function from texts to (number of words, hit stretches, item ids found), or with ``ratio`` to the verdict on that."""

    @F.arrow_udf("struct<n_words:bigint,spans:array<array<bigint>>,items:array<string>>" if ratio is None else T.StructType([T.StructField(*x) for x in VERDICT]))
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, table = tables.value
        for texts in batches:
            rows = []
            for part in chunks(texts, 1 << 20):
                for n, found in zip(*table.search(as_bytes(part)), strict=True):
                    spans, items = covered(found), sorted({ids[i] for x in found for i in x[2]})
                    rows.append({"n_words": int(n), "spans": spans, "items": items} if ratio is None else verdict(int(n), spans, items, ratio))
            yield pa.array(rows, SEARCHED if ratio is None else JUDGED)
        trim()

    return search


@F.arrow_udf(T.StructType([T.StructField(*x) for x in VERDICT]))
def judged(found: pa.Array, ratio: pa.Array) -> pa.Array:
    """The verdict from (number of words, hit stretches of any block, item ids)."""
    rows = [verdict(x["n_words"], covered([(a, b - a, []) for a, b in x["spans"] or []]), sorted(set(x["items"] or [])), r) for x, r in zip(found.to_pylist(), ratio.to_pylist(), strict=True)]
    return pa.array(rows, JUDGED)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    ratio: int = 20,
    block_bytes: int = BLOCK_BYTES,
    name: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct column ``name`` (under a name that clashes with none):

    n_words, n_hit (words inside an occurrence of a window), n_items (items with occurring windows),
    items_sha256 (of their ids, sorted as strings, comma-joined), contaminated (n_hit > 0 and
    ratio * n_hit >= n_words), spans ([first word, end) of the hit stretches), items (those ids).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window.  Items without an id or text are left out; rows that repeat an id are parts of one item.  A
    null, empty or wordless text has no hit.  Other columns, nulls and repeated rows pass through.

    Scale: one scan of the documents without a shuffle.  The benchmark is brought together in blocks of about
    ``block_bytes`` of text (an item longer than that is a block of its own), each broadcast as a
    search table; beyond PASS_BLOCKS blocks what is found so far is kept by a reliable checkpoint, and the documents are
    read from there for the next blocks, so that no worker holds more tables than that.
    """
    spark = docs.sparkSession
    rows = benchmark.select(col(item_col).cast("string").alias("i"), col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    n_blocks = max(1, -(-int(size) // block_bytes))
    name, raw = fresh(docs.columns, name), fresh(docs.columns, "_searched")
    out = docs
    for k in range(n_blocks):
        own = rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == k)
        items = [(r.i, r.t.encode("utf-8", "surrogatepass")) for r in own.collect()]
        ids = sorted({i for i, _ in items})
        number = {x: j for j, x in enumerate(ids)}
        table = WuManber([(number[i], t) for i, t in items], window)
        if n_blocks == 1:
            return docs.withColumn(name, searcher(spark.sparkContext.broadcast((ids, table)), ratio)(col(text_col)))
        found = searcher(spark.sparkContext.broadcast((ids, table)))(col(text_col))
        if k == 0:
            out = out.withColumn(raw, found)
        else:
            both = F.struct(F.col(f"{raw}.n_words"), F.concat(F.col(f"{raw}.spans"), F.col(f"{raw}2.spans")).alias("spans"), F.array_union(F.col(f"{raw}.items"), F.col(f"{raw}2.items")).alias("items"))
            out = out.withColumn(f"{raw}2", found).withColumn(raw, both).drop(f"{raw}2")
        if k % PASS_BLOCKS == PASS_BLOCKS - 1 and k < n_blocks - 1:
            out = Scratch(spark, "benchmark").keep(out)
    return out.withColumn(name, judged(F.col(raw), F.lit(ratio))).drop(raw)

"""What several operators of this package share: scratch tables, word rules, names, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, free_shuffles, shared_dir  # noqa: F401

#: Bytes outside ``[0-9A-Za-z]`` and non-ASCII become a space, A-Z become a-z: ``.split()`` then gives
#: the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text, on its UTF-8 bytes.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Only A-Z change; ``bytes.split()`` cuts at 0x20 and 0x09-0x0D, so it gives ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(taken: Iterable[str], stem: str) -> str:
    """A column name that starts with ``stem`` and clashes with none of ``taken``, whatever the case."""
    low = {c.lower() for c in taken}
    name, k = stem, 0
    while name.lower() in low:
        k += 1
        name = f"{stem}_{k}"
    return name


def col(name: str) -> Column:
    """The column of just this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(mod)


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text of an Arrow column."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        return texts.cast(pa.large_binary()).to_pylist()
    return texts.cast(pa.binary()).to_pylist()


def chunks(texts: pa.Array, most: int = 4 << 20) -> Iterable[pa.Array]:
    """Slices of a text column with about ``most`` bytes each, so that a batch of long texts is taken in parts."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield texts.slice(a, b - a)


def trim() -> None:
    """Give back memory that a finished task no longer needs: Python workers live on, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc keeps, and trims, what was freed
        ctypes.CDLL(None).malloc_trim(0)


_SQUASH = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    """Whether a UTF-8 text holds a Unicode letter."""
    if _SQUASH.search(text):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "ignore"))) if not text.isascii() else False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class KeyFilter:
    """A bitmap of ``keys``' hashes, of eight bits a key up to ``most_bytes``: what it doesn't hold is no key; some that it holds are none either."""

    def __init__(self, keys: DataFrame, key: Column, most_bytes: int = 16 << 20):
        n = keys.count()
        self.bits = 1 << min(int(most_bytes * 8).bit_length() - 1, max(10, int(8 * n).bit_length()))
        place = self.place(key)
        packed = keys.where(place.isNotNull()).select(F.bitmap_bucket_number(place + 1).alias("b"), F.bitmap_bit_position(place + 1).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
        self.found = keys.sparkSession.sparkContext.broadcast({r.b: bytes(r.m) for r in packed.collect()})

    def place(self, key: Column) -> Column:
        """The bit of a key; null for a null key."""
        return F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(self.bits)))

    def has(self, place: np.ndarray) -> np.ndarray:
        """Whether the bits at ``place`` are set; not at negative places."""
        return bits_at(self.found.value, place)

    def column(self, key: Column) -> Column:
        """Whether the filter holds a key; false for null."""
        held = self.found

        @F.arrow_udf("boolean")
        def has(place: pa.Array) -> pa.Array:
            return pa.array(bits_at(held.value, np.asarray(place.fill_null(-1))))

        return has(self.place(key))


def bits_at(table: dict[int, bytes], place: np.ndarray) -> np.ndarray:
    out = np.zeros(len(place), bool)
    bucket = place // 32_768 + 1
    for b in np.unique(bucket[place >= 0]).tolist():
        if b in table:
            own = np.flatnonzero((bucket == b) & (place >= 0))
            bit = place[own] % 32_768
            out[own] = ((np.frombuffer(table[b], np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
    return out

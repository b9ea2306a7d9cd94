"""URL filters: a Bloom filter cascade with exact answers over the corpus's complete key universe.

The first level holds the listed keys; the second those unlisted keys of the universe that the first
level lets through; the third those listed keys that the second lets through; and so on, until a level lets
nothing through.  The number of levels that a key passes tells, without error for keys of the
universe, whether it is listed.  Keys are dealt into shards by hash, each with a cascade of its own.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, col, fresh, mix64

#: Fixed values: (host, path, verdict); a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Domains of unwanted sites, with all their subdomains, for pages that no rule fits.
BLOCK_LIST = ("ads-track.example.com", "ads-track.example.org", "adult-x.example.com", "adult-x.example.org", "casino-win.example.com", "casino-win.example.org", "cheap-pills.example.com", "cheap-pills.example.org", "free-bets.example.com", "free-bets.example.org", "spam-farm.example.com", "spam-farm.example.org")
#: Keys of a shard, and bytes of cascades that are broadcast at once: each such group of shards answers its own rows.
SHARD_KEYS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bits a key and hash functions of the first level and of the later ones, which are of the keys that slipped through.
BITS, HASHES = (8, 2), (5, 1)


@dataclass
class Cascade:
    levels: list[tuple[np.ndarray, int, int]]  # bits, number of bits, hashes

    @staticmethod
    def places(h1: np.ndarray, h2: np.ndarray, level: int, size: int, hashes: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            salt = mix64(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
            a, b = mix64(h1 ^ salt), mix64(h2 + salt) | np.uint64(1)
            return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(size)

    @classmethod
    def build(cls, listed: tuple[np.ndarray, np.ndarray], rest: tuple[np.ndarray, np.ndarray]) -> "Cascade":
        """From the two 64-bit hashes of the listed and of all other keys; no pair of hashes may be in both."""
        out, inside, outside = cls([]), listed, rest
        while len(inside[0]):
            k = len(out.levels)
            bits, hashes = BITS[min(k, 1)], HASHES[min(k, 1)]
            size = max(64, len(inside[0]) * (bits + k // 8))  # a little more at each eighth level, so that it ends
            table = np.zeros(-(-size // 8) * 8, np.uint8)
            table[cls.places(*inside, k, size, hashes).ravel().astype(np.int64)] = 1
            out.levels.append((np.packbits(table, bitorder="little"), size, hashes))
            through = out.passes(outside, k)
            inside, outside = tuple(x[through] for x in outside), inside
        return out

    def passes(self, keys: tuple[np.ndarray, np.ndarray], level: int) -> np.ndarray:
        bits, size, hashes = self.levels[level]
        at = self.places(*keys, level, size, hashes)
        return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed: those that fail first at an even level, from 1, are."""
        depth, alive = np.zeros(len(h1), np.int64), np.arange(len(h1))
        for k in range(len(self.levels)):
            alive = alive[self.passes((h1[alive], h2[alive]), k)]
            depth[alive] = k + 1
        return depth % 2 == 1


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, the longer host before the longer path; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def key_hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of a key's MD5 as two longs."""
    h = F.md5(key)
    half = lambda a: F.conv(F.substring(h, a, 16), 16, -10).cast("long")
    return half(1), half(17)


def build_cascades(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, cascade) for each of ``shards`` from distinct keys as (h1, h2, listed)."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        hashes = lambda own: (own.h1.to_numpy().astype(np.uint64), own.h2.to_numpy().astype(np.uint64))
        cascade = Cascade.build(hashes(group[group.listed]), hashes(group[~group.listed]))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "cascade": [pickle.dumps(cascade)]})

    return keys.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(one, "shard long, cascade binary")


def member(rows: DataFrame, cascades: DataFrame, shards: int, h1: str, h2: str, name: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with a boolean ``name``: whether the key (h1, h2) is listed, by the cascade of its shard.

    Shards that stand together in ``broadcast_bytes`` (or one alone) are a group, whose cascades are broadcast; it answers the
    rows of its shards, so that any size is served alike, without a join or a shuffle: the rows are read once for each group.
    """
    spark = rows.sparkSession
    edges, held_bytes = [0], 0
    for r in sorted(cascades.select("shard", F.octet_length("cascade").alias("n")).collect(), key=lambda r: r.shard):
        if held_bytes and held_bytes + r.n > broadcast_bytes:
            edges.append(r.shard)
            held_bytes = 0
        held_bytes += r.n
    parts = []
    for lo, hi in zip(edges, [*edges[1:], shards], strict=True):
        own = cascades.where(F.col("shard").between(lo, hi - 1)) if len(edges) > 1 else cascades
        asked = rows.where(F.pmod(col(h1), F.lit(shards)).between(lo, hi - 1)) if len(edges) > 1 else rows
        parts.append(asked.withColumn(name, asker(spark.sparkContext.broadcast({r.shard: pickle.loads(r.cascade) for r in own.collect()}), shards)(col(h1), col(h2))))
    return reduce(DataFrame.unionByName, parts)


def asker(held, shards: int):
    """An Arrow function that tells whether keys are listed, by broadcast cascades of their shards."""

    @F.arrow_udf("boolean")
    def listed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            x, y = np.asarray(a).astype(np.int64), np.asarray(b).astype(np.int64)
            out, shard = np.zeros(len(x), bool), x % shards
            for s in np.unique(shard):
                if (c := held.value.get(int(s))) is not None:
                    own = shard == s
                    out[own] = c.listed(x[own].astype(np.uint64), y[own].astype(np.uint64))
            yield pa.array(out)

    return listed


def under(host: Column, domains) -> Column:
    """Whether a host is one of ``domains`` or a subdomain of one."""
    names = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    return F.arrays_overlap(parents, F.array(*map(F.lit, domains)))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, block_list=BLOCK_LIST, listed: DataFrame | None = None, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names give way).

    ``rule`` is the longest rule that fits, else null, and its verdict is the page's.  The verdict of a page that no rule
    fits comes from the cascade over all keys (host and path) of ``pages``: listed keys are blocked, all others allowed.
    Listed is a key whose host is a domain of ``block_list`` or of ``listed`` (a column ``domain``, of any size), or
    a subdomain of one.  A url that is null or has no ``://`` has an empty host and path, which no rule fits and no domain
    covers.  Nulls in other columns and in ``listed``, and repeated rows pass through; an empty table gives an empty result.

    Scale: keys are made distinct with partial aggregation, so a host with a third of all pages costs one row a
    task and key; shards hold about ``shard_keys`` keys whatever the input; cascades answer in groups of
    ``broadcast_bytes``, see ``member``.  Only distinct hosts are joined with ``listed``, when cascades are built.
    """
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    h1, h2, hit, rule = (fresh(pages.columns, x) for x in ("_url_h1", "_url_h2", "_url_listed", "_url_rule"))
    url = col(url_col).cast("string")
    rows = pages.withColumns({fresh(pages.columns, "_url_host"): url_host(url), fresh(pages.columns, "_url_path"): url_path(url)})
    host, path = rows.columns[-2:]
    a, b = key_hashes(F.concat(F.col(host), F.lit("\n"), F.col(path)))
    rows = rows.withColumns({h1: a, h2: b, rule: fitting_rule(F.col(host), F.col(path), rules)})
    with Scratch(pages.sparkSession, "urls") as scratch:
        keys = rows.groupBy(F.col(h1).alias("h1"), F.col(h2).alias("h2")).agg(F.first(host).alias("host"))
        named = under(F.col("host"), block_list) if block_list else F.lit(False)
        if listed is not None:
            names = F.split("host", r"\.")
            parents = rows.select(F.col(host).alias("host")).distinct().select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))).alias("_parent"))
            hosts = parents.join(listed.select(F.col("domain").alias("_parent")).distinct(), "_parent", "left_semi").select(F.col("host").alias("_host")).distinct().withColumn("_named", F.lit(True))
            keys = keys.join(hosts, F.col("host") == F.col("_host"), "left")
            named = named | F.coalesce(F.col("_named"), F.lit(False))
        keys = scratch.cut(keys.select("h1", "h2", named.alias("listed")), "keys")
        shards = max(1, -(-keys.count() // shard_keys))
        cascades = scratch.keep(build_cascades(keys, shards))
    rows = member(rows, cascades, shards, h1, h2, hit, broadcast_bytes)
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col(hit), "block").otherwise("allow"))
    return rows.select(*[col(c) for c in keep], F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{rule}.rule").alias("rule"), verdict.alias("verdict"))

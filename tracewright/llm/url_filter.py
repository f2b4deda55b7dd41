"""URL rules and lists behind Bloom filter cascades.

The keys of a URL are its host and each parent domain, alone and followed by the
path's prefixes of the lengths that occur in rules.  There is a cascade for each list:
rules that allow, rules that block, blocked hosts.  Its first filter encodes the listed
keys, the second the keys of the corpus that the first lets through wrongly, the third
the listed keys that the second lets through, and so on until none are left.  Over the
corpus's complete key universe the answers are then exact, without a join, and a rule is
the key that its cascade holds.  One pass over the URLs counts the keys, roughly, and sets
the first filters' error rates so that about as many wrong keys as listed ones come
through; a second pass finds these, and later levels are made of the two sets alone.  Only
the filters, a few dozen bits for each listed key, travel to the executors.

Null URLs and URLs without ``://`` have an empty host and path, and no key.  Repeated rows
get equal answers; an empty table has an empty result; long URLs have as many keys as their
hosts have labels, times the prefix lengths.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PARTS = re.compile(r"([^/?#]*)([^?#]*)")
LATER_RATE = 0.5


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host, path = PARTS.match(url, at + 3).groups()
    return host.translate(LOWER), path


class Bloom:
    def __init__(self, keys: Iterable[str], n: int, rate: float, seed: int):
        self.seed = seed
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        data = np.zeros(self.bits // 8 + 1, dtype=np.uint8)
        for key in keys:
            for i in self.places(key):
                data[i >> 3] |= 1 << (i & 7)
        self.data = data.tobytes()

    def places(self, key: str) -> Iterator[int]:
        both = xxhash.xxh3_128_intdigest(key, self.seed)
        a, b = both >> 64, (both & (1 << 64) - 1) | 1
        return ((a + i * b) % self.bits for i in range(self.hashes))

    def __contains__(self, key: str) -> bool:
        data = self.data
        return all(data[i >> 3] >> (i & 7) & 1 for i in self.places(key))


class Cascade:
    """Alternating filters; exact for listed keys and for all others of the universe they were built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1

    @classmethod
    def grown(cls, first: Bloom, listed: Iterable[str], wrong: Iterable[str]) -> Cascade:
        """wrong: the keys of the universe that aren't listed and that the first level lets through."""
        levels, theirs, others = [first], set(wrong), set(listed)
        while theirs:
            level = Bloom(theirs, len(theirs), LATER_RATE, seed=len(levels))
            levels.append(level)
            theirs, others = {k for k in others if k in level}, theirs
        return cls(levels)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def keys_of(host: str, path: str, lengths: tuple[int, ...]) -> Iterator[str]:
    """The longest first."""
    while host:
        for n in lengths:
            if n <= len(path):
                yield host + path[:n]
        host = host.partition(".")[2]


def build(urls: DataFrame, lists: Mapping[str, Iterable[str]], lengths: tuple[int, ...], url: str = "url") -> dict[str, Cascade]:
    """A cascade for each list, exact over all keys of a table of URLs."""
    lists = {name: frozenset(keys) for name, keys in lists.items()}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for u in batch.column(0).to_pylist() for k in keys_of(*split_url(u), lengths)}
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(k) >> 1 for k in found], pa.int64())], names=["key"])

    n = urls.select(F.col(url)).mapInArrow(keys, "key long").select(F.approx_count_distinct("key")).first()[0]
    first = {name: Bloom(own, len(own), min(LATER_RATE, max(len(own), 1) / max(1, n)), seed=0) if own else None for name, own in lists.items()}

    def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(name, k) for u in batch.column(0).to_pylist() for k in keys_of(*split_url(u), lengths) for name, f in first.items() if f is not None and k in f and k not in lists[name]}
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in (0, 1)], names=["list", "key"])

    found = urls.select(F.col(url)).mapInArrow(wrong, "list string, key string").distinct().collect()  # about as many as there are listed keys, by the rate
    return {name: Cascade([]) if f is None else Cascade.grown(f, lists[name], [r["key"] for r in found if r["list"] == name]) for name, f in first.items()}


def judge(pages: DataFrame, rules: Iterable[Rule], blocked_hosts: Iterable[str], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed of each row.

    The longest fitting rule gives the verdict.  Without one, a host that is in
    ``blocked_hosts``, or below one that is, is blocked and all else allowed;
    ``listed`` is that host, else null.
    """
    rules = list(rules)
    lengths = tuple(sorted({len(r.path) for r in rules} | {0}, reverse=True))
    lists = {verdict: [r.key for r in rules if r.verdict == verdict] for verdict in ("allow", "block")}
    cascades = build(pages, {**lists, "hosts": blocked_hosts}, lengths, url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for u in batch.column(1).to_pylist():
                host, path = split_url(u)
                rule, verdict, listed = None, None, None
                for k in keys_of(host, path, lengths):
                    if rule is None or len(k) > len(rule):
                        own = next((v for v in lists if k in cascades[v]), None)
                        if own is not None:
                            rule, verdict = k, own
                    if listed is None and k in cascades["hosts"]:
                        listed = k
                if verdict is None:
                    verdict = "allow" if listed is None else "block"
                for column, value in zip(out, (host, path, rule, verdict, listed), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in out)], names=["page_id", "host", "path", "rule", "verdict", "listed"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(page_id, url).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, listed string")

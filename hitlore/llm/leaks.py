"""Documents that contain passages of evaluation items, by size-partitioned MinHash containment search.

A passage is `run` consecutive words of an item, or all of an item with fewer words. A document that contains one has a window
of as many words all of whose shingles are shingles of the item: the containment of the window in the item is 1. Their
resemblance is only as high as the item is short, q / u for a window of q shingles and an item of at most u. So items are
partitioned by the size of their shingle sets, with upper bounds that double, and each partition takes as many hash functions
as that resemblance needs for a window to be missed no more often than `miss`. Each hash function is a band of its own, because
the resemblance is low.

Where a window lies within an item, the two have the same minimum under a hash function exactly if the window holds the item's
minimal shingle. So documents are searched for the minimal shingles of items, and no window without one has to be signed.
A candidate is kept if it stands in a window all of whose shingles are shingles of items, and carries the words around it on
both sides, which verify the containment in one item shingle for shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlore.llm.plain import word_runs, words
from hitlore.session import cut

RUN, SHINGLE = 12, 5
#: The chance of a window to be missed.
MISS = 1e-5
#: The filter of minimal shingles has this many bits for each of them, and at most this many bytes; a fuller filter lets more
#: shingles pass to the join, which decides.
BITS_A_KEY, FILTER_BYTES = 64, 32_000_000
#: Documents whose words are looked at together.
AT_ONCE = 256
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def hashes_of(flat: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, flat), np.uint64, len(flat))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A number for each `size` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size) * _MIX[0])
        for i in range(size):
            out = (out ^ hashes[i : i + n]) * _PRIME
            out ^= out >> np.uint64(29)
    return out


def keys_of(numbers: np.ndarray, passage: int) -> np.ndarray:
    """Keys of shingles: items of another passage size have other keys for the same shingle."""
    return _hashed(numbers, passage << 20)


def _hashed(values: np.ndarray, function: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = values + np.uint64(function + 1) * _PRIME
        z = (z ^ (z >> np.uint64(30))) * _MIX[0]
        z = (z ^ (z >> np.uint64(27))) * _MIX[1]
        return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class Partition:
    """Items with passages of `words` words whose sets have at most `bound` shingles; a window has at least `window` distinct ones."""

    words: int
    window: int
    bound: int

    @property
    def resemblance(self) -> float:
        return self.window / self.bound

    def functions(self, miss: float = MISS) -> int:
        """Hash functions for a window of that resemblance to have a minimum in common but for a chance of `miss`."""
        return 1 if self.resemblance >= 1 else math.ceil(math.log(miss) / math.log1p(-self.resemblance))


def partition_of(numbers: np.ndarray, passage: int) -> Partition:
    """The partition of an item by its shingles in their order. A window of a passage with repetitions has fewer distinct ones."""
    q = passage - min(SHINGLE, passage) + 1
    least = min(len(np.unique(numbers[i : i + q])) for i in range(len(numbers) - q + 1))
    size, bound = len(np.unique(numbers)), least
    while bound < size:
        bound *= 2
    return Partition(passage, least, bound)


def signature(numbers: np.ndarray, functions: int) -> np.ndarray:
    """The minimal shingles of a set, one of each hash function, without repetitions."""
    distinct = np.unique(numbers)
    return np.unique([distinct[_hashed(distinct, f).argmin()] for f in range(functions)])


def _context(flat: list[str], at: int, size: int, first: int, beyond: int, run: int) -> tuple[str, str, str]:
    """The words before a shingle, of it and after it, as far as a passage can reach."""
    reach = run - size
    return " ".join(flat[max(first, at - reach) : at]), " ".join(flat[at : at + size]), " ".join(flat[at + size : min(beyond, at + size + reach)])


_SIDES = ("before string", "shingle string", "after string")
_SIDE_NAMES = ("before", "shingle", "after")


def item_signatures(items: DataFrame, *, run: int = RUN, miss: float = MISS) -> DataFrame:
    """key, minimal, item_id, words, before, shingle, after: the shingles of each item at each place where they stand in it. Minimal ones
    have the words around them."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = words(text)
                passage = min(run, len(flat))
                if not passage:
                    continue
                size = min(SHINGLE, passage)
                numbers = shingles(hashes_of(flat), size)
                keys = keys_of(numbers, passage).view(np.int64)
                minimal = np.isin(numbers, signature(numbers, partition_of(numbers, passage).functions(miss)))
                for at, (key, chosen) in enumerate(zip(keys.tolist(), minimal.tolist(), strict=True)):
                    around = _context(flat, at, size, 0, len(flat), run) if chosen else (None, None, None)
                    rows.append((key, chosen, item, passage, *around))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), *([pa.string()] * 3))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "minimal", "item_id", "words", *_SIDE_NAMES])

    own = items.select("item_id", "text").where(F.col("text").isNotNull())
    return own.mapInArrow(sign, ", ".join(["key long, minimal boolean, item_id long, words int", *_SIDES]))


class Filter:
    """Which keys may be among those of the items: two bits of a table for each. A key that is among them always passes."""

    def __init__(self, bits: int):
        self.bits = bits
        self.table = np.zeros(max(bits // 64, 1), np.uint64)

    @classmethod
    def of(cls, keys: DataFrame, count: int, most_bytes: int = FILTER_BYTES) -> Filter:
        """The words of the table are put together by the executors; there are at most most_bytes / 8 of them."""
        bits = 1 << min(max(10, math.ceil(math.log2(max(count, 1) * BITS_A_KEY))), int(math.log2(most_bytes * 8)))
        out = cls(bits)
        places = F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 33)))
        placed = keys.select("key").distinct().select(F.explode(places).alias("place"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
        table = placed.select(F.shiftrightunsigned("place", 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
        out.table[table.column("at").to_numpy()] = table.column("word").to_numpy().view(np.uint64)
        return out

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for shift in (0, 33):
            place = (keys >> np.uint64(shift)) & np.uint64(self.bits - 1)
            hit &= (self.table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return hit


def _found_shingles(ids: list, texts: list, passages: list[int], every: Filter, minimal: Filter, run: int) -> Iterator[tuple]:
    """(key, document, before, shingle, after) for each shingle of the documents that may be a minimal one in a window of shingles of items."""
    flat, owner, ends = [], [], []
    for at, text in enumerate(texts):
        for words_ in word_runs(text):
            flat += words_
            owner.append(at)
            ends.append(len(flat))
    if not flat:
        return
    hashes, limits = hashes_of(flat), np.array(ends)
    begins = np.concatenate([[0], limits[:-1]])
    by_size: dict[int, np.ndarray] = {}
    for passage in passages:
        size = min(SHINGLE, passage)
        if size not in by_size:
            by_size[size] = shingles(hashes, size)
        keys = keys_of(by_size[size], passage)
        at = np.flatnonzero(minimal.may_have(keys))
        of = np.searchsorted(limits, at, side="right")
        # The shingles before and after one that a window with it can hold, as far as its run of words goes.
        q = passage - size + 1
        around = at[:, None] + np.arange(1 - q, q)[None, :]
        inside = (around >= begins[of][:, None]) & (around + size <= limits[of][:, None])
        held = np.zeros(around.shape, bool)
        held[inside] = every.may_have(keys[around[inside]])
        whole = np.lib.stride_tricks.sliding_window_view(held, q, axis=1).all(axis=2).any(axis=1) if len(at) else np.zeros(0, bool)
        for p, r in zip(at[whole].tolist(), of[whole].tolist(), strict=True):
            yield int(keys[p].view(np.int64)), ids[owner[r]], *_context(flat, p, size, int(begins[r]), ends[r], run)


def document_shingles(documents: DataFrame, passages: list[int], every: Filter, minimal: Filter, *, run: int = RUN) -> DataFrame:
    """key, doc_id, before, shingle, after of the shingles of all documents that may be minimal shingles of items in a passage."""
    shared = documents.sparkSession.sparkContext.broadcast((every, minimal))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                rows = list(_found_shingles(part.column(0).to_pylist(), part.column(1).to_pylist(), passages, *shared.value, run))
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), *([pa.string()] * 3)))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", *_SIDE_NAMES])

    own = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    return own.mapInArrow(search, ", ".join(["key long, doc_id long", *_SIDES]))


def _contained(passage: int, own: tuple[str, str, str], other: tuple[str, str, str]) -> bool:
    """Whether the words around an equal shingle agree over a whole passage."""
    if own[1] != other[1]:
        return False
    n = len(own[1].split(" "))
    for a, b in ((own[0].split()[::-1], other[0].split()[::-1]), (own[2].split(), other[2].split())):
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
    return n >= passage


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        sides = [zip(*(column[f"{s}_{n}"] for n in _SIDE_NAMES), strict=True) for s in ("d", "i")]
        found = {
            (d, i) for d, i, w, a, b in zip(column["doc_id"], column["item_id"], column["words"], *sides, strict=True) if _contained(w, a, b)
        }
        pairs = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["doc_id", "item_id"])


def leaks(documents: DataFrame, items: DataFrame, *, run: int = RUN, miss: float = MISS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, item_id: each document once with each item of which it contains a passage.

    documents has doc_id and text, items has item_id and text. Whole texts are searched, and what stands inside templates,
    references and comments is searched by itself.

    The shingles of the items are written once. Filters of their keys, of at most filter_bytes each, go to the executors; what
    passes them in the documents, a shingle with the words around it, is joined to the signatures by key and verified. This is the
    way for any number of items; a shingle that stands in very many documents is split by the join's skew handling.

    Defined cases: empty, blank and NULL texts contain nothing and items without words are contained nowhere; items that
    share a passage are each reported; repeated documents or items give a pair once; further columns are ignored; empty
    tables give no rows.
    """
    signatures = cut(item_signatures(items, run=run, miss=miss))
    minimal = signatures.where("minimal")
    # At most `run` sizes.
    counts = {r["words"]: (r.n, r.m) for r in signatures.groupBy("words").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("minimal"), 1)).alias("m")).collect()}
    filters = [Filter.of(keys, sum(c[i] for c in counts.values()), filter_bytes) for i, keys in enumerate((signatures, minimal))]
    hits = document_shingles(documents, sorted(counts), *filters, run=run)
    own = hits.select("key", "doc_id", *(F.col(n).alias(f"d_{n}") for n in _SIDE_NAMES))
    candidates = own.join(minimal.select("key", "item_id", "words", *(F.col(n).alias(f"i_{n}") for n in _SIDE_NAMES)), "key").drop("key")
    return candidates.mapInArrow(_verify, "doc_id long, item_id long").distinct()

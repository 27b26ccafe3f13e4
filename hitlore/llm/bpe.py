"""Byte-level BPE of whole corpora.

Splitting a text into pieces is a JVM expression; the merges of the distinct pieces run in Arrow batches, many pieces at a
time. Each piece has a segment tree over its byte positions whose node holds the leftmost minimum of the ranks of the live
pairs below it. The root names the next merge; a merge joins a position with its live right neighbour and updates the at most
three leaves it touches, in logarithmically many nodes each. Pieces of about the same length are rows of one array, so one
step merges once in every piece that has a merge left. In a long piece a step merges all places of the lowest rank at once,
which are found by going down the tree: a pair with a token that a merge has made has a higher rank than that merge.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The public split pattern of byte_bpe_50k with Unicode white space spelled out for the JVM.
_W = r"\p{IsWhite_Space}"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|{_W}+(?![^{_W}])|{_W}+"
#: Pieces in the memory of a worker, pieces encoded at once, bytes of a tree array at once.
KEPT, AT_ONCE, TREE_CELLS = 300_000, 200_000, 4_000_000
#: Pieces from this width on are encoded one by one.
LONG = 2048
_NONE = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


@dataclass(frozen=True)
class Merges:
    """Ids of the 256 bytes; the pairs (left << 32 | right) in ascending order with their ranks; the id each rank makes."""

    byte_ids: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    made: np.ndarray

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Merges:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        parts = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in parts], np.int64)
        made = np.array([ids[a + b] for a, b in parts], np.int32)
        order = np.argsort(pairs, kind="stable")
        return cls(np.array([ids[c] for c in byte_characters()], np.int32), pairs[order], order.astype(np.int64), made)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE for one that has none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)


def _encode_rows(pieces: list[bytes], width: int, merges: Merges) -> list[np.ndarray]:
    """Token ids of pieces of at most `width` bytes, width a power of two."""
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    filled = np.arange(width)[None, :] < lengths[:, None]
    ids = np.zeros((n, width + 1), np.int32)
    ids[:, :width][filled] = merges.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    # Live neighbours; width stands for none on the right, and its column is never read as a token.
    after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
    after[np.arange(n), lengths - 1] = width
    before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
    alive = filled.copy()
    # Leaf = rank * width + position, so a minimum is the leftmost of the lowest rank.
    tree = np.full((n, 2 * width), _NONE)
    paired = filled[:, 1:]
    ranks = np.full((n, width), _NONE)
    ranks[:, :-1][paired] = merges.rank(ids[:, : width - 1][paired], ids[:, 1:width][paired])
    has = ranks != _NONE
    tree[:, width:][has] = (ranks * width + np.arange(width)[None, :])[has] if has.any() else _NONE
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

    def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = value
        while width > 1 and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        right = after[rows, at]
        rank = merges.rank(ids[rows, at], ids[rows, right])
        return np.where((right < width) & (rank != _NONE), np.where(rank != _NONE, rank, 0) * width + at, _NONE)

    rows = np.flatnonzero(tree[:, 1] != _NONE) if width > 1 else np.empty(0, np.int64)
    while len(rows):
        best = tree[rows, 1]
        at, rank = best % width, best // width
        right = after[rows, at]
        ids[rows, at] = merges.made[rank]
        beyond = after[rows, right]
        after[rows, at] = beyond
        before[rows, beyond] = at
        alive[rows, right] = False
        update(rows, right, np.full(len(rows), _NONE))
        update(rows, at, leaf(rows, at))
        left = before[rows, at]
        some = left >= 0
        if some.any():
            update(rows[some], left[some], leaf(rows[some], left[some]))
        rows = rows[tree[rows, 1] != _NONE]
    counts = alive.sum(1)
    flat = ids[:, :width][alive]
    return np.split(flat, np.cumsum(counts)[:-1])


def _encode_long(piece: bytes, width: int, merges: Merges) -> np.ndarray:
    """Token ids of one piece of at most `width` bytes, width a power of two."""
    n = len(piece)
    ids = np.zeros(width + 1, np.int32)
    ids[:n] = merges.byte_ids[np.frombuffer(piece, np.uint8)]
    after, before, alive = np.arange(1, width + 2), np.arange(-1, width), np.zeros(width, bool)
    after[n - 1], alive[:n] = width, True

    def leaf(at: np.ndarray) -> np.ndarray:
        right = after[at]
        rank = merges.rank(ids[at], ids[right])
        return np.where((right < width) & (rank != _NONE), np.where(rank != _NONE, rank, 0) * width + at, _NONE)

    tree = np.full(2 * width, _NONE)
    tree[width : width + n] = leaf(np.arange(n))
    level = width
    while level > 1:
        tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level //= 2
    while tree[1] != _NONE:
        rank = tree[1] // width
        nodes = np.ones(1, np.int64)
        while nodes[0] < width:
            below = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel()
            nodes = below[tree[below] // width == rank]
        at = nodes - width
        # Places that share a token: every second of a row of them, from the left.
        linked = np.concatenate([[False], after[at[:-1]] == at[1:]])
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0]
        right = after[at]
        beyond = after[right]
        ids[at], after[at], before[beyond], alive[right] = merges.made[rank], beyond, at, False
        left = before[at]
        changed = np.unique(np.concatenate([at, left[left >= 0]]))
        tree[right + width], tree[changed + width] = _NONE, leaf(changed)
        nodes = np.unique(np.concatenate([right, changed]) + width)
        while nodes[0] > 1:
            nodes = np.unique(nodes >> 1)
            tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
    return ids[:width][alive]


def encode_pieces(pieces: list[bytes], merges: Merges) -> list[np.ndarray]:
    """Token ids of each piece. No piece is empty."""
    out: list[np.ndarray] = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        classes.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
    for width, members in classes.items():
        if width >= LONG:
            for i in members:
                out[i] = _encode_long(pieces[i], width, merges)
            continue
        step = max(1, TREE_CELLS // width)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            for i, ids in zip(some, _encode_rows([pieces[i] for i in some], width, merges), strict=True):
                out[i] = ids
    return out


class Encoder:
    """Encodes arrays of pieces and remembers the ids of pieces it has met, at most about KEPT of them."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def number(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece in what is remembered."""
        if len(self.known) > KEPT:
            self.forget()
        new = [p for p in pieces if p not in self.known]
        if new:
            encoded = encode_pieces([p.encode("utf-8") for p in new], self.merges)
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            ends = self.starts[-1] + np.cumsum([len(e) for e in encoded])
            self.starts = np.concatenate([self.starts, ends])
            self.flat = np.concatenate([self.flat, *encoded])
        return np.fromiter((self.known[p] for p in pieces), np.int64, len(pieces))

    def encode(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, and the number of ids of each piece."""
        coded = pieces.dictionary_encode()
        place = self.number(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.starts[place + 1] - self.starts[place]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[place] - (ends - counts), counts) + np.arange(total)], counts


_ENCODERS: dict[int, Encoder] = {}


def pieces_of(text: Column) -> Column:
    """The pieces a text is split into; none for an empty or NULL text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPLIT), F.lit(0))


def encode(texts: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", keep: Sequence[str] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """id, the columns of keep, and ids: the token ids of every text, without special tokens. No row moves; a text is split and encoded whole.

    The merges are read on the driver from the file at `vocabulary` and sent to the executors (under 2 MB, fixed by the
    vocabulary). Special tokens' strings are ordinary text.

    Defined cases: an empty and a NULL text have the empty list; a NULL id is kept; repeated rows give repeated rows; other
    columns are ignored; an empty table gives no rows.
    """
    shared = texts.sparkSession.sparkContext.broadcast(Merges.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = shared.value
        encoder = _ENCODERS.get(id(merges))
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[id(merges)] = Encoder(merges)
        for batch in batches:
            lists = batch.column(1)
            starts = np.asarray(lists.offsets.to_numpy(), np.int64)
            pieces = lists.values
            parts, counts = [], []
            for at in range(int(starts[0]), int(starts[-1]), AT_ONCE):
                ids, n = encoder.encode(pieces.slice(at, min(AT_ONCE, int(starts[-1]) - at)))
                parts.append(ids)
                counts.append(n)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else np.empty(0, np.int64))])
            offsets = ends[starts - starts[0]]
            values = np.concatenate(parts) if parts else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            kept = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, ids], names=[id_column, *keep, "ids"])

    kinds = [f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in (id_column, *keep)]
    return texts.select(id_column, pieces_of(F.col(text_column)).alias("pieces"), *keep).mapInArrow(run, ", ".join([*kinds, "ids array<int>"]))


def decoder(vocabulary: str = VOCABULARY):
    """A function from ids to bytes, for round trips."""
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {c: b for b, c in enumerate(byte_characters())}
    words = {i: bytes(back[c] for c in w) for w, i in model["vocab"].items() if all(c in back for c in w)}
    return lambda ids: b"".join(words[i] for i in ids)

"""Severity of abusive, hateful or sexual passages by cumulative-link ordinal regression.

A document is as severe as its most severe passage. A passage is a window of words; its features are its words, its pairs of
neighbouring words and pairs with one word between, after disguises are taken off: other scripts' letters, digits for
letters, stretched letters, letters set apart, signs and invisible characters inside words, stars for letters. One weight per
feature is shared by the ordered thresholds: P(grade >= k) = logistic(score - threshold_k), and the weights maximise the
likelihood of the grades, P(grade = k) = P(grade >= k) - P(grade >= k + 1). The expected severity is the sum of P(grade >= k).

The regression is fitted on rated documents: grade 0 if no rater found harm, 2 if all did, 1 if they disagree. Ratings are of
whole documents, so fitting alternates between choosing the window of each document and fitting the weights to the windows.
No list of words is given: which words a star can stand for, and which words count as marked in pairs, is read from the ratings.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlore.session import cut

#: At most so many rated documents, of at most so many characters, are used for fitting; scoring has no bounds.
MOST_RATED, MOST_CHARS = 10_000, 100_000
WINDOWS = (4, 6, 9, 12)
GRADES = 3
#: What stands between runs of words.
GAP = -1
ROUNDS, STEPS = 4, 150
#: A document of grade 0 is left out above the second severity, another one below the first.
TRUSTED = (0.5, 1.5)
#: Scale, first threshold and distance to the second that calibration starts from.
USUAL = (0.5, 3.0, 0.5)
#: Words of a piece of a document without harm; documents that the odds of a word are drawn to even by.
PIECE, CAUTION = 40, 12
#: A word is marked if it stands in so many documents of the highest grade and its odds of harm are so many times those of any word.
MARKED_DOCS, MARKED_ODDS = 3, 1.2
#: Penalties of the weights, of which the one is taken that suits held-out ratings; windows a feature must stand in; how much more than single words pairs are drawn to zero.
PENALTIES, SUPPORT, PAIR_PENALTY = (0.8,), 2, 4
AT_ONCE = 256
#: Chunks of text a worker remembers.
CHUNKS_KEPT = 300_000

_INSIDE = "*.\\-'’­​‌‍⁠﻿$@"
#: Stars stand for any number of letters, at the end of a word too.
TOKEN = re.compile(rf"\w+(?:(?:[{_INSIDE}]{{1,3}}|\*+)\w+)*\**")
#: Single letters set apart: p a t h e t i c. The first pattern, which the end of the second matches, only says whether that is worth trying.
MAYBE_APART = re.compile(r" \w \w(?!\w)")
APART = re.compile(r"(?<!\w)[^\W\d_](?: [^\W\d_]){2,}(?!\w)")
_DOUBLED = re.compile(r"(.)\1+")
_EDGES = "'\".,;:!?()[]{}|=*<>«»„“”–—"
_ENDS = _EDGES.replace("*", "")
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKE = str.maketrans("аеорсхуіјѕһԁԛԝкмтнвгαορνικτυηɡıаε", "aeopcxyijshdqwkmthbraopviktungiae")
LEET = str.maketrans("0134578@$", "oieastbas")


def canonical(raw: str) -> str:
    """A token without disguise; stars stay, because only a vocabulary can say what they stand for."""
    text = raw.lower()
    if text.isascii() and text.isalpha():
        return _DOUBLED.sub(r"\1", text) if len(text) > 3 else text
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(LOOKALIKE)) if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
        text = text.lower().translate(LOOKALIKE).replace("ß", "ss").replace("’", "").replace("œ", "oe")
    text = re.sub(r"[._\-']", "", text)
    letters = sum(c.isalpha() for c in text)
    if letters == 0:
        return "#"
    if letters < len(text):
        text = text.translate(LEET)
    if len(text) > 3:
        text = re.sub(r"(.)\1+", r"\1", text) if "*" not in text else re.sub(r"([^*])\1+", r"\1", text)
    return text


def _together(apart: re.Match) -> str:
    word = apart[0].replace(" ", "")
    return f"{word} {word[1:]}" if len(word) > 3 else f"{apart[0]} {word}"


def chunks(text: str | None) -> list[str]:
    """What stands between white space; letters set apart come as one chunk, and once more without the first.

    The first letter may be a word of its own ("a p a t h e t i c ..."). Three letters may be initials: they stay, and come
    as one chunk after that.
    """
    if not text:
        return []
    if MAYBE_APART.search(text):
        text = APART.sub(_together, text)
    return text.split()


def tokens(text: str | None) -> list[str]:
    """Tokens as written."""
    return [t for c in chunks(text) for t in TOKEN.findall(c)]


def hash_of(word: str) -> int:
    """A positive number for a canonical word."""
    return xxhash.xxh64_intdigest(word) >> 1 or 1


@dataclass
class Stars:
    """Words that words with stars can stand for."""

    words: list[str] = field(default_factory=list)
    _known: dict[str, str] = field(default_factory=dict, repr=False)

    def resolve(self, word: str) -> str:
        """The word that a word with stars stands for, if there is one: a star is one letter or more, at the end just one."""
        known = self._known.get(word)
        if known is None:
            pattern = re.compile("".join("[a-z]+" if part.startswith("*") else re.escape(part) for part in re.findall(r"\*+|[^*]+", word)))
            # At the end a star may be a sign of its own (A*): there the length must be right.
            apart = 0 if word.endswith("*") else 1
            fits = [w for w in self.words if abs(len(w) - len(word)) <= apart and pattern.fullmatch(w)]
            known = min(fits, key=lambda w: (abs(len(w) - len(word)), w)) if fits else word.replace("*", "")
            if len(self._known) > CHUNKS_KEPT:
                self._known.clear()
            self._known[word] = known
        return known

    def read(self, token: str) -> str:
        word = canonical(token)
        return self.resolve(word) if "*" in word else word


@dataclass
class Vocabulary:
    """Numbers of the hashes of canonical words, from 2 on; 0 for all others. 1 stands for any marked word in pairs."""

    ids: dict[int, int]
    stars: Stars = field(default_factory=Stars)
    _raw: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    @classmethod
    def of_words(cls, words: Mapping[str, int], starred: Sequence[str] = ()) -> Vocabulary:
        return cls({hash_of(w): i for w, i in words.items()}, Stars(list(starred)))

    def __getstate__(self):
        return {"ids": self.ids, "stars": Stars(self.stars.words), "_raw": {}}

    def of_chunk(self, chunk: str) -> tuple[int, ...]:
        """The numbers of the tokens of a chunk."""
        bare = chunk.lstrip(_EDGES).rstrip(_ENDS).lower()
        if bare.isascii() and bare.isalpha():
            return (self.ids.get(hash_of(_DOUBLED.sub(r"\1", bare) if len(bare) > 3 else bare), 0),)
        if bare.isdigit():
            return (self.ids.get(hash_of("#"), 0),)
        return tuple(self.ids.get(hash_of(self.stars.read(t)), 0) for t in TOKEN.findall(chunk))

    def numbers(self, text: str | None) -> np.ndarray:
        raw, out = self._raw, []
        for chunk in chunks(text):
            known = raw.get(chunk)
            if known is None:
                if len(raw) > CHUNKS_KEPT:
                    raw.clear()
                known = raw[chunk] = self.of_chunk(chunk)
            out += known
        return np.array(out, np.int64)


def _keys(ids: np.ndarray, marked: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(feature keys, position of the last word, first word's distance) of one run of words; key 0 is no feature.

    Kinds: word, pair, pair with one between, and pairs in which a marked word is just a marked word.
    """
    where, ids = np.arange(len(ids)), np.maximum(ids, 0)
    out = [(ids, where, 0)]
    general = np.where(marked[ids], 1, ids)
    for kind, (a, d) in enumerate(((ids, 1), (ids, 2), (general, 1), (general, 2)), start=1):
        if len(ids) <= d:
            continue
        first, second = a[:-d], a[d:]
        both = (first > 0) & (second > 0)
        if kind > 2:
            both &= (first == 1) | (second == 1)
        out.append((np.where(both, (kind * size + first) * size + second, 0), where[d:], d))
    return out


@dataclass
class Model:
    vocabulary: Vocabulary
    marked: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def positional(self, ids: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each distance of words the weights of features by position of the last word, and the distance."""
        size, out = len(self.marked), {}
        for keys, where, d in _keys(ids, self.marked, size):
            some = np.flatnonzero(keys)
            w = out.setdefault(d, np.zeros(len(ids)))
            if len(some) and len(self.keys):
                own = keys[some]
                at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
                w[where[some]] += np.where(self.keys[at] == own, self.weights[at], 0.0)
        return [(w, d) for d, w in out.items()]

    def best(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For runs of words that begin at `starts`: the highest score of a window, and the window. Runs are set apart by gaps, in which no window begins."""
        parts = self.positional(ids)
        top = np.full(len(starts), -np.inf)
        begin, length = starts.copy(), np.ones(len(starts), np.int64)
        sums = [np.concatenate([[0.0], np.cumsum(w)]) for w, _ in parts]
        n = len(ids)
        for size in WINDOWS:
            end = np.minimum(np.arange(n) + size, n)
            score = np.zeros(n)
            for s, (_, d) in zip(sums, parts, strict=True):
                score += s[end] - s[np.minimum(np.arange(n) + d, end)]
            score[ids == GAP] = -np.inf
            here = np.maximum.reduceat(score, starts)
            better = here > top
            if better.any():
                run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
                hit = np.flatnonzero(score == here[run])
                first = np.full(len(starts), -1)
                first[run[hit[::-1]]] = hit[::-1]
                begin[better], length[better], top[better] = first[better], size, here[better]
        return top, begin, length

    def score_texts(self, texts: Iterable[str | None]) -> np.ndarray:
        """Expected severity of each text; 0 for a text without words."""
        runs = [self.vocabulary.numbers(t) for t in texts]
        ids, starts = joined(runs)
        if not len(runs):
            return np.empty(0)
        out = severities(self.best(ids, starts)[0], self.thresholds)
        return np.where([len(r) > 0 for r in runs], out, 0.0)


def severities(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Expected grades."""
    return _logistic(scores[:, None] - thresholds[None, :]).sum(1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ordered(cuts: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the distances between them: ordered whatever the numbers."""
    return np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))


def cumulative_loss(scores: np.ndarray, grades: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The negative log-likelihood of grades under cumulative links, and its gradients by the scores and by the cuts."""
    n, theta = len(scores), ordered(cuts)
    reached = np.ones((n, len(theta) + 2))
    reached[:, 1:-1] = _logistic(scores[:, None] - theta[None, :])
    reached[:, -1] = 0.0
    slope = reached * (1 - reached)
    at = np.arange(n)
    chance = np.maximum(reached[at, grades] - reached[at, grades + 1], 1e-15)
    by_score = -(slope[at, grades] - slope[at, grades + 1]) / chance
    size = len(theta) + 2
    by_theta = np.bincount(grades, slope[at, grades] / chance, size) - np.bincount(grades + 1, slope[at, grades + 1] / chance, size)
    beyond = np.cumsum(by_theta[1:-1][::-1])[::-1]  # a distance moves its threshold and those after it
    return float(-np.log(chance).sum()), by_score, beyond * np.concatenate([[1.0], np.exp(cuts[1:])])


class _Adam:
    """Steps of one array down its gradient."""

    def __init__(self, x: np.ndarray, rate: float = 0.05):
        self.x, self.rate, self.mean, self.square, self.t = x, rate, np.zeros_like(x), np.zeros_like(x), 0

    def step(self, gradient: np.ndarray) -> None:
        self.t += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.01 * (gradient**2 - self.square)
        self.x -= self.rate * (self.mean / (1 - 0.9**self.t)) / (np.sqrt(self.square / (1 - 0.99**self.t)) + 1e-8)


def joined(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of words in one array with a gap after each, so that no window sees words of two runs."""
    gap = np.full(max(WINDOWS), GAP, np.int64)
    starts = np.cumsum([0, *(len(r) + len(gap) for r in runs)])[:-1]
    return (np.concatenate([x for r in runs for x in (r, gap)]) if runs else np.empty(0, np.int64)), starts.astype(np.int64)


def _window_features(model: Model, ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    size = len(model.marked)
    out = []
    for b, n in zip(begin, length, strict=True):
        part = ids[b : b + n]
        keys = np.concatenate([k for k, _, _ in _keys(part, model.marked, size)])
        out.append(np.unique(keys[keys > 0]))
    return out


def _fit_ordinal(features: list[np.ndarray], grades: np.ndarray, size: int, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by feature key, and thresholds: penalised maximum likelihood of the cumulative logit."""
    flat = np.concatenate(features)
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    keys, flat, times = np.unique(flat, return_inverse=True, return_counts=True)
    harmful = np.bincount(flat, (grades > 0)[rows], len(keys))
    # What few windows hold would be learnt by heart, with the errors of the raters.
    known = (harmful >= SUPPORT) | (times - harmful >= SUPPORT)
    number = np.cumsum(known) - 1
    kept = known[flat]
    keys, rows, flat = keys[known], rows[kept], number[flat[kept]]
    l2 = np.where(keys < size, l2, PAIR_PENALTY * l2)
    w, n = np.zeros(len(keys)), len(features)
    share = [min(max((grades >= k).mean(), 1e-3), 0.999) for k in range(1, GRADES)]
    theta = np.log((1 - np.array(share)) / np.array(share))
    cuts = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 0.1))])
    moves = _Adam(w), _Adam(cuts)
    for _ in range(STEPS):
        _, by_score, by_cuts = cumulative_loss(np.bincount(rows, w[flat], n), grades, cuts)
        moves[0].step(np.bincount(flat, by_score[rows], len(w)) + l2 * w)
        moves[1].step(by_cuts)
    return keys, w, ordered(cuts)


def _odds(words: list[np.ndarray], grades: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of harm given a word, against those of any document, drawn to even by CAUTION documents; documents of the highest grade."""
    df, harm = np.zeros(size), np.zeros(size)
    for own, g in zip(words, grades, strict=True):
        df[own] += 1
        if g == GRADES - 1:
            harm[own] += 1
    rate = min(max(float((grades == GRADES - 1).mean()) if len(grades) else 0.1, 0.02), 0.5)
    return np.log((harm + CAUTION * rate) / (df - harm + CAUTION * (1 - rate))) - np.log(rate / (1 - rate)), harm


def _fit_some(runs: list[np.ndarray], words: list[np.ndarray], grades: np.ndarray, vocabulary: Vocabulary, size: int, l2: float) -> Model:
    """Weights and thresholds from texts, not yet calibrated. runs: their words in order; words: their sets.

    Windows of documents without harm are gathered over the rounds: in each round every piece of such a document adds its
    most severe window if the model takes it for severe, so what was once mistaken for harm stays among the examples. Raters
    err: from the third round on, a document whose grade the model contradicts clearly is left out (TRUSTED).
    """
    odds, harm = _odds(words, grades, size)
    marked = (harm >= MARKED_DOCS) & (odds >= MARKED_ODDS)
    marked[:2] = False
    model = Model(vocabulary, marked, np.arange(2, size), np.where(harm > 0, np.clip(odds, -1, 3), np.minimum(odds, 0))[2:], np.array([2.0, 3.0]))
    rated = np.flatnonzero(grades > 0)
    if not len(rated):
        return Model(vocabulary, marked, np.empty(0, np.int64), np.empty(0), np.array([2.0, 3.0]))
    flat, starts = joined(runs)
    lengths = [max(1, -(-len(r) // PIECE)) for r in runs]
    begins = np.concatenate([s + PIECE * np.arange(n) for s, n in zip(starts, lengths, strict=True)])
    of = np.repeat(np.arange(len(runs)), lengths)
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    harmless_windows: list[tuple[int, np.ndarray]] = []
    seen: set[tuple[int, int]] = set()
    trusted = np.ones(len(runs), bool)
    for round_ in range(ROUNDS):
        tops, at, n = model.best(flat, begins)
        best = np.lexsort((-tops, of))[heads]
        if round_ > 1:
            scale, theta, _ = _calibrate(tops[best], grades)
            severity = severities(tops[best] * scale, theta)
            trusted = np.where(grades > 0, severity >= TRUSTED[0], severity < TRUSTED[1])
        hard = np.flatnonzero((grades[of] == 0) & ((tops > model.thresholds[0] - 2.0) | np.isin(np.arange(len(of)), best)))
        fresh = np.array([i for i in hard if (int(at[i]), int(n[i])) not in seen], np.int64)
        seen.update(zip(at[fresh].tolist(), n[fresh].tolist(), strict=True))
        harmless_windows += list(zip(of[fresh].tolist(), _window_features(model, flat, at[fresh], n[fresh]), strict=True))
        use = rated[trusted[rated]]
        # Revisions of a page share their windows; the same window is one example.
        own = zip(_window_features(model, flat, at[best[use]], n[best[use]]), grades[use], strict=True)
        harmful = {f.tobytes(): (f, g) for f, g in sorted(own, key=lambda x: x[1])}
        harmless = {f.tobytes(): f for i, f in harmless_windows if trusted[i]}
        if not harmful:
            break
        features = [f for f, _ in harmful.values()] + list(harmless.values())
        all_grades = np.array([g for _, g in harmful.values()] + [0] * len(harmless), int)
        model.keys, model.weights, model.thresholds = _fit_ordinal(features, all_grades, size, l2)
    return model


def _numbered(texts: Sequence[np.ndarray], starred: Sequence[str]) -> tuple[Vocabulary, int, list[np.ndarray], list[np.ndarray]]:
    """A vocabulary of the hashes that stand in at least two texts, its size, the runs and the sets of words of the texts."""
    sets = [np.unique(t) for t in texts]
    known, df = np.unique(np.concatenate(sets) if sets else np.empty(0, np.int64), return_counts=True)
    known = known[df >= 2]
    vocabulary = Vocabulary(dict(zip(known.tolist(), range(2, len(known) + 2), strict=True)), Stars(list(starred)))

    def numbers(own: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(own), np.int64)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        return np.where(known[at] == own, at + 2, 0)

    runs, words = [numbers(t) for t in texts], [numbers(s) for s in sets]
    return vocabulary, len(known) + 2, runs, [w[w > 0] for w in words]


def fit_side(texts: Sequence[np.ndarray], grades: np.ndarray, groups: Sequence, side: int, *, starred: Sequence[str] = (), l2: float = PENALTIES[0]) -> tuple[Model | None, np.ndarray]:
    """A model of the texts (hashes of their words). side 0: of all. side 1 or 2: of one half, and the scores of the other half by it; NaN elsewhere."""
    vocabulary, size, runs, words = _numbered(texts, starred)
    tops = np.full(len(texts), np.nan)
    if side == 0:
        return _fit_some(runs, words, grades, vocabulary, size, l2), tops
    half = np.array([zlib.crc32(str(g).encode()) % 2 for g in groups], int) + 1
    own, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
    if len(own) and len(other):
        flat, starts = joined([runs[i] for i in own])
        model = _fit_some([runs[i] for i in other], [words[i] for i in other], grades[other], vocabulary, size, l2)
        tops[own] = model.best(flat, starts)[0]
    return None, tops


def calibrated(models: Sequence[Model], tops: Sequence[np.ndarray], grades: np.ndarray) -> Model:
    """The model of the penalty under which documents outside the fit are likeliest, with the scale and thresholds that fit their scores."""
    best = None
    for model, own in zip(models, tops, strict=True):
        some = np.isfinite(own)
        if not (grades[some] > 0).any():
            return pruned(model)
        scale, thresholds, loss = _calibrate(own[some], grades[some])
        if best is None or loss < best[0]:
            best = (loss, model, scale, thresholds)
    _, model, scale, model.thresholds = best
    model.weights = model.weights * scale
    return pruned(model)


def fit(texts: Sequence[str], grades: np.ndarray, groups: Sequence | None = None, *, penalties: Sequence[float] = PENALTIES) -> Model:
    """A model from rated texts, in one process. Without a harmful one every text has the same low severity.

    Penalty, scale and thresholds are those of documents the weights were not fitted on: each half of the texts is scored by
    weights of the other half. Texts of one group (the revisions of a page) are in one half.
    """
    groups = range(len(texts)) if groups is None else groups
    plain = [[canonical(t) for t in tokens(x)] for x in texts]
    starred = marked_words(plain, grades)
    stars = Stars(starred)
    hashed = [np.array([hash_of(stars.resolve(w) if "*" in w else w) for w in own], np.int64) for own in plain]
    sides = [[fit_side(hashed, grades, groups, side, starred=starred, l2=l2) for side in (0, 1, 2)] for l2 in penalties]
    return calibrated([own[0][0] for own in sides], [np.where(np.isnan(own[1][1]), own[2][1], own[1][1]) for own in sides], grades)


def marked_words(plain: Sequence[Sequence[str]], grades: np.ndarray) -> list[str]:
    """The words that mark harm by the odds of the rated texts."""
    words = sorted({w for own in plain for w in own if "*" not in w and w.isalpha()})
    ids = {w: i for i, w in enumerate(words)}
    odds, harm = _odds([np.array(sorted({ids[w] for w in own if w in ids}), np.int64) for own in plain], grades, len(words))
    return [w for w, o, h in zip(words, odds, harm, strict=True) if h >= MARKED_DOCS and o >= MARKED_ODDS]


def _calibrate(tops: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Scale, thresholds and loss for the scores of whole documents: fitting saw more harmless windows than documents have.

    They are drawn to USUAL, which decides where next to nothing is rated and is outweighed by a few hundred documents.
    """
    finite = tops[np.isfinite(tops)]
    tops = np.maximum(tops, finite.min() if len(finite) else 0.0)
    usual = np.array([USUAL[1], np.log(USUAL[2])])
    scale, cuts = np.array([USUAL[0]]), usual.copy()
    moves = _Adam(scale), _Adam(cuts)
    for _ in range(400):
        _, by_score, by_cuts = cumulative_loss(tops * scale[0], grades, cuts)
        moves[0].step(np.array([(by_score * tops).sum()]) + 4 * (scale - USUAL[0]))
        moves[1].step(by_cuts + 2 * (cuts - usual))
        scale[0] = max(scale[0], 0.2)
    return float(scale[0]), ordered(cuts), cumulative_loss(tops * scale[0], grades, cuts)[0]


def pruned(model: Model, least: float = 0.02) -> Model:
    """Without features of next to no weight and words no feature needs."""
    size = len(model.marked)
    keep = np.abs(model.weights) >= least
    keys, weights = model.keys[keep], model.weights[keep]
    used = {int(i) for i in np.flatnonzero(model.marked)}
    for k in keys.tolist():
        used.update([k] if k < size else [k % size, k // size % size])
    order = {old: new for new, old in enumerate(sorted(used - {0, 1}), start=2)}
    order |= {0: 0, 1: 1}
    small = len(order)
    new = [order[k] if k < size else (k // size // size * small + order[k // size % size]) * small + order[k % size] for k in keys.tolist()]
    at = np.argsort(new) if new else np.empty(0, np.int64)
    marked = np.zeros(small, bool)
    marked[[order[int(i)] for i in np.flatnonzero(model.marked)]] = True
    ids = {w: order[i] for w, i in model.vocabulary.ids.items() if i in order}
    return Model(Vocabulary(ids, model.vocabulary.stars), marked, np.array(new, np.int64)[at], weights[at], model.thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 if no rater found harm, 2 if all did, 1 else. Ratings without a verdict do not count."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("verdict").isin("harmful", "fine")).groupBy("doc_id").agg(
        F.count(F.when(F.col("verdict") == "harmful", 1)).alias("h"), F.count(F.lit(1)).alias("n")
    )
    return votes.select("doc_id", F.when(F.col("h") == 0, 0).when(F.col("h") == F.col("n"), 2).otherwise(1).alias("grade"))


def rated_words(documents: DataFrame, labels: DataFrame, most: int = MOST_RATED) -> DataFrame:
    """doc_id, grade, page and the canonical words of at most `most` rated documents; which ones depends on doc_id alone."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    group = F.col("page_id") if "page_id" in documents.columns else F.col("doc_id")
    texts = documents.where(F.col("text").isNotNull() & (F.length("text") <= MOST_CHARS)).select("doc_id", "text", group.cast("string").alias("page"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[canonical(t) for t in tokens(x)] for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.list_(pa.string()))], names=["doc_id", "grade", "page", "words"])

    # At most `most` pairs of two numbers are sent to the executors.
    rated = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "page", "text")
    return cut(rated.mapInArrow(read, "doc_id long, grade int, page string, words array<string>"))


def marked_of(rated: DataFrame) -> list[str]:
    """marked_words of a table: the few words that mark harm go to the driver."""
    n, harmful = rated.agg(F.count(F.lit(1)), F.count(F.when(F.col("grade") == GRADES - 1, 1))).first()
    rate = min(max(harmful / n if n else 0.1, 0.02), 0.5)
    counts = rated.select("grade", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("df"), F.count(F.when(F.col("grade") == GRADES - 1, 1)).alias("harm")
    )
    odds = F.log((F.col("harm") + CAUTION * rate) / (F.col("df") - F.col("harm") + CAUTION * (1 - rate))) - float(np.log(rate / (1 - rate)))
    found = counts.where((F.col("harm") >= MARKED_DOCS) & (odds >= MARKED_ODDS)).select("word").collect()
    return sorted(r.word for r in found if "*" not in r.word and r.word.isalpha())


def train(documents: DataFrame, labels: DataFrame, *, most: int = MOST_RATED) -> Model:
    """A model from the ratings of documents, fitted as by `fit`.

    The executors read the rated documents and hand on the hashes of their words. The model and the two halves that
    calibrate it are fitted in a task each, for each penalty: the bounds of the sample bound a task. Only the words that mark
    harm, the models and a few numbers for each rated document go to the driver.
    """
    rated = rated_words(documents, labels, most)
    starred = marked_of(rated)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = Stars(starred)
        for batch in batches:
            numbers = [[hash_of(stars.resolve(w) if "*" in w else w) for w in own] for own in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(numbers, pa.list_(pa.int64()))], names=["doc_id", "grade", "page", "words"])

    words = rated.mapInArrow(hashed, "doc_id long, grade int, page string, words array<bigint>")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if not own:
            return
        whole = pa.Table.from_batches(own)
        for task in sorted(set(whole.column(4).to_pylist())):
            ids, grades, pages, texts = (whole.filter(pc.equal(whole.column(4), task)).column(i).to_pylist() for i in range(4))
            order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
            grade = np.array([grades[i] for i in order], int)
            side, l2 = tasks[task]
            model, tops = fit_side([np.array(texts[i], np.int64) for i in order], grade, [pages[i] for i in order], side, starred=starred, l2=l2)
            raw = b"" if model is None else pickle.dumps(pruned(model))
            values = ((task, pa.int32()), (raw, pa.binary()), (tops, pa.list_(pa.float64())), (grade, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], names=["task", "model", "tops", "grades"])

    tasks = [(side, l2) for side in (0, 1, 2) for l2 in PENALTIES]
    copies = words.withColumn("task", F.explode(F.array(*(F.lit(i) for i in range(len(tasks)))))).repartitionByRange(len(tasks), "task")
    sides = {tasks[r.task]: r for r in copies.mapInArrow(fitted, "task int, model binary, tops array<double>, grades array<bigint>").collect()}
    if not sides:
        return fit([], np.empty(0, int))
    halves = [[np.array(sides[side, l2].tops, float) for side in (1, 2)] for l2 in PENALTIES]
    models = [pickle.loads(sides[0, l2].model) for l2 in PENALTIES]
    return calibrated(models, [np.where(np.isnan(a), b, a) for a, b in halves], np.array(sides[0, PENALTIES[0]].grades, int))


def score(documents: DataFrame, model: Model, *, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of keep, severity (0 to 2): the expected severity of the most severe passage, over whole texts. No row moves.

    Defined cases: NULL, empty and blank texts have severity 0; repeated rows are scored each; other columns are ignored; an
    empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                severity = own.score_texts(part.column(1).to_pylist())
                kept = [part.column(i) for i in range(2, part.num_columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), *kept, pa.array(severity, pa.float64())], names=["doc_id", *keep, "severity"])

    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep]
    return documents.select("doc_id", "text", *keep).mapInArrow(run, ", ".join(["doc_id long", *kinds, "severity double"]))

"""Similarity flooding between schemas.

A schema is a graph: its fields, and nodes for what a field has: JSON types, marks of its values (which signs and kinds of
characters stand in them and next to each other), lengths of its values, short values themselves, and the names nested in it. An edge has as weight
the share of the field's values that have the property. Scores of pairs of fields and of pairs of equal properties feed each
other until they settle: two fields are alike as far as their names and their properties are, and a property counts as far as
the fields that share it are alike. So a mark that all fields have comes to count for little, and one that tells fields apart
for much. Pairs above a score are taken one-to-one, best first.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Share of the name in a score; the rest is that of the properties, by these weights.
NAME_SHARE = 0.3
WEIGHTS = {"types": 0.1, "marks": 0.5, "lengths": 0.25, "nested": 0.15, "short": 0.4}
#: Besides the cosine of two fields' properties counts the share of one field's properties that the other has at all: a small
#: file shows few of the forms that a field takes. A property is had from this share of the values on.
COVERED, SUPPORT = 0.5, 0.05
#: Lengths that differ by so many steps (three a doubling) are alike by 1/e.
LENGTH_STEPS = 2.0
#: A correspondence has at least this score.
LEAST = 0.53
TOLERANCE, ROUNDS = 1e-4, 200


@dataclass(frozen=True)
class Field:
    """A field of a schema, with the shares of its values that have each property."""

    name: str
    types: Mapping[str, float]
    marks: Mapping[str, float] = field(default_factory=dict)
    lengths: Mapping[int, float] = field(default_factory=dict)
    nested: Mapping[str, float] = field(default_factory=dict)
    short: Mapping[str, float] = field(default_factory=dict)


def words(name: str) -> list[str]:
    """userAgent, user_agent and user-agent are user, agent."""
    return re.findall(r"[a-z]+|[0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())


def _grams(text: str) -> set[str]:
    padded = f" {text} "
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


@lru_cache(maxsize=20_000)
def name_similarity(a: str, b: str) -> float:
    """1 for equal names; else the better of shared letter pairs, shared words, and initials or a beginning."""
    if a == b:
        return 1.0
    wa, wb = words(a), words(b)
    ja, jb = "".join(wa), "".join(wb)
    if not ja or not jb:
        return 0.0
    if ja == jb:
        return 0.95
    ga, gb = _grams(ja), _grams(jb)
    pairs = 2 * len(ga & gb) / (len(ga) + len(gb))
    shared = 2 * len(set(wa) & set(wb)) / (len(set(wa)) + len(set(wb)))
    initials = lambda w: "".join(x[0] for x in w)
    short = 0.8 if len(ja) > 1 and (ja == initials(wb) or jb == initials(wa)) else 0.0
    begins = 0.75 if min(len(ja), len(jb)) >= 3 and (ja.startswith(jb) or jb.startswith(ja) or ja.endswith(jb) or jb.endswith(ja)) else 0.0
    return max(pairs, 0.9 * shared, short, begins)


class _Label:
    """The edges of one label: shares of the fields of many schemas (left) and of one (right) in the properties they have."""

    def __init__(self, left: Sequence[Sequence[Field]], right: Sequence[Field], label: str):
        own = lambda f: getattr(f, label)
        number: dict = {}
        for fields in (right, *left):
            for f in fields:
                for p in own(f):
                    number.setdefault(p, len(number))
        self.a = np.zeros((len(left), max(map(len, left), default=0), len(number)))
        self.b = np.zeros((len(right), len(number)))
        for s, fields in enumerate(left):
            for i, f in enumerate(fields):
                for p, share in own(f).items():
                    self.a[s, i, number[p]] = share
        for j, f in enumerate(right):
            for p, share in own(f).items():
                self.b[j, number[p]] = share
        has = self.b >= SUPPORT
        self.alike = None
        if label == "lengths" and number:
            at = np.array(list(number), float)
            self.alike = np.exp(-np.abs(at[:, None] - at[None, :]) / LENGTH_STEPS)
            has = np.stack([self.alike[:, h].max(axis=1, initial=0.0) for h in has])
        self.has = has.astype(float)
        # A label counts as far as it is known: by the share of values that have a property of it, on the side that has more.
        self.known = np.minimum(np.maximum(self.a.sum(-1)[:, :, None], self.b.sum(-1)[None, None, :]), 1.0)
        self.edges = self.a.sum(axis=1) * self.b.sum(axis=0)

    def fields(self, strength: np.ndarray) -> np.ndarray:
        """How alike fields are by properties of these strengths."""
        a, b = self.a * strength[:, None, :], self.b[None] * strength[:, None, :]
        near_a, near_b = (a, b) if self.alike is None else (a @ self.alike, b @ self.alike)
        size_a, size_b = (near_a * a).sum(-1), (near_b * b).sum(-1)
        cosine = (near_a @ b.transpose(0, 2, 1)) / np.sqrt(np.maximum(size_a[:, :, None] * size_b[:, None, :], 1e-12))
        covered = (a @ self.has.T) / np.maximum(a.sum(-1), 1e-9)[:, :, None]
        return (1 - COVERED) * cosine + COVERED * covered

    def strengths(self, score: np.ndarray) -> np.ndarray:
        """The mean score of the pairs of fields that share each property, the largest being 1; what only one side has gets the mean."""
        shared = self.edges > 0
        fed = ((score.transpose(0, 2, 1) @ self.a) * self.b[None]).sum(axis=1)
        mean = np.where(shared, fed / np.where(shared, self.edges, 1.0), 0.0)
        usual = mean.sum(-1) / np.maximum(shared.sum(-1), 1)
        mean = np.where(shared, mean, usual[:, None])
        top = mean.max(axis=-1, initial=0.0)[:, None]
        return np.where(top > 0, mean / np.where(top > 0, top, 1.0), 1.0)


def flood(left: Sequence[Sequence[Field]], right: Sequence[Field], *, propagate: bool = True) -> np.ndarray:
    """schemas x fields x fields of right: the scores at the fixed point, 0 to 1. propagate=False leaves the scores of the names."""
    width = max(map(len, left), default=0)
    names = np.zeros((len(left), width, len(right)))
    for s, fields in enumerate(left):
        for i, f in enumerate(fields):
            names[s, i] = [name_similarity(f.name, g.name) for g in right]
    if not propagate or not names.size:
        return names
    labels = [(_Label(left, right, label), weight) for label, weight in WEIGHTS.items()]
    strengths = [np.ones((len(left), e.a.shape[2])) for e, _ in labels]
    score = None
    for round_ in range(ROUNDS):
        total, known = np.zeros_like(names), np.zeros_like(names)
        for (edges, weight), strength in zip(labels, strengths, strict=True):
            if edges.a.shape[2]:
                total += weight * edges.fields(strength) * edges.known
                known += weight * edges.known
        new = NAME_SHARE * names + (1 - NAME_SHARE) * total / np.maximum(known, 1e-9)
        if score is not None:
            if round_ > ROUNDS // 4:
                new = (new + score) / 2  # damps scores that swing
            if np.abs(new - score).max() < TOLERANCE:
                return new
        score = new
        strengths = [edges.strengths(score) for edges, _ in labels]
    warnings.warn(f"similarity flooding has not settled in {ROUNDS} rounds", stacklevel=2)
    return score


def select(score: np.ndarray, names: Sequence[str], least: float = LEAST) -> dict[int, str]:
    """One-to-one correspondences of the rows of a score to names: the best remaining pair, down to `least`. A name may stand
    several times, for the forms a field has; its best form counts."""
    distinct = sorted(set(names))
    order = np.argsort([distinct.index(n) for n in names], kind="stable")
    starts = np.searchsorted(np.array([distinct.index(names[j]) for j in order]), np.arange(len(distinct)))
    best = np.maximum.reduceat(score[:, order], starts, axis=1) if score.size else np.zeros((len(score), 0))
    pairs = [(-best[i, j], i, distinct[j]) for i, j in zip(*np.nonzero(best >= least), strict=True)]
    taken: dict[int, str] = {}
    used: set[str] = set()
    for _, i, name in sorted(pairs):
        if i not in taken and name not in used:
            taken[i] = name
            used.add(name)
    return taken

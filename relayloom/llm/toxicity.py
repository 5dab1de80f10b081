"""Toxic spans by a two-state linear-chain conditional random field.

Tokens are runs of letters. Document labels become token labels on the training sample: a
token of a toxic document is labelled toxic if one of its features (the word, its prefixes
of 4 to 7 letters) stands in toxic documents so much more than by chance that the evidence
outweighs the number of features looked at; tokens of clean documents are labelled clean.
A CRF is fitted to these sequences. Scoring runs forward-backward over the whole text; the marginals of
the toxic state give the spans (adjoining tokens at 0.5 or more), and their sum and
maximum, through a logistic curve fitted on the same sample, give the document's score.

The sample is bounded by parameters (`toxic_rows`, `clean_rows`; whole texts of whatever length), so fitting
on the driver and the broadcast weights don't grow with the input. Scoring is one scan; no shuffle.

Defined cases: null and empty texts get the score of a text without any toxic token; null
labels are skipped; a doc_id that is labelled twice counts as toxic if one label is; null
doc_ids are scored, held_out false; with an empty label table every score is 0.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relayloom.llm.common import Cache, chunks, live, map_texts, small_batches, two
from relayloom.llm.simhash import shingle_hashes

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 8)
_CLIP = 60.0


def features(word: str) -> list[str]:
    """Of a lower-case word: itself (marked by a stop), and its prefixes."""
    return [word + "."] + [word[:k] for k in PREFIXES if len(word) >= k]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -_CLIP
    #: Potentials (not logarithms) from state i to state j.
    moves: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    #: Score = logistic(curve . (1, log(1 + sum of marginals), largest marginal)).
    curve: tuple[float, float, float] = (-_CLIP, 0.0, 0.0)

    #: Tells models apart, in whatever process they are.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def emission(self, word: str) -> float:
        get = self.weights.get
        x = self.bias + sum(get(f, 0.0) for f in features(word.lower()))
        return min(max(x, -_CLIP), _CLIP)


class Lattice:
    """Sequences side by side, longest first, time by time; without padding."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths
        longest = int(lengths.max(initial=0))
        ended = np.bincount(lengths, minlength=longest + 1)
        self.active = len(lengths) - np.cumsum(ended)[:longest]
        self.at = np.r_[0, np.cumsum(self.active)]
        where = np.empty(int(lengths.sum()), np.int64)
        first = np.r_[0, np.cumsum(lengths)]
        for lane, k in enumerate(self.order.tolist()):
            n = int(lengths[k])
            where[first[k] : first[k] + n] = self.at[:n] + lane
        self.where = where  # of each token, in the order of the input

    def marginal_odds(self, emission: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Odds of state 1 at each token, in the lattice's order, with the forward, backward and emission odds."""
        (m00, m01), (m10, m11) = moves.tolist()
        e = np.empty_like(emission)
        e[self.where] = np.exp(emission)
        ahead, back = np.empty_like(e), np.ones_like(e)
        last = len(self.active) - 1
        for t, n in enumerate(self.active.tolist()):
            a = self.at[t]
            if t:
                p = ahead[self.at[t - 1] : self.at[t - 1] + n]
                ahead[a : a + n] = e[a : a + n] * ((m01 + m11 * p) / (m00 + m10 * p))
            else:
                ahead[:n] = e[:n]
        for t in range(last - 1, -1, -1):
            a, b, n = self.at[t], self.at[t + 1], int(self.active[t + 1])
            x = e[b : b + n] * back[b : b + n]
            back[a : a + n] = (m10 + m11 * x) / (m00 + m01 * x)
        return ahead * back, ahead, back, e


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _marks(docs: list[np.ndarray], own: list[list[int]], known: int, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each feature: the number of toxic documents that have it, and whether it marks a token as toxic.

    docs: the distinct words of each; own: the features of each word."""
    seen = np.zeros((2, known), np.int64)
    for ws, y in zip(docs, toxic.tolist()):
        seen[y][list({f for w in ws.tolist() for f in own[w]})] += 1
    n0, n1 = int((toxic == 0).sum()), int((toxic == 1).sum())
    p = n1 / (n0 + n1)
    b, a = seen
    need = math.log(max(int((a >= 3).sum()), 1)) + 2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = a * np.log(a / ((a + b) * p)) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - p))), 0)
        return a, (a >= 3) & (a * n0 > 20 * b * n1) & (gain >= need)


def _apart(texts: list[str]) -> list[int]:
    """Numbers of texts of which no two share one of their 8 smallest shingle hashes: copies would make
    a text's rarest words look like evidence."""
    taken: set[int] = set()
    out = []
    for k, text in enumerate(texts):
        least = set(np.unique(shingle_hashes(text, 5))[:8].tolist())
        if not taken & least:
            out.append(k)
        taken |= least
    return out


def _alike_long(lengths: np.ndarray, parts: int = 4) -> list[np.ndarray]:
    """Numbers of sequences, the longest first, in groups of about equal total lengths: a group's lattice takes a share of the memory of all,
    and no more steps than its longest."""
    order = np.argsort(-lengths, kind="stable")
    done = np.cumsum(lengths[order])
    cuts = np.searchsorted(done, done[-1] * np.arange(1, parts) / parts, "left") + 1
    return [some for some in np.split(order, np.unique(cuts)) if len(some)]


class _Group:
    """Documents of the sample with their token labels, for the gradient of the likelihood."""

    def __init__(self, words: list[np.ndarray], toxic: np.ndarray, marked: np.ndarray):
        lengths = np.array([len(w) for w in words], np.int64)
        self.token, self.lattice = np.concatenate(words).astype(np.int32), Lattice(lengths)
        label = marked[self.token] & np.repeat(toxic == 1, lengths)
        self.gold = np.zeros(len(label), bool)
        self.gold[self.lattice.where] = label
        starts, active = self.lattice.at, self.lattice.active
        # The token before each: all but the first of a text, which come first in the lattice.
        self.before = np.concatenate([np.arange(starts[t], starts[t] + n) for t, n in enumerate(active[1:])] or [np.empty(0, np.int64)]).astype(np.int32)
        self.after = slice(int(active[0]) if len(active) else 0, None)
        a, b = self.gold[self.before].astype(float), self.gold[self.after].astype(float)
        #: Moves from state i to state j, 00, 01, 10, 11.
        self.true = np.array([(1 - a) @ (1 - b), (1 - a) @ b, a @ (1 - b), a @ b])

    def add(self, by_word: np.ndarray, moves: np.ndarray, off: np.ndarray, joint: np.ndarray) -> None:
        """Add the difference from the labels, word by word, to off, and the expected moves to joint."""
        odds, ahead, back, e = self.lattice.marginal_odds(by_word[self.token], moves)
        odds /= 1 + odds
        odds -= self.gold
        off += np.bincount(self.token, odds[self.lattice.where], len(off))
        x, f = e[self.after] * back[self.after], ahead[self.before]
        share = 1 / (moves[0, 0] + moves[0, 1] * x + moves[1, 0] * f + moves[1, 1] * f * x)
        joint += [moves[0, 0] * share.sum(), moves[0, 1] * (x @ share), moves[1, 0] * (f @ share), moves[1, 1] * ((f * x) @ share)]


def fit(texts: list[str], toxic: list[int], base_rate: float, steps: int = 40) -> Model:
    """base_rate: share of toxic documents among all that are labelled (the sample is stratified)."""
    apart = _apart(texts)
    texts, y = [texts[k] for k in apart], np.array([toxic[k] for k in apart], np.int64)
    if not 0 < y.sum() < len(y):
        return Model()
    index: dict[str, int] = {}
    number: dict[str, int] = {}
    words = [np.array([index.setdefault(w.lower(), len(index)) for w in WORD.findall(t)], np.int64) for t in texts]
    distinct = [np.unique(w) for w in words]
    in_toxic = np.zeros(len(index), bool)
    for k in np.flatnonzero(y):
        in_toxic[distinct[k]] = True
    for w, there in zip(index, in_toxic.tolist()):  # features of clean documents alone can't mark anything
        if there:
            for f in features(w):
                number.setdefault(f, len(number))
    own = [[number[f] for f in features(w) if f in number] for w in index]
    often, marks = _marks(distinct, own, len(number), y)
    for _ in range(3):  # what the documents without a mark so far have in common stands out among them alone
        marked = np.array([marks[x].any() for x in own], bool)
        bare = [k for k, ws in enumerate(distinct) if not y[k] or not marked[ws].any()]
        more = _marks([distinct[k] for k in bare], own, len(number), y[bare])[1] if y[bare].any() else np.zeros_like(marks)
        if not more.any():
            break
        marks |= more
    marked = np.array([marks[x].any() for x in own], bool)
    place = np.full(len(number), -1)
    place[often >= 3] = np.arange(int((often >= 3).sum()))
    known = [f for f, n in zip(number, often.tolist()) if n >= 3]
    own = [[int(place[f]) for f in x if place[f] >= 0] for x in own]
    of_word = np.repeat(np.arange(len(own)), [len(x) for x in own])
    of_feature = np.array([k for x in own for k in x], np.int64)
    del number, distinct
    groups = [_Group([words[k] for k in some], y[some], marked) for some in _alike_long(np.array([len(w) for w in words], np.int64))]
    del words
    true = sum(g.true for g in groups)
    theta = np.zeros(len(known) + 5)  # features, bias, moves
    theta[len(known)] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        by_word = np.clip(np.bincount(of_word, theta[of_feature], len(own)) + theta[len(known)], -_CLIP, _CLIP)
        moves = np.exp(theta[-4:].reshape(2, 2))
        off, joint = np.zeros(len(own)), np.zeros(4)
        for each in groups:
            each.add(by_word, moves, off, joint)
        g = np.zeros_like(theta)
        g[: len(known)] = np.bincount(of_feature, off[of_word], len(known))
        g[len(known)] = off.sum()
        g[-4:] = joint - true
        g += 0.5 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    del groups
    kept = {f: float(w) for f, w in zip(known, theta) if abs(w) > 0.05}
    model = Model(kept, float(theta[len(known)]), np.exp(theta[-4:].reshape(2, 2)))
    x, cache = np.ones((len(texts), 3)), Cache(model.emission)
    for some in _alike_long(np.array([len(t) for t in texts], np.int64)):
        x[some, 1:] = [(math.log1p(s), top) for s, top in _sums(model, [texts[k] for k in some], cache)]
    share = y.mean()
    weight = np.where(y == 1, base_rate / share, (1 - base_rate) / (1 - share))
    curve = np.zeros(3)
    for _ in range(60):  # Newton steps with a small ridge
        p = _sigmoid(x @ curve)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        curve -= np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.1 * curve)
    model.curve = tuple(float(c) for c in curve)
    return model


def _marginals(model: Model, texts: list[str], cache=None) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of all texts: the probability of the toxic state; and the number of words of each text."""
    get = (Cache(model.emission) if cache is None else cache).__getitem__
    found = [WORD.findall(t) for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    emission = np.fromiter((get(w) for ws in found for w in ws), np.float64, int(lengths.sum()))
    lattice = Lattice(lengths)
    odds = lattice.marginal_odds(emission, model.moves)[0]
    return (odds / (1 + odds))[lattice.where], lengths


def _sums(model: Model, texts: list[str], cache=None):
    p, lengths = _marginals(model, texts, cache)
    return [(float(x.sum()), float(x.max(initial=0.0))) for x in np.split(p, np.cumsum(lengths)[:-1])]


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Runs of adjoining tokens at 0.5 or more: start, end (code points, end exclusive) and the highest marginal."""
    out, before = [], -2
    if not len(p) or p.max() < 0.5:
        return out
    for k, m in enumerate(WORD.finditer(text)):
        if p[k] >= 0.5:
            if before == k - 1:
                out[-1]["end"], out[-1]["score"] = m.end(), max(out[-1]["score"], float(p[k]))
            else:
                out.append({"start": m.start(), "end": m.end(), "score": float(p[k])})
            before = k
    return out


def score_texts(texts: list[str], model: Model) -> dict[str, list]:
    cache = live(("toxicity", model.key), lambda: Cache(model.emission, 200_000))
    p, lengths = _marginals(model, texts, cache)
    each = np.split(p, np.cumsum(lengths)[:-1]) if len(texts) else []
    c0, c1, c2 = model.curve
    return {"score": [float(_sigmoid(c0 + c1 * math.log1p(x.sum()) + c2 * x.max(initial=0.0))) for x in each], "spans": [spans_of(t, x) for t, x in zip(texts, each)]}


def remainder(doc_id):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, clean_rows: int = 2500) -> Model:
    """Fit on a sample of labelled rows outside the held-out fifth: of each class the first rows in
    the order of a hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(remainder("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share, count = known.agg(F.avg("toxic"), F.count("*")).first()
    if not count:
        return Model()
    label = {}
    for y, most in ((1, toxic_rows), (0, clean_rows)):
        label |= {r.doc_id: y for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}
    ids = docs.sparkSession.createDataFrame([(i,) for i in label], "doc_id long")
    sample = two(docs).join(F.broadcast(ids), "doc_id")
    rows = sample.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return fit([r.text for r in rows], [label[r.doc_id] for r in rows], float(share))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the offending spans of each document."""
    out = map_texts(docs, functools.partial(score_texts, model=model), "score double, spans array<struct<start:int,end:int,score:double>>")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all columns, whose score is below 0.5."""

    def keep(batches):
        for part in chunks(batches):
            scores = score_texts([x or "" for x in part.column("text").to_pylist()], model)["score"]
            yield part.filter(pa.array([s < 0.5 for s in scores]))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)

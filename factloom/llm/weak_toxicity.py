"""Toxicity by weak supervision.

Many voters, each a lexicon entry (a word, or a pattern: a word's beginning) or a pattern of
how such entries occur, vote "toxic" or not.  A generative model, fitted by expectation
maximisation, estimates each voter's accuracy and its correlation with the one voter that it
depends on most (given the class); its posterior labels train a linear classifier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, id_and_text, small_batches, stage
from .labelled import labelled, sigmoid

_WORD = re.compile(r"[^\W\d_]{2,}")
_STEMS = (4, 5, 6)
PATTERNS = ["sure", "several", "share"]  # an entry hardly ever in clean rows; more than one word of such; a twentieth of all words


def entries(text: str) -> Counter:
    """How often each word, and each beginning of a word (``abcd*``), occurs in the whole text."""
    words = Counter(_WORD.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        for k in _STEMS:
            if len(word) > k:
                out[word[:k] + "*"] += n
    return out


class Lexicon(NamedTuple):
    words: dict[str, int]  # entry -> voter
    stems: dict[str, int]
    sure: frozenset[int]  # voters that hardly ever occur in a clean row
    size: int

    @classmethod
    def of(cls, found: list[str], sure: set[str]) -> Lexicon:
        return cls({e: i for i, e in enumerate(found) if e[-1] != "*"}, {e[:-1]: i for i, e in enumerate(found) if e[-1] == "*"}, frozenset(i for i, e in enumerate(found) if e in sure), len(found))

    def votes(self, text: str) -> list[int]:
        """The voters that say "toxic" of the whole text: entries that occur, and after them the patterns."""
        hits, total, n = set(), 0, 0
        known, stems = self.words, self.stems
        for word in _WORD.findall(text.lower()):
            n += 1
            found = [i for i in (known.get(word), *(stems.get(word[:k]) for k in _STEMS if len(word) > k)) if i is not None]
            if found:
                hits.update(found)
                total += not self.sure.isdisjoint(found)
        patterns = (not hits.isdisjoint(self.sure), total > 1, total and 20 * total >= n)
        return [*sorted(hits), *(self.size + k for k, yes in enumerate(patterns) if yes)]


class Votes(NamedTuple):
    """Which voter said "toxic" of which row, as pairs; row k stands for ``times[k]`` rows labelled ``known[k]`` (0 or 1)."""

    row: np.ndarray
    voter: np.ndarray
    rows: int
    voters: int
    known: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, lists: list[list[int]], voters: int) -> Votes:
        row, voter = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([v for x in lists for v in x], np.int64)
        return cls(row, voter, len(lists), voters, np.zeros(len(lists)), np.ones(len(lists)))

    def by_row(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, value, self.rows)

    def by_voter(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.voter, value[self.row], self.voters)

    def total(self, numbers: Callable[[Votes], np.ndarray]) -> np.ndarray:
        return numbers(self)

    def pairs(self, least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Two voters (the smaller one first) and in how many rows both have voted, handed on at ``least`` pairs."""
        order = np.argsort(self.row, kind="stable")
        own, both = np.split(self.voter[order], np.cumsum(np.bincount(self.row, minlength=self.rows))[:-1]), Counter()
        for k, (voters, n) in enumerate(zip(own, self.times.astype(np.int64).tolist(), strict=True), 1):
            for x, y in combinations(sorted(voters.tolist()), 2):
                both[x, y] += n
            if both and (k == self.rows or 0 < least < len(both)):
                yield (*np.array(list(both), np.int64).T, np.array(list(both.values()), np.int64))
                both.clear()

    def parents(self, chosen: Callable[..., tuple[np.ndarray, ...]]) -> list[tuple[int, int]]:
        found = [chosen(*p) for p in self.pairs()] or [(np.zeros(0, np.int64),) * 3]
        child, parent, strength = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((parent, -strength, child))
        first = order[np.diff(child[order], prepend=-1) != 0]
        return list(zip(child[first].tolist(), parent[first].tolist(), strict=True))


def _blocks(voters: int, batches: Iterator[pa.RecordBatch]) -> Iterator[Votes]:
    for batch in batches:
        votes, n = batch.column("votes"), batch.num_rows
        known, times = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "n"))
        sizes = np.diff(votes.offsets.to_numpy())
        yield Votes(np.repeat(np.arange(n), sizes), votes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n, voters, known, times)


class VotesTable:
    """The same of a table (votes array<int>, label int, n long) of any size: Spark's tasks add up, a few numbers a voter come to the driver."""

    def __init__(self, table: DataFrame, voters: int):
        self.table, self.voters = table, voters

    def total(self, numbers: Callable[[Votes], np.ndarray]) -> np.ndarray:
        blocks = partial(_blocks, self.voters)

        def run(batches):
            whole = None
            for block in blocks(batches):
                part = numbers(block)
                whole = part if whole is None else whole + part
            if whole is not None:
                yield pa.RecordBatch.from_arrays([pa.array([whole.astype("<f8").tobytes()], pa.binary())], ["numbers"])

        return np.sum([np.frombuffer(bytes(r[0]), "<f8") for r in self.table.mapInArrow(run, "numbers binary").collect()], axis=0)

    def parents(self, chosen: Callable[..., tuple[np.ndarray, ...]]) -> list[tuple[int, int]]:
        blocks = partial(_blocks, self.voters)

        def count(batches):
            for block in blocks(batches):
                for columns in block.pairs(100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "n"])

        def choose(batches):
            for batch in batches:
                child, parent, strength = chosen(*(batch.column(c).to_numpy() for c in ("x", "y", "n")))
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent), pa.array(strength)], ["child", "parent", "strength"])

        both = self.table.mapInArrow(count, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
        best = both.mapInArrow(choose, "child long, parent long, strength double").groupBy("child").agg(F.max(F.struct("strength", (-F.col("parent")).alias("less"))).alias("best"))
        return [(r.child, -r.less) for r in best.select("child", "best.less").collect()]


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray  # of each voter; the last one is the constant
    accuracy: np.ndarray  # of each voter, for reports: P(votes toxic | toxic), P(votes toxic | clean)

    def score(self, text: str) -> float:
        return float(sigmoid(self.weights[self.lexicon.votes(text)].sum() + self.weights[-1]))


def mine(rows: DataFrame, *, odds: float = 3.0, least: float = 30.0, sure: float = 0.99) -> tuple[list[str], set[str]]:
    """All lexicon entries that are far commoner in rows labelled 1 than chance explains, and which of them are hardly ever in others.

    Counted over all of ``rows``.  ``odds`` is the least logarithm of the ratio of shares,
    ``least`` the likelihood ratio statistic (what chance gives for one of some million entries):
    about eight toxic rows and no clean one if an eighth of all rows is toxic.  How rare an entry is does not matter beyond that, and neither does how
    many there are.
    """

    def run(batches):
        seen = {0: Counter(), 1: Counter()}

        def counted(least):
            for label, found in seen.items():
                if len(found) > least:
                    keys, n = list(found), list(found.values())
                    nothing = [0] * len(n)
                    found.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n if label else nothing, pa.int64()), pa.array(nothing if label else n, pa.int64())], ["entry", "yes", "no"])

        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[int(bool(label))].update([*entries(text)])
                yield from counted(100_000)
        yield from counted(0)

    whole = rows.agg(F.count_if(F.col("label") != 0).alias("yes"), F.count_if(F.col("label") == 0).alias("no")).first()
    if not whole.yes or not whole.no:
        return [], set()
    counted = rows.mapInArrow(run, "entry string, yes long, no long").groupBy("entry").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    yes, no, toxic, clean = F.col("yes"), F.col("no"), float(whole.yes), float(whole.no)
    ratio = F.log((yes + 0.5) / (toxic + 1)) - F.log((no + 0.5) / (clean + 1))
    share = toxic / (toxic + clean)
    surprise = 2 * (yes * F.log(yes / ((yes + no) * share)) + F.when(no > 0, no * F.log(no / ((yes + no) * (1 - share)))).otherwise(0.0))
    good = counted.where((yes > 0) & (ratio >= odds) & (surprise >= least))
    found = sorted(good.collect(), key=lambda r: (-r.yes, r.entry))
    return [r.entry for r in found], {r.entry for r in found if r.yes >= sure * (r.yes + r.no)}


class State(NamedTuple):
    """The label model after a step; a voter's second weight is for rows in which its parent has voted, too."""

    prior: float
    weight: np.ndarray  # 2 x voters
    parent: np.ndarray  # of each voter, or -1


def _slots(votes: Votes, parent: np.ndarray) -> np.ndarray:
    if not (parent >= 0).any():
        return votes.voter
    of = parent[votes.voter]
    return votes.voter + votes.voters * ((of >= 0) & np.isin(votes.row * votes.voters + of, votes.row * votes.voters + votes.voter))


def _posterior(votes: Votes, state: State | None) -> np.ndarray:
    spoken = votes.by_row(np.ones(len(votes.row))) > 0
    if state is None:
        return np.where(spoken, 0.9, 0.02)
    p = sigmoid(np.clip(np.log(state.prior / (1 - state.prior)) + votes.by_row(state.weight[_slots(votes, state.parent)]), -12, 12))
    return np.where(spoken, p, np.minimum(p, 0.02))


def _counts(votes: Votes, state: State | None, parent: np.ndarray) -> np.ndarray:
    """For each of posterior, label and 1: its sum over all rows, and over the rows in which a voter has spoken without, and with, its parent."""
    slot, out = _slots(votes, parent), []
    for w in (_posterior(votes, state), votes.known, np.ones(votes.rows)):
        w = w * votes.times
        out.append(np.append(w.sum(), np.bincount(slot, w[votes.row], 2 * votes.voters)))
    return np.concatenate(out)


def _dependence(x: np.ndarray, y: np.ndarray, n: np.ndarray, seen: np.ndarray, toxic: np.ndarray, clean: np.ndarray, least: float = 0.15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Voter, rarer (more special) voter, and their dependence given the class, of the pairs where that is more than ``least``.

    It is the correlation of the two votes in what the class leaves unexplained.  ``toxic`` and
    ``clean`` are how much of the class there is, and each voter's rate in it.
    """
    swap = (seen[y] < seen[x]) | ((seen[y] == seen[x]) & (y < x))
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    each = [(c[0], c[1:][x], c[1:][y]) for c in (toxic, clean)]
    expected = sum(m * a * b for m, a, b in each)
    spread = np.sqrt(np.maximum(1e-9, sum(m * a * (1 - a) for m, a, _ in each) * sum(m * b * (1 - b) for m, _, b in each)))
    strength = (n - expected) / spread
    some = strength > least
    return y[some], x[some], strength[some]


def _label_model(votes: Votes | VotesTable, steps: int) -> tuple[State, np.ndarray, np.ndarray]:
    """The label model's last state, the voters' accuracies, and how often each has voted (the last number: of how many rows)."""
    v, state = votes.voters, None
    parent = np.full(v, -1)
    for turn in range(2):
        for step in range(steps + 1):
            posterior, label, one = votes.total(partial(_counts, state=state, parent=parent)).reshape(3, -1)
            if step == steps:
                break
            rates = []
            for w in (posterior + label, 2 * one - posterior - label):
                own = w[1 : v + 1] + w[v + 1 :]  # of parents: how often they have voted
                chance = np.concatenate((np.full(v, w[0]), np.where(parent >= 0, own[parent], 1.0)))
                chance[:v] -= np.where(parent >= 0, own[parent], 0)
                rates.append(np.clip((w[1:] + 0.1) / (np.maximum(chance, w[1:]) + 1), 1e-4, 1 - 1e-4))
            new = State(float(np.clip(posterior[0] / max(one[0], 1), 0.01, 0.5)), np.log(rates[0] / rates[1]), parent)
            still = state is not None and state.parent is parent and np.abs(new.weight - state.weight).max(initial=abs(new.prior - state.prior)) < 1e-7
            state = new
            if still:
                posterior, label, one = votes.total(partial(_counts, state=state, parent=parent)).reshape(3, -1)
                break
        seen = one[1 : v + 1] + one[v + 1 :]
        classes = [np.append(w[0], (w[1 : v + 1] + w[v + 1 :]) / max(w[0], 1e-9)) for w in (posterior, one - posterior)]
        if not turn:
            found = votes.parents(partial(_dependence, seen=seen, toxic=classes[0], clean=classes[1]))
            parent = parent.copy()
            for child, of in found:
                parent[child] = of
    return state, np.stack([c[1:] for c in classes], 1), np.append(seen, one[0])


def label_model(votes: Votes, known: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of "toxic" for each row, and the voters' accuracies.

    A voter that says nothing abstains.  First voters are taken as independent given the class;
    then each may depend on one other, and has accuracies of its own for when that one has voted
    too, so that voters which repeat each other add little.  The labels (``known``, 0 or 1) only
    enter as a prior of the accuracies, worth as many rows as there are; the posterior of a row
    does not see its own label.
    """
    votes = votes._replace(known=known)
    state, accuracy, _ = _label_model(votes, steps)
    return _posterior(votes, state), accuracy


def _loss(votes: Votes, w: np.ndarray, state: State) -> np.ndarray:
    z, target = votes.by_row(w[votes.voter]) + w[-1], _posterior(votes, state)
    rest = votes.times * (sigmoid(z) - target)
    return np.concatenate(([(votes.times * (np.logaddexp(0, z) - target * z)).sum()], votes.by_voter(rest), [rest.sum()]))


def linear(votes: Votes | VotesTable, state: State, seen: np.ndarray, penalty: float = 0.3, most: int = 200) -> np.ndarray:
    """Weights of a logistic regression of the posteriors on the votes, the last one constant: descent by the last ten gradients (L-BFGS).

    ``seen`` is how often each voter has voted, and of how many rows.
    """
    rate = 1 / (0.25 * seen + penalty)

    def at(w):
        got = votes.total(partial(_loss, w=w, state=state))
        free = np.append(w[:-1], 0)
        return got[0] + penalty / 2 * free @ free, got[1:] + penalty * free

    w = np.zeros(votes.voters + 1)
    w[-1] = np.log(state.prior / (1 - state.prior))
    (loss, slope), past = at(w), []
    for _ in range(most):
        if np.abs(rate * slope).max() < 1e-6:
            break
        step, shares = -slope, []
        for s, y in reversed(past):
            shares.append((s @ step) / (s @ y))
            step = step - shares[-1] * y
        step = step * rate * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ (rate * past[-1][1])) if past else 1)
        for (s, y), share in zip(past, reversed(shares), strict=True):
            step = step + (share - (y @ step) / (s @ y)) * s
        length, down = 1.0, slope @ step
        while (new := at(w + length * step))[0] > loss + 1e-4 * length * down + 1e-12 * abs(loss) and length > 1e-6:
            length /= 2
        s, y = length * step, new[1] - slope
        w, (loss, slope) = w + s, new
        past = [*past, (s, y)][-10:] if s @ y > 0 else []
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, always: tuple[str, ...] = (), steps: int = 40) -> Model:
    """Learn from all labelled rows for which ``learn`` holds.

    Labels choose the lexicon's entries and are a prior of the voters' accuracies; the classifier
    sees the label model's posteriors only.
    ``always`` are words that vote in any case.  Rows with the same votes and label are counted
    together; each step of the label model and of the classifier is a sum over that table, of
    which a few numbers a voter come to the driver.  Without labelled rows of both kinds the
    lexicon is ``always`` alone, and one of its words makes a text toxic.
    """
    rows = labelled(docs, labels, "toxic", learn)
    mined, sure = mine(rows)
    given = [w.lower() for w in always]
    lexicon = Lexicon.of(list(dict.fromkeys([*given, *mined])), sure | set(given))
    voters = lexicon.size + len(PATTERNS)
    if not mined:
        drop(rows)
        weights = np.full(voters + 1, 4.0)
        weights[-1] = -2.0
        return Model(lexicon, weights, np.zeros((0, 2)))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(bool(y)) for y in batch.column("label").to_pylist()], pa.int32()), pa.array([lexicon.votes(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["label", "votes"])

    counted = rows.mapInArrow(run, "label int, votes array<int>").groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n"))
    table = stage(counted.sortWithinPartitions("votes", "label"), "votes")
    votes = VotesTable(table, voters)
    state, accuracy, seen = _label_model(votes, steps)
    weights = linear(votes, state, seen)
    drop(rows, table)
    return Model(lexicon, weights, accuracy)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    Nothing is shuffled.  Null and empty texts have no votes and get the score of that; null ids
    and repeated rows pass through; very long texts are read whole; an empty table gives no rows;
    other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            p = np.array([model.score(t) for t in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which the text is not predicted toxic; nothing is shuffled.

    Each row is judged by its own text.  Null and empty texts stay.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keep = [not t or model.score(t) < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

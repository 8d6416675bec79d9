"""Operator 12: periodic runs of words by the runs theorem.

A run is a maximal stretch of words with a smallest period q. By the runs theorem each run has a Lyndon root that is the
longest Lyndon word at its place, for the order of words or for the reverse order. So the longest Lyndon word of every
place is taken under both orders, as the way to the next smaller (next greater) entry of the inverse suffix array, and is
extended forwards and backwards as far as its period lasts. Extensions are least common prefixes: a range minimum of the
LCP array by a sparse table, over the text for forwards, over the reversed text for backwards.

Texts of a batch are laid behind one another, each with an end mark below its words, and ranked text by text; so one
suffix array by prefix doubling, in which only places that aren't told apart yet are sorted again, serves them all.
A run of at least three periods holds a root from which it goes on for more than a period. Places without one are left
out before the reversed text is made, for the texts alone that still have a place.

A text is never cut: its work arrays take some 300 bytes a word in the task that has it.

Defined cases
* null, empty or wordless text: no words, no run; the hashes are those of the empty string;
* null doc_id: the text is left as it is (the contract makes periodic tails by doc_id);
* repeated rows are judged alike, each gives a row; empty table: empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import table

#: Texts share a suffix array until they have so many words; the text that reaches it is the last one, and whole.
BATCH_WORDS = 1 << 16


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places sorted by key, and of each place the number of the first place in that order with its key."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[order[1:]], keys[order[:-1]], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    rank = np.empty(len(keys), np.int64)
    rank[order] = first
    return order, rank


class Suffixes:
    """Suffix array, its inverse, the LCP array and its range minima, of texts laid behind one another.

    ``word`` has numbers from 1, and 0 as the end mark of each text; ``text`` is the number of the text, ascending.
    """

    def __init__(self, word: np.ndarray, text: np.ndarray):
        n = self.n = len(word)
        self.word = word
        order, rank = _ranked(text.astype(np.int64) * (int(word.max()) + 1) + word)
        levels, k = [rank], 1
        while True:
            sizes = np.bincount(rank, minlength=n)
            open_ = np.flatnonzero(sizes[rank] > 1)  # an end mark is alone, so i + k is inside of the text
            if not len(open_):
                break
            key = rank[open_] * n + rank[open_ + k]
            at, within = _ranked(key)
            places = open_[at]
            # the places of a group follow one another in ``at`` as they do in ``order``
            group = rank[places]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            base = np.repeat(starts, np.diff(np.append(starts, len(places))))
            order[group + np.arange(len(places)) - base] = places
            rank = rank.copy()
            rank[places] = group + within[at] - base
            levels.append(rank)
            k *= 2
        self.order, self.rank = order, rank
        self._minima(self._lcp(levels))

    def _lcp(self, levels: list[np.ndarray]) -> np.ndarray:
        """lcp[r]: words that the suffixes of rank r - 1 and r share; steps of 2 ** level from the largest down."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        out = np.zeros(self.n, np.int32)
        at = np.flatnonzero(levels[0][a] == levels[0][b])
        a, b, got = a[at], b[at], np.zeros(len(at), np.int32)
        for level in range(len(levels) - 1, -1, -1):
            same = levels[level][a] == levels[level][b]
            step = same.astype(np.int64) << level
            got += step.astype(np.int32)
            a += step
            b += step
        out[at + 1] = got
        return out

    def _minima(self, lcp: np.ndarray) -> None:
        self.table, k = [lcp], 1
        while 2 * k <= self.n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes of i and j share; i <> j."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << int(k))])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, else the length.

    Near ones by steps of one place; for the others, a descent over minima of 2 ** k places.
    """
    n = len(values)
    out = np.full(n, n, np.int64)
    open_ = np.arange(n)
    for step in range(1, 9):
        open_ = open_[open_ + step < n]
        found = values[open_ + step] < values[open_]
        out[open_[found]] = open_[found] + step
        open_ = open_[~found]
    if len(open_):
        minima, k = [values], 1
        while 2 * k <= n:
            minima.append(np.minimum(minima[-1][:-k], minima[-1][k:]))
            k *= 2
        at, mine = open_ + 9, values[open_]
        for level in [*range(len(minima)), *range(len(minima) - 1, -1, -1)]:  # steps up to the largest, and down
            m = minima[level]
            fits = at < len(m)
            fits[fits] = m[at[fits]] > mine[fits]
            at = at + (fits.astype(np.int64) << level)
        out[open_] = np.minimum(at, n)
    return out


def runs_of(words: list[np.ndarray], shortest: int = 24, periods: int = 3) -> list[np.ndarray]:
    """For each text, given as word numbers from 1, the rows (start, length, period) of its runs, by start and period.

    Runs have at least ``shortest`` words and at least ``periods`` (2 or more) periods.
    """
    out = [np.empty((0, 3), np.int64)] * len(words)
    sizes = np.array([len(w) + 1 for w in words])
    if not len(words) or sizes.max() == 1:
        return out
    word = np.concatenate([x for w in words for x in (w, np.zeros(1, np.int64))])
    text = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    ends = (starts + sizes - 1)[text]  # of the end mark
    suffixes = Suffixes(word, text)
    i, j = [], []
    for rank in (suffixes.rank, -suffixes.rank):
        after = next_smaller(rank)
        at = np.flatnonzero(after < ends)  # a word up to the end mark has no next period to go on with
        at = at[word[at] == word[after[at]]]
        i.append(at)
        j.append(after[at])
    i, j = np.concatenate(i), np.concatenate(j)
    period = j - i
    forwards = suffixes.common(i, j)
    # of the first root in a run less than a period of it lies in front
    long_ = period + forwards > np.maximum(shortest, periods * period) - period
    i, j, period, forwards = i[long_], j[long_], period[long_], forwards[long_]
    if not len(i):
        return out
    kept, which = np.unique(text[i], return_inverse=True)
    back = [x for t in kept for x in (words[t][::-1], np.zeros(1, np.int64))]
    back_ends = np.cumsum(sizes[kept]) - 1
    reverse = Suffixes(np.concatenate(back), np.repeat(np.arange(len(kept)), sizes[kept]))
    # place x of a text ends, reversed, where x places are left in front of the end mark
    left, right = i - starts[text[i]], j - starts[text[j]]
    backwards = reverse.common(back_ends[which] - left, back_ends[which] - right)
    start, length = left - backwards, backwards + period + forwards
    found = np.stack([text[i], start, length, period], 1)[length >= np.maximum(shortest, periods * period)]
    found = np.unique(found, axis=0)
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    for t in np.unique(found[:, 0]):
        out[t] = found[found[:, 0] == t, 1:]
    return out


def with_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's words: the texts of one doc_id in ten get a periodic tail."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


RUNS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_runs", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "period", "exponent_milli")],
                     T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("collapsed", T.StringType())])


def _found(tail: bool, texts: bool):
    """``tail``: with the contract's periodic tails; ``texts``: with the runs and the texts less their repeats, else null."""

    def rows(ids: list, docs: list[list[bytes]]):
        numbers: dict[bytes, int] = {}
        coded = [np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in doc), np.int64, len(doc)) for doc in docs]
        for doc_id, doc, runs in zip(ids, docs, runs_of(coded)):
            best, kept = (None, None, None, None), doc
            if len(runs):
                dropped = np.zeros(len(doc) + 1, np.int64)
                np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
                np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
                kept = [w for w, d in zip(doc, np.cumsum(dropped).tolist()) if not d]
                runs = runs.tolist()
                start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                best = (start, length, period, 1000 * length // period)
            told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            collapsed = b" ".join(kept)
            hashes = hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()
            more = ([list(r) for r in runs], collapsed.decode("utf-8", "surrogatepass")) if texts else (None, None)
            yield (doc_id, len(runs), *best, *hashes, *more)

    def told_of(ids: list, docs: list[list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows(ids, docs)), kinds)], names=RUNS.names)

    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.list_(pa.int64())), pa.string()]

    def run(batches):
        for batch in batches:
            ids, docs, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                doc_id = doc_id.as_py()
                words = (text.as_py() or b"").split()  # bytes.split knows ASCII white space alone
                ids.append(doc_id)
                docs.append(with_tail(words, doc_id) if tail else words)
                held += len(words) + 1
                if held >= BATCH_WORDS:
                    yield told_of(ids, docs)
                    ids, docs, held = [], [], 0
            if ids:
                yield told_of(ids, docs)

    return run


def word_runs(docs: DataFrame, tail: bool = False, texts: bool = True) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text, any more): its runs of words as (start, length, period), the run of the greatest
    exponent, the text less the repeats of every run, and the hashes of both; ``texts=False`` leaves runs and text null."""
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(_found(tail, texts), RUNS)


def op12_word_runs(spark, sf_dir: str) -> DataFrame:
    return word_runs(table(spark, sf_dir, "documents"), tail=True, texts=False).drop("runs", "collapsed")

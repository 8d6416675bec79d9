"""Operator 3: quality classifier, an interpolated modified Kneser-Ney model of words trained on trusted text.

The model is a bigram model over an open vocabulary. A word is any run of letters, marks or digits (20 at most, then
the next begins), or one character where a script has no spaces, or one sign; case counts; a text ends with an end
mark. Half of the trusted documents (by hash of doc_id) train the model, the other half set the thresholds.

Interpolation makes a text's log-probability a sum over its n-grams, each with a value of its own:

    log P(text) = sum over words of [unseen + seen(word) + weight(word)] + sum over pairs of pair(a, b)
    seen(b)    = log P1(b) - unseen              (0 for a word that training hasn't got)
    weight(a)  = log gamma(a)                    (0 for a context that training hasn't got)
    pair(a, b) = log P2(b | a) - log gamma(a) - log P1(b) = log(1 + (c - d) / (D(a) * P1(b)))   (0 if not seen)

D(a) = d1 m1 + d2 m2 + d3 m3 of the context and P1 comes from continuation counts, with discounts from the counts of
counts. So counts and values are tables sharded by n-gram (packed arrays, a row for each shard), every document's
n-grams, counted within a task first, are joined with them by shard, and sums go back to the documents. Documents are
joined in ``blocks`` rounds, so the shuffle holds a part of the postings at a time. The n-grams that are commonest in a
bounded sample of all documents (``hot`` at most) travel with the tasks, so no shard gets a posting of each document.

Perplexity is a word's. A text is kept up to a high quantile of the held-out trusted texts of its language and length
(a power of two of words); where those are under ``least``, of its language, then of its length, then of all. There is
no low quantile: the trained half, known by heart, would fall under it, and repetition doesn't (its pairs are unseen).

Defined cases
* null or empty text, or one of white space alone: perplexity null, rejected (nothing to keep);
* null language: a language of its own; no trusted text in the training half: everything with a word is kept; none in
  the other half: no thresholds;
* a document with several labels is trusted only if all of them are good; null labels don't count;
* rows are judged alone (repeated rows alike, rows of one doc_id by their own texts); empty table: empty result.
N-grams are keyed by 54 bits of hash, texts by 128 bits.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, forget, fresh, given_back, joined_blocks, small_slices, stored, without

_U = np.uint64
MAX_WORD = 20
#: Characters handled at once, and documents and characters of a chunk at most.
PIECE, CHUNK_DOCS, CHUNK_CHARS = 250_000, 1024, 2_000_000
#: The low bits of a key are left free for a document's place in its chunk: 54 bits tell n-grams apart.
_PLACE = _U(CHUNK_DOCS - 1)
START, END = _U(0x5354415254) << _U(20), _U(0x454E44) << _U(20)
#: Scripts without spaces: each character is a word.
_SINGLE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _U(0x9E3779B97F4A7C15) + b + _U(0x632BE59BD9B4E019)) & ~_PLACE


class Splitter:
    """Cuts many texts into words and hashes these, by arrays of characters."""

    def __init__(self):
        kind = np.zeros(0x110000, np.uint8)  # 0 white space, 1 part of a word, 2 a word alone
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalnum() or unicodedata.category(c)[0] == "M":
                kind[cp] = 1
            elif not c.isspace():
                kind[cp] = 2
        for a, b in _SINGLE:
            kind[a : b + 1][kind[a : b + 1] == 1] = 2
        self.kind = kind
        self.value = _mix(np.arange(0x110000, dtype=np.uint64) + _U(0x9E3779B97F4A7C15))
        p, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        self.power = np.cumprod(np.concatenate([np.ones(1, _U), np.full(PIECE, p, _U)]))
        self.inverse = np.cumprod(np.concatenate([np.ones(1, _U), np.full(PIECE, inverse, _U)]))

    def piece(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of each word of a text of at most PIECE characters."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind, n = self.kind[chars], len(chars)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind == 1
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, size = edges[::2], edges[1::2] - edges[::2]
        parts = -(-size // MAX_WORD)
        if len(parts) and parts.max() > 1:  # long words in parts
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, size = np.repeat(start, parts) + nth * MAX_WORD, np.repeat(size, parts) - nth * MAX_WORD
            size = np.minimum(size, MAX_WORD)
        both = np.sort(np.concatenate([start << 5 | size, np.flatnonzero(kind == 2) << 5 | 1]))
        start, end = both >> 5, (both >> 5) + (both & 31)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.value[chars] * self.power[:n], out=sums[1:])
        return _mix((sums[end] - sums[start]) * self.inverse[start]) & ~_PLACE, start

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, number of words of each text)."""
        words, counts, at = [], np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            if len(texts[at]) > PIECE:
                text, lo = texts[at], 0
                while lo < len(text):
                    hi = lo + PIECE
                    if hi < len(text):  # between words if there is a space
                        cut = max(text.rfind(" ", lo, hi), text.rfind("\n", lo, hi))
                        hi = cut if cut > lo else hi
                    words.append(self.piece(text[lo:hi])[0])
                    counts[at] += len(words[-1])
                    lo = hi
                at += 1
                continue
            to, size = at, 0
            while to < len(texts) and size + len(texts[to]) + 1 <= PIECE + 1:
                size += len(texts[to]) + 1
                to += 1
            w, place = self.piece("\n".join(texts[at:to]))
            ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
            counts[at:to] = np.diff(np.searchsorted(place, ends), prepend=0)
            words.append(w)
            at = to
        return np.concatenate(words) if words else np.empty(0, _U), counts


_SPLITTER: list[Splitter] = []


def splitter() -> Splitter:
    if not _SPLITTER:
        _SPLITTER.append(Splitter())
    return _SPLITTER[0]


def pairs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(before, word, text) of each word and end mark, texts in order; and the number of words of each text."""
    w, n = splitter()(texts)
    total = len(w) + len(n)
    after = np.cumsum(n + 1) - 1  # places of the end marks
    word = np.empty(total, _U)
    is_end = np.zeros(total, bool)
    is_end[after] = True
    word[is_end], word[~is_end] = END, w
    before = np.empty(total, _U)
    before[1:] = word[:-1]
    before[np.concatenate([[0], after[:-1] + 1]).astype(np.int64)] = START
    return before, word, np.repeat(np.arange(len(n)), n + 1), n


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the high bits, so sorted keys are sorted by shard."""
    return ((keys >> _U(32)) * _U(shards)) >> _U(32)


def cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted keys, and the end."""
    return np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))


def chunks(batches, texts: int):
    """(batch, texts) of chunks within CHUNK_DOCS and CHUNK_CHARS; a longer text is a chunk of its own."""
    for batch in given_back(small_slices(batches, CHUNK_DOCS)):
        all_texts = [t or "" for t in batch.column(texts).to_pylist()]
        at = size = 0
        for i, t in enumerate(all_texts):
            if i > at and size + len(t) > CHUNK_CHARS:
                yield batch.slice(at, i - at), all_texts[at:i]
                at, size = i, 0
            size += len(t)
        if len(all_texts) > at:
            yield batch.slice(at), all_texts[at:]


def _array(cell: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def merged_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs with their summed counts, ordered by key."""
    _, at, of = np.unique(pair_key(a, b), return_index=True, return_inverse=True)
    return a[at], b[at], np.bincount(of, weights=n, minlength=len(at)).astype(np.int64)


def _count_pairs(shards: int):
    def run(batches):
        for _, texts in chunks(batches, 0):
            before, word, _, _ = pairs_of(texts)
            a, b, n = merged_pairs(before, word, np.ones(len(word)))
            at = cuts(pair_key(a, b), shards)
            rows = [(s, a[i:j].tobytes(), b[i:j].tobytes(), n[i:j].tobytes()) for s, (i, j) in enumerate(zip(at, at[1:])) if j > i]
            yield _batch(["shard", "a", "b", "n"], [pa.int64()] + [pa.binary()] * 3, rows)

    return run


_PAIRS = "shard long, a binary, b binary, n binary, n1 long, n2 long, n3 long, n4 long"


def _merge_pairs(table: pa.Table) -> pa.Table:
    a, b, n = (np.concatenate([_array(x, k) for x in table[c]]) for c, k in (("a", _U), ("b", _U), ("n", np.int64)))
    a, b, n = merged_pairs(a, b, n)
    of = [int((n == k).sum()) for k in (1, 2, 3, 4)]
    return pa.table({"shard": [table["shard"][0].as_py()], "a": [a.tobytes()], "b": [b.tobytes()], "n": [n.tobytes()], **{f"n{k}": [x] for k, x in zip((1, 2, 3, 4), of)}}, schema=_PAIRS_ARROW)


_PAIRS_ARROW = pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in "abn"], *[(f"n{k}", pa.int64()) for k in (1, 2, 3, 4)]])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from counts of counts."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(raw, 1))


def discount(n: np.ndarray, d: tuple) -> np.ndarray:
    return np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))


#: Of each word: what is discounted from it as a context, its count as a context, and its different words before.
_STATS = "home long, shard long, w binary, taken binary, total binary, follows binary"


def _word_stats(shards: int, d: tuple):
    """From shards of pairs, the share that each has in the numbers of its words, by the words' own shards."""

    def run(batches):
        for batch in batches:
            rows = []
            for shard, a, b, n in zip(*(batch.column(i) for i in range(4))):
                a, b, n = _array(a, _U), _array(b, _U), _array(n, np.int64)
                words, of = np.unique(np.concatenate([a, b]), return_inverse=True)
                left, right = of[: len(a)], of[len(a) :]
                taken = np.bincount(left, weights=discount(n, d), minlength=len(words))
                total = np.bincount(left, weights=n, minlength=len(words))
                follows = np.bincount(right, minlength=len(words)).astype(np.int64)
                at = cuts(words, shards)
                rows += [(h, shard.as_py(), words[i:j].tobytes(), taken[i:j].tobytes(), total[i:j].tobytes(), follows[i:j].tobytes()) for h, (i, j) in enumerate(zip(at, at[1:])) if j > i]
            yield _batch(["home", "shard", "w", "taken", "total", "follows"], [pa.int64()] * 2 + [pa.binary()] * 4, rows)

    return run


#: ``kind`` 0: numbers for a shard of pairs; 1: the words of a home themselves.
_ANSWERS = "kind long, shard long, w binary, taken binary, total binary, follows binary, n1 long, n2 long, n3 long, n4 long, words long, pairs long"
_ANSWERS_ARROW = pa.schema([("kind", pa.int64()), ("shard", pa.int64()), *[(c, pa.binary()) for c in ("w", "taken", "total", "follows")], *[(c, pa.int64()) for c in ("n1", "n2", "n3", "n4", "words", "pairs")]])


def _answer(table: pa.Table) -> pa.Table:
    """Sums each word's numbers over all shards, and sends them to each shard that has the word."""
    parts = [[_array(x, k) for x in table[c]] for c, k in (("w", _U), ("taken", float), ("total", float), ("follows", np.int64))]
    words, of = np.unique(np.concatenate(parts[0]), return_inverse=True)
    taken, total, follows = (np.bincount(of, weights=np.concatenate(p), minlength=len(words)) for p in parts[1:])
    rows, at = [], 0
    for shard, w in zip(table["shard"].to_pylist(), parts[0]):
        i = of[at : at + len(w)]
        rows.append((0, shard, w.tobytes(), taken[i].tobytes(), b"", follows[i].tobytes(), 0, 0, 0, 0, 0, 0))
        at += len(w)
    seen = follows > 0
    of_counts = [int((follows == k).sum()) for k in (1, 2, 3, 4)]
    rows.append((1, table["home"][0].as_py(), words.tobytes(), taken.tobytes(), total.tobytes(), follows.tobytes(), *of_counts, int(seen.sum()), int(follows.sum())))
    return pa.Table.from_batches([_batch(_ANSWERS_ARROW.names, _ANSWERS_ARROW.types, rows)], schema=_ANSWERS_ARROW)


class Unigrams:
    """P1 of a word by its number of different words before it, with an even share for each unseen word."""

    def __init__(self, d: tuple, words: int, pairs: int, n: tuple):
        n3 = words - n[0] - n[1]
        self.d, self.pairs = d, pairs
        self.floor = (d[0] * n[0] + d[1] * n[1] + d[2] * n3) / pairs / (words + 1)

    def __call__(self, follows: np.ndarray) -> np.ndarray:
        return np.where(follows > 0, (follows - discount(follows, self.d)) / self.pairs, 0.0) + self.floor


_MODEL = "shard long, keys binary, vals binary"
_MODEL_ARROW = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary())])


def _model_row(shard: int, keys: np.ndarray, vals: np.ndarray) -> pa.Table:
    order = np.argsort(keys)
    return pa.table({"shard": [shard], "keys": [keys[order].tobytes()], "vals": [vals[order].astype(np.float32).tobytes()]}, schema=_MODEL_ARROW)


def _pair_values(d: tuple, uni: Unigrams):
    def run(pairs: pa.Table, answers: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return _MODEL_ARROW.empty_table()
        a, b, n = (np.concatenate([_array(x, k) for x in pairs[c]]) for c, k in (("a", _U), ("b", _U), ("n", np.int64)))
        w, taken, follows = (np.concatenate([_array(x, k) for x in answers[c]]) for c, k in (("w", _U), ("taken", float), ("follows", float)))
        order = np.argsort(w)
        w, taken, follows = w[order], taken[order], follows[order]
        i, j = np.searchsorted(w, a), np.searchsorted(w, b)
        return _model_row(pairs["shard"][0].as_py(), pair_key(a, b), np.log1p((n - discount(n, d)) / (taken[i] * uni(follows[j]))))

    return run


def _word_values(uni: Unigrams, shards: int):
    """seen(word) + weight(word); their shards follow those of the pairs."""

    def run(batches):
        for batch in batches:
            for shard, w, taken, total, follows in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("shard", "w", "taken", "total", "follows"))):
                w, taken, total, follows = _array(w, _U), _array(taken, float), _array(total, float), _array(follows, float)
                vals = np.log(uni(follows) / uni.floor) + np.log(np.where(total > 0, taken, 1.0) / np.where(total > 0, total, 1.0))
                yield from _model_row(shard.as_py() + shards, w, vals).to_batches()

    return run


class WordModel:
    """Values of pairs and words trained on ``trusted`` (text), as a table of ``shards`` shards each."""

    def __init__(self, trusted: DataFrame, shards: int):
        self.shards = shards
        counted = trusted.mapInArrow(_count_pairs(shards), "shard long, a binary, b binary, n binary")
        pairs = stored(counted.groupBy("shard").applyInArrow(_merge_pairs, _PAIRS), "lm-pairs")
        of = pairs.agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)]).first()
        self.empty = of[0] is None
        if self.empty:
            return
        d2 = discounts(*of)
        stats = pairs.select("shard", "a", "b", "n").mapInArrow(_word_stats(shards, d2), _STATS)
        answers = stored(stats.groupBy("home").applyInArrow(_answer, _ANSWERS), "lm-words")
        of = answers.agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4", "words", "pairs")]).first()
        self.unigrams = Unigrams(discounts(*of[:4]), of[4], of[5], of[:4])
        own = answers.where("kind = 0").select("shard", "w", "taken", "follows")
        two = pairs.select("shard", "a", "b", "n").groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(_pair_values(d2, self.unigrams), _MODEL)
        one = answers.where("kind = 1").mapInArrow(_word_values(self.unigrams, shards), _MODEL)
        self.table = stored(two.unionByName(one), "lm-model")
        forget(pairs)
        forget(answers)

    def hottest(self, sample: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and values of the at most ``hot`` n-grams that are in most texts of ``sample`` (text)."""

        def keys(batches):
            for _, texts in chunks(batches, 0):
                before, word, text, _ = pairs_of(texts)
                for k in (pair_key(before, word), word):
                    k, n = np.unique(np.unique(k | text.astype(_U)) & ~_PLACE, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "n"])

        found = sample.mapInArrow(keys, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "k").limit(hot).toArrow()
        wanted = np.sort(found["k"].to_numpy().view(_U))
        shared = sample.sparkSession.sparkContext.broadcast(wanted)

        def values(batches):
            for batch in batches:
                for k, v in zip(batch.column(0), batch.column(1)):
                    k, v = _array(k, _U), _array(v, np.float32)
                    mine = np.flatnonzero(np.isin(k, shared.value))
                    yield pa.RecordBatch.from_arrays([pa.array(k[mine].view(np.int64)), pa.array(v[mine].astype(float))], names=["k", "v"])

        had = self.table.select("keys", "vals").mapInArrow(values, "k long, v double").toArrow()  # ``hot`` rows at most
        value = np.zeros(len(wanted))
        value[np.searchsorted(wanted, had["k"].to_numpy().view(_U))] = had["v"].to_numpy()
        return wanted, value

    def scores(self, docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], blocks: int) -> DataFrame:
        """(doc_id, lang, t1, t2, n_words, log_probability) of each row of ``docs`` (doc_id, lang, t1, t2, text)."""
        shared = docs.sparkSession.sparkContext.broadcast(hot)
        unseen = float(np.log(self.unigrams.floor))

        def part(b: int) -> DataFrame:
            mine = docs.where(F.pmod(F.xxhash64("doc_id", "t1"), F.lit(blocks)) == b)
            posted = mine.mapInArrow(_postings(self.shards, shared, unseen), _POSTED)
            summed = posted.groupBy("shard").cogroup(self.table.groupBy("shard")).applyInArrow(_sums, _SUMMED)
            return summed.groupBy("chunk").applyInArrow(_by_document, _SCORED)

        return joined_blocks([lambda b=b: part(b) for b in range(blocks)], "lm-scores")


_POSTED = "shard long, chunk long, keys binary, reps binary, places binary, ids binary, langs array<string>, base binary"
_POSTED_ARROW = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("keys", "reps", "places", "ids")], ("langs", pa.list_(pa.string())), ("base", pa.binary())])


def _postings(shards: int, shared, unseen: float):
    """Rows of documents to rows of a chunk's n-grams for each shard: keys, occurrences, and the document of each."""

    def run(batches):
        hot_keys, hot_values = shared.value
        count = 0
        for batch, texts in chunks(batches, 4):
            before, word, text, n = pairs_of(texts)
            base = np.bincount(text, minlength=len(n)).astype(float) * unseen
            chunk = TaskContext.get().partitionId() << 32 | count
            count += 1
            rows = []
            for role, keys in enumerate((pair_key(before, word), np.concatenate([word, np.full(len(n), START)]))):  # the start mark is a context once in each text
                place = text if role == 0 else np.concatenate([text, np.arange(len(n))])
                both = np.sort(keys | place.astype(_U))
                keys = both & ~_PLACE
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                reps = np.diff(first, append=len(keys))
                different = keys[first]
                place = (both & _PLACE).astype(np.uint16)
                if len(hot_keys):
                    at = np.minimum(np.searchsorted(hot_keys, different), len(hot_keys) - 1)
                    is_hot = hot_keys[at] == different
                    each = np.repeat(is_hot, reps)
                    base += np.bincount(place[each], weights=np.repeat(hot_values[at[is_hot]], reps[is_hot]), minlength=len(n))
                    different, reps, place = different[~is_hot], reps[~is_hot], place[~each]
                ends = np.concatenate([[0], np.cumsum(reps)])
                reps = reps.astype(np.uint32)
                at = cuts(different, shards)
                rows += [
                    (s + role * shards, chunk, different[i:j].tobytes(), reps[i:j].tobytes(), place[ends[i] : ends[j]].tobytes(), None, None, None)
                    for s, (i, j) in enumerate(zip(at, at[1:])) if j > i
                ]
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3)]
            null = np.array([not x.is_valid for x in batch.column(0)])
            ids = np.stack([np.where(null, 0, columns[0]).astype(np.int64), null.astype(np.int64), columns[1], columns[2], n])
            rows.append((chunk % (2 * shards), chunk, None, None, None, ids.tobytes(), batch.column(1).to_pylist(), base.tobytes()))
            yield _batch(_POSTED_ARROW.names, _POSTED_ARROW.types, rows)

    return run


_SUMMED = "chunk long, places binary, sums binary, ids binary, langs array<string>, base binary"
_SUMMED_ARROW = pa.schema([("chunk", pa.int64()), *[(c, pa.binary()) for c in ("places", "sums", "ids")], ("langs", pa.list_(pa.string())), ("base", pa.binary())])


def _sums(posted: pa.Table, model: pa.Table) -> pa.Table:
    """What one shard's values add to the documents of each chunk."""
    rows = []
    keys = _array(model["keys"][0], _U) if model.num_rows else np.zeros(1, _U)
    vals = _array(model["vals"][0], np.float32) if model.num_rows else np.zeros(1, np.float32)
    for chunk, mine, reps, places, ids, langs, base in zip(*(posted[c] for c in _POSTED_ARROW.names[1:])):
        if ids.is_valid:
            rows.append((chunk.as_py(), None, None, ids.as_py(), langs.as_py(), base.as_py()))
            continue
        mine, reps, places = _array(mine, _U), _array(reps, np.uint32), _array(places, np.uint16)
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        value = np.where(keys[at] == mine, vals[at], np.float32(0))
        sums = np.bincount(places, weights=np.repeat(value, reps))
        there = np.flatnonzero(sums)
        rows.append((chunk.as_py(), there.astype(np.uint16).tobytes(), sums[there].tobytes(), None, None, None))
    return pa.Table.from_batches([_batch(_SUMMED_ARROW.names, _SUMMED_ARROW.types, rows)], schema=_SUMMED_ARROW)


_SCORED = "doc_id long, lang string, t1 long, t2 long, n_words long, log_probability double"


def _by_document(table: pa.Table) -> pa.Table:
    at = next(i for i, x in enumerate(table["ids"]) if x.is_valid)
    total = _array(table["base"][at], float).copy()
    order = sorted((i for i in range(table.num_rows) if i != at), key=lambda i: (table["sums"][i].as_buffer().size, table["places"][i].as_py(), table["sums"][i].as_py()))
    for i in order:  # one order of addition, whatever order the rows came in
        total[_array(table["places"][i], np.uint16)] += _array(table["sums"][i], float)
    ids = _array(table["ids"][at], np.int64).reshape(5, -1)
    return pa.table(
        [pa.array(ids[0], mask=ids[1] == 1), table["langs"][at].values, pa.array(ids[2]), pa.array(ids[3]), pa.array(ids[4]), pa.array(total)],
        names=["doc_id", "lang", "t1", "t2", "n_words", "log_probability"],
    )


def _trusted(labels: DataFrame) -> DataFrame:
    """Ids of the documents whose labels are all good and not toxic."""
    good = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"), (F.max(F.coalesce("toxic", F.lit(0))) > 0).alias("toxic"))
    return good.where("good and not toxic").select("doc_id")


class Judge:
    """A model trained on the trusted half of ``docs``, and thresholds by language and length from the other half.

    ``labels`` (doc_id, quality, toxic): a document is trusted if its quality is over 0 and it isn't toxic.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, quantile: float = 0.99, least: int = 100, blocks: int = 6, hot: int = 50_000, sample: int = 5_000):
        self.blocks, self.hot, self.sample = blocks, hot, sample
        good = _trusted(labels).hint("merge")  # the same plan at every size
        own = docs.select("doc_id", "text").where(self._fold() == 0).where("text is not null and text <> ''")
        trusted = stored(own.join(good, "doc_id", "left_semi").select("text"), "lm-trusted")
        chars = trusted.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        self.rows, all_chars = docs.agg(F.count(F.lit(1)), F.sum(F.length("text").cast("long"))).first()
        least_shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.shards = max(least_shards, chars // 6_000_000, (all_chars or 0) // (blocks * 50_000_000))
        self.model = WordModel(trusted, self.shards)
        forget(trusted)
        if self.model.empty:
            return
        self.docs, self.scored = docs, self._scores(docs)
        held = self.scored.where("n_words > 0").where(self._fold() == 1).join(good, "doc_id", "left_semi").select("lang", self._length(), self._perplexity().alias("p"))
        held = stored(held, "lm-held")
        mark = F.percentile_approx("p", quantile, 10_000).alias("mark")
        limits = lambda name, *by: stored(held.groupBy(*by).agg(mark, F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*by, F.col("mark").alias(name)), "lm-limits")
        self.cells, self.langs, self.lengths = limits("of_cell", "lang", "length"), limits("of_lang", "lang"), limits("of_length", "length")
        self.overall = held.agg(mark).first()[0]

    @staticmethod
    def _fold():
        return F.pmod(F.xxhash64("doc_id"), F.lit(2))

    @staticmethod
    def _length():
        return F.floor(F.log2(F.col("n_words") + 1)).cast("int").alias("length")

    @staticmethod
    def _perplexity():
        return F.exp(-F.col("log_probability") / (F.col("n_words") + 1))

    @staticmethod
    def _keys():
        return F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2")

    def _scores(self, docs: DataFrame) -> DataFrame:
        core = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), *self._keys(), "text")
        share = min(1.0, self.sample / max(self.rows, 1))
        sample = core.where(F.pmod(F.xxhash64("doc_id", "t1", "t2"), F.lit(1_000_000)) < round(share * 1_000_000)).select("text")
        hot = self.model.hottest(sample, self.hot)
        return self.model.scores(core, hot, self.blocks)

    def _judged(self, scored: DataFrame) -> DataFrame:
        out = scored.withColumns({"length": self._length(), "perplexity": F.when(F.col("n_words") > 0, self._perplexity())})
        out = out.join(self.cells, ["lang", "length"], "left").join(self.langs, "lang", "left").join(self.lengths, "length", "left")
        limit = F.coalesce("of_cell", "of_lang", "of_length", F.lit(float("inf") if self.overall is None else self.overall))
        out = out.withColumn("threshold", limit).drop("length", "of_cell", "of_lang", "of_length")
        return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))

    def verdicts(self) -> DataFrame:
        """(doc_id, lang, n_words, perplexity, threshold, kept) of the documents judged by, without their texts."""
        return self._judged(self.scored).select("doc_id", "lang", "n_words", "perplexity", "threshold", "kept")

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with n_words, perplexity, threshold and kept."""
        names = ["n_words", "perplexity", "threshold", "kept"]
        rest = without(docs, *names)
        if self.model.empty:

            def count(batches):
                for batch in small_slices(batches, 500):
                    n = splitter()([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])[1]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, "n_words"])

            found = rest.mapInArrow(count, fields(rest, ("n_words", T.LongType())))
            return found.withColumns({c: F.lit(None).cast("double") for c in names[1:3]}).withColumn("kept", F.col("n_words") > 0)
        scored = self.scored if docs is self.docs else self._scores(rest)
        verdicts = self._judged(scored).select("t1", "t2", "lang", *names).dropDuplicates(["t1", "t2", "lang"])
        keyed, right, on = self._by_text(rest, verdicts, names)
        return keyed.join(right.hint("merge"), on, "left").select(*[F.col(f"`{c}`") for c in rest.columns], *names)

    def _by_text(self, docs: DataFrame, verdicts: DataFrame, names: list[str]) -> tuple:
        """Both tables with the keys of a text under names of their own, and the condition that joins them."""
        left, right = fresh(docs, "__t1", "__t2", "__lang"), fresh(docs, "__v1", "__v2", "__vlang")
        keyed = docs.withColumns(dict(zip(left, (*self._keys(), F.coalesce("lang", F.lit(""))))))
        verdicts = verdicts.select(*[F.col(c).alias(r) for c, r in zip(("t1", "t2", "lang"), right)], *names)
        return keyed, verdicts, reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in zip(left, right)])


def judge(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """``docs`` (doc_id, text, lang, any more) with n_words, perplexity, threshold and kept."""
    return Judge(docs, labels, **limits).score(docs)


def drop_rejected(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """``docs`` less those that the classifier rejects."""
    found = Judge(docs, labels, **limits)
    if found.model.empty:
        return found.score(docs).where("kept").select(*docs.columns)
    good = found._judged(found.scored).where("kept").select("t1", "t2", "lang").distinct()
    keyed, right, on = found._by_text(docs, good, [])
    return keyed.join(right.hint("merge"), on, "left_semi").select(*docs.columns)


def op3_quality_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = Judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = found.score(docs) if found.model.empty else found.verdicts()
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", "kept")

"""Operator 4: language identification by a linear-chain conditional random field over words.

Every word has features: the word, its prefixes and suffixes of 1 to 3 bytes, its 3-grams of bytes and the language
whose lexicon uses it most; the field learns their weights and the transitions between languages. Forward-backward
gives each word a probability for each language, so runs of code-switched text are found; a document's language is
the one with the largest mean probability over its words, that mean is the score.

The lexicons count the words of all training documents (Spark sums; words under 1e-4 of a language's words go, so
a lexicon has 10,000 words at most). The weights are fitted on a bounded sample: about ``per_lang`` documents a
language, ``windows`` windows of 32 words each, half of them spliced from several languages to show switches.

Long chains are exact, without a step for each word: words are cut into blocks of 64, the blocks' transfer matrices
are multiplied for all blocks at once, then carried from block to block, then unrolled inside all blocks at once.

Defined cases
* null text, or a text without a letter: 'und', score 0; no training document at all: every text is 'und';
* equal means: the language that sorts first; null language or text: not trained on;
* a word is a run of letters, lower-cased; digits, marks and symbols are skipped;
* null doc_id: not held out, and not trained on, as its part isn't known;
* rows are judged alone, from the text only (repeated rows alike); empty table: empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, small_slices, stored, with_columns, without

_WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
BLOCK = 64
WINDOW = 32


def words_of(text: str | None) -> list[str]:
    return [w for w in _WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def features(word: str, lexicon: dict[str, str]) -> list[int]:
    """Numbers of a word's features, 1 to BUCKETS - 1; long words are looked at whole."""
    raw = b"^" + word.encode("utf-8", "surrogatepass") + b"$"
    names = {raw, raw[:2], raw[:3], raw[:4], raw[-2:], raw[-3:], raw[-4:], *(raw[i : i + 3] for i in range(1, len(raw) - 3))}
    if word in lexicon:
        names.add(b"l" + lexicon[word].encode())
    crc = zlib.crc32
    return [crc(n) % (BUCKETS - 1) + 1 for n in names]


class Field:
    """Weights of a trained field and what a worker remembers of words."""

    def __init__(self, langs: list[str], lexicon: dict[str, str]):
        self.langs, self.lexicon = langs, lexicon
        self.w = np.zeros((BUCKETS, len(langs)), np.float32)
        self.t = np.zeros((len(langs), len(langs)), np.float64)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs)), np.float32)

    def __getstate__(self):
        return self.langs, self.lexicon, self.w, self.t

    def __setstate__(self, state):
        self.langs, self.lexicon, self.w, self.t = state
        self.known, self.rows = {}, np.zeros((1024, len(self.langs)), np.float32)

    def emissions(self, words: list[str], most: int = 600_000) -> np.ndarray:
        """A row of language scores for each word."""
        if len(self.known) > most:
            self.known.clear()
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            first = len(known)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            found = [features(w, self.lexicon) for w in new]
            starts = np.cumsum([0, *map(len, found)])[:-1]
            flat = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
            self.rows[first : first + len(new)] = np.add.reduceat(self.w[flat], starts, axis=0)
            known.update(zip(new, range(first, first + len(new))))
        return self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].astype(np.float64)

    def fit(self, sequences: list[list[str]], labels: list[np.ndarray], epochs: int = 8, batch: int = 128, rate: float = 0.2, seed: int = 3) -> None:
        """Maximum likelihood by AdaGrad; sequences have WINDOW words at most."""
        types = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        feats = [features(w, self.lexicon) for w in types]
        wide = np.zeros((len(types), max(map(len, feats))), np.int64)  # 0: no feature
        for i, f in enumerate(feats):
            wide[i, : len(f)] = f
        n, k = len(sequences), len(self.langs)
        x, y, on = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
        for i, (s, l) in enumerate(zip(sequences, labels)):
            x[i, : len(s)] = [types[w] for w in s]
            y[i, : len(s)] = l
            on[i, : len(s)] = True
        w, t = self.w.astype(np.float64), self.t
        gw2, gt2 = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                b = order[at : at + batch]
                used, inv = np.unique(x[b], return_inverse=True)
                e = w[wide[used]].sum(1)[inv.reshape(len(b), WINDOW)]
                node, pair = posteriors(e, on[b], t)
                g = node.copy()
                np.put_along_axis(g, y[b][:, :, None], np.take_along_axis(g, y[b][:, :, None], 2) - 1, 2)
                g *= on[b][:, :, None]
                by_type = np.zeros((len(used), k))
                np.add.at(by_type, inv.ravel(), g.reshape(-1, k))
                gw = np.zeros_like(w)
                np.add.at(gw, wide[used], by_type[:, None, :])
                gw[0] = 0
                gt = pair
                both = on[b][:, 1:]
                np.add.at(gt, (y[b][:, :-1][both], y[b][:, 1:][both]), -1)
                hit = np.flatnonzero(gw.any(1))
                gw = gw[hit] / len(b) + 1e-5 * w[hit]
                gw2[hit] += gw**2
                w[hit] -= rate * gw / np.sqrt(gw2[hit])
                gt = gt / len(b)
                gt2 += gt**2
                t -= rate * gt / np.sqrt(gt2)
        self.w, self.t = w.astype(np.float32), t

    def label(self, docs: list[list[str]]) -> list[np.ndarray]:
        """For each list of words an array (words, languages) of probabilities."""
        k = len(self.langs)
        flat = [w for d in docs for w in d]
        if not flat:
            return [np.zeros((0, k)) for _ in docs]
        e = self.emissions(flat)
        e = np.exp(e - e.max(1, keepdims=True))
        lengths = np.array([len(d) for d in docs])
        blocks = -(-lengths // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        doc = np.repeat(np.arange(len(docs)), lengths)
        within = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        row, col = first[doc] + within // BLOCK, within % BLOCK
        x, on = np.ones((first[-1], BLOCK, k)), np.zeros((first[-1], BLOCK), bool)
        x[row, col], on[row, col] = e, True
        a = np.exp(self.t - self.t.max())
        m = np.broadcast_to(np.eye(k), (first[-1], k, k)).copy()
        for j in range(BLOCK):
            step = (m @ a) * x[:, j, None, :]
            step /= step.max((1, 2), keepdims=True)
            m = np.where(on[:, j, None, None], step, m)
        into, out = np.full((first[-1], k), 1.0 / k), np.ones((first[-1], k))
        for j in range(1, int(blocks.max())):
            live = np.flatnonzero(blocks > j)
            at = first[live] + j
            v = np.einsum("bi,bij->bj", into[at - 1], m[at - 1])
            into[at] = v / v.sum(1, keepdims=True)
            at = first[live + 1] - 1 - j
            v = np.einsum("bij,bj->bi", m[at + 1], out[at + 1])
            out[at] = v / v.sum(1, keepdims=True)
        fore = np.empty_like(x)
        v = into
        for j in range(BLOCK):
            s = (v @ a) * x[:, j]
            v = np.where(on[:, j, None], s / s.sum(1, keepdims=True), v)
            fore[:, j] = v
        v = out
        for j in range(BLOCK - 1, -1, -1):
            fore[:, j] *= v
            s = (x[:, j] * v) @ a.T
            v = np.where(on[:, j, None], s / s.sum(1, keepdims=True), v)
        p = fore[row, col]
        p /= p.sum(1, keepdims=True)
        return np.split(p, np.cumsum(lengths)[:-1])


def posteriors(e: np.ndarray, on: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word probabilities, and expected transitions summed, of short padded chains."""
    x = np.exp(e - e.max(2, keepdims=True))
    a = np.exp(t - t.max())
    b, n, k = x.shape
    fore, back = np.empty_like(x), np.empty_like(x)
    v = np.full((b, k), 1.0 / k)
    for j in range(n):
        s = (v @ a) * x[:, j]
        v = np.where(on[:, j, None], s / s.sum(1, keepdims=True), v)
        fore[:, j] = v
    v = np.ones((b, k))
    for j in range(n - 1, -1, -1):
        back[:, j] = v
        s = (x[:, j] * v) @ a.T
        v = np.where(on[:, j, None], s / s.sum(1, keepdims=True), v)
    node = fore * back
    node /= node.sum(2, keepdims=True)
    pair = fore[:, :-1, :, None] * a * (x * back)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return node, (pair * on[:, 1:, None, None]).sum((0, 1))


def _word_counts(batches):
    """(lang, word, n), added up in the task as far as memory goes."""
    counts: dict[str, Counter] = {}

    def flush():
        rows = [(l, w, n) for l, c in counts.items() for w, n in c.items()]
        counts.clear()
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["lang", "word", "n"])

    for batch in small_slices(batches, 200):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > 300_000:
            yield flush()
    yield flush()


def train(docs: DataFrame, per_lang: int = 500, windows: int = 6, seed: int = 17) -> Field | None:
    """A field from ``docs`` (doc_id, text, lang): lexicons from all of them, weights from a bounded sample."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = stored(docs.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    lexicon = counts.join(totals, "lang").where("n >= 3 and n >= 1e-4 * total").select("word", "lang", (F.col("n") / F.col("total")).alias("share"))
    best = lexicon.groupBy("word").agg(F.max(F.struct("share", "lang")).alias("best")).select("word", "best.lang").toArrow()
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each language
    share = F.lit(0)
    for lang, n in sizes.items():  # no join, so no text is shuffled by so hot a key
        share = F.when(F.col("lang") == lang, F.lit(-(-per_lang * 1_000_000 // n))).otherwise(share)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select("doc_id", "lang", "text")
    sample = chosen.mapInArrow(_windows(windows), "doc_id long, lang string, words array<string>").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["lang"], r["words"]))
    langs = sorted({r["lang"] for r in sample})
    if not langs:
        return None
    field = Field(langs, dict(zip(best["word"].to_pylist(), best["lang"].to_pylist())))
    at = {l: i for i, l in enumerate(langs)}
    rng = np.random.default_rng(seed)
    sequences = [r["words"] for r in sample]
    labels = [np.full(len(r["words"]), at[r["lang"]]) for r in sample]
    for _ in range(len(sample)):  # spliced: as many as there are whole ones
        words: list[str] = []
        marks: list[int] = []
        for i in rng.integers(0, len(sample), rng.integers(2, 4)):
            cut = sample[i]["words"][: rng.integers(4, 17)]
            words += cut
            marks += [at[sample[i]["lang"]]] * len(cut)
        sequences.append(words[:WINDOW])
        labels.append(np.array(marks[:WINDOW]))
    field.fit(sequences, labels)
    return field


def _windows(most: int):
    def run(batches):
        for batch in small_slices(batches, 200):
            ids, langs, out = [], [], []
            for doc, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                starts = np.arange(0, len(words), WINDOW)
                for s in starts[np.unique(np.linspace(0, len(starts) - 1, most).round().astype(int))] if len(starts) else ():  # over the whole text
                    ids.append(doc)
                    langs.append(lang)
                    out.append(words[s : s + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "lang", "words"])

    return run


_RUNS = T.ArrayType(T.StructType([T.StructField("n_words", T.IntegerType()), T.StructField("lang", T.StringType())]))
_PA_RUNS = pa.list_(pa.struct([("n_words", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with lang_pred, score and ``runs``: lengths and languages of the runs of words of one language."""
    docs = without(docs, "lang_pred", "score", "runs")
    if field is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast(_RUNS).alias("runs"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        model = shared.value
        for batch in small_slices(batches, 100):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            langs, scores, runs = [], [], []
            for p in model.label([words_of(t) for t in texts]):
                if not len(p):
                    langs.append("und")
                    scores.append(0.0)
                    runs.append([])
                    continue
                mean = p.mean(0)
                langs.append(model.langs[int(mean.argmax())])
                scores.append(float(min(1.0, mean.max())))
                best = p.argmax(1)
                cut = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
                runs.append([{"n_words": int(n), "lang": model.langs[best[c]]} for c, n in zip(cut, np.diff(np.append(cut, len(best))))])
            yield with_columns(batch, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "runs": pa.array(runs, _PA_RUNS)})

    return docs.mapInArrow(run, fields(docs, ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("runs", _RUNS)))


def op4_lang_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    field = train(docs.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))))
    out = identify(docs.select("doc_id", held_out, "text"), field)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("runs").cast("long").alias("n_runs"))

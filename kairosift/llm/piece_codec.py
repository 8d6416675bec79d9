"""Operator 2: SentencePiece (BPE, byte fallback) encoding and decoding by a prefix table.

Merging always takes the best-scored, leftmost adjacent pair whose join is a piece. Two facts follow: a sequence
of pieces is the encoding of its text if and only if each adjacent pair is the encoding of its own two texts
(the pair is compatible), and every prefix of a text has one encoding, hence one last piece. So one pass over
the automaton's matches stores, for each prefix, the one match that starts where a prefix ends whose last piece
is compatible with it; the ids are then recovered backwards. Time is linear in the text whatever its length;
characters outside the vocabulary stand alone and become their bytes.

No piece of the vocabulary has a space mark after another character (checked on loading), so no piece crosses
from a word to the next space; where no piece joins Latin letters with ASCII signs either (found on loading), runs of
both are encoded apart too. A worker keeps a bounded table of the runs it met.

Defined cases: null and '' have no ids and decode to ''; ``docs`` may hold any more columns (one named ``ids``
or ``decoded`` is replaced); rows are independent, so repeated rows and ties need no rule.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, small_slices, with_columns, without

SPACE = "▁"


class Remembered(dict):
    """What a function gives for each run of characters; emptied when it is full."""

    def __init__(self, of, most: int):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, run: str):
        found = self.of(run)
        if len(run) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[run] = found
        return found


#: Letters and digits of Latin script, and ASCII signs, as parts of a regular expression's class.
LATIN, SIGNS = "0-9A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~"


class Pieces:
    """A vocabulary: its automaton, the compatibility of pairs, and the bytes of every id."""

    def __init__(self, model: str, remembered: int = 600_000, counted: int = 1_000_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.text = {i: sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: sp.get_score(i) for i, t in self.text.items()}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte_id) < 256 or any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.text.values()):
            raise ValueError("the model isn't a BPE vocabulary with byte fallback whose pieces begin words")
        self.raw: list[bytes] = [b""] * n
        for i, t in self.text.items():
            self.raw[i] = t.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        self.size = [len(self.text.get(i, "")) for i in range(n)]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            if self.merged(t) == [t]:  # a piece that isn't the encoding of its own text is in no encoding
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.n = n
        self.pairs: dict[int, bool] = {}  # left * n + right -> compatible
        self.packed = Remembered(lambda run: array("i", self.word_ids(run)).tobytes(), remembered)
        self.counts = Remembered(lambda run: len(self.word_ids(run)), counted)
        alone, stop = ("", "") if "\n" in self.id else (r"\n|", r"\n")
        plain = f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+"
        if any(map(re.compile(f"[{LATIN}][{SIGNS}]|[{SIGNS}][{LATIN}]").search, self.text.values())):
            self.split = re.compile(alone + plain)
        else:  # a run that another character follows isn't cut off
            other = f"(?![^{LATIN}{SIGNS}{SPACE}{stop}])"
            self.split = re.compile(f"{alone}{SPACE}*+[{LATIN}]++{other}|{SPACE}*+[{SIGNS}]++{other}|{plain}")

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by the definition: merge the best pair, leftmost first, until none is left."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def test(self, left: int, right: int) -> bool:
        """Whether the two pieces are the encoding of their texts, and note it."""
        a, b = self.text[left], self.text[right]
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        ok = self.pairs[left * self.n + right] = self.merged(a + b) == [a, b]
        return ok

    def last_pieces(self, word: str) -> list[int]:
        """For each prefix length the id of the prefix's last piece; -1 where that is a character outside the vocabulary."""
        last = [-1] * (len(word) + 1)
        known, n = self.pairs.get, self.n
        for end, (piece, size) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:  # the one last piece of this prefix is known
                continue
            before = last[end - size]
            if before < 0:  # the start, or after a character outside the vocabulary
                last[end] = piece
            else:
                ok = known(before * n + piece)
                if ok or ok is None and self.test(before, piece):
                    last[end] = piece
        return last

    def word_ids(self, word: str) -> list[int]:
        last, ids, at, size = self.last_pieces(word), [], len(word), self.size
        while at:
            piece = last[at]
            if piece < 0:
                ids += [self.byte_id[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))]
                at -= 1
            else:
                ids.append(piece)
                at -= size[piece]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        words = self.split.findall(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.packed.__getitem__, words)), np.int32)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.counts.__getitem__, self.split.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids) -> str:
        """The text of ids; a leading space mark, put there by encoding, is taken away."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        lead = len(ids) and self.raw[ids[0]].startswith(b" ") and ids[0] in self.text
        return raw[1 if lead else 0 :].decode("utf-8", "replace")


_LOADED: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One vocabulary a worker."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, array of int: the encoding of every whole text, without begin or end ids."""
    model = model or default_model()
    docs = without(docs, "ids")

    def run(batches):
        codec = pieces(model)
        for batch in small_slices(batches, 500):
            out = [codec.encode(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
            flat = np.concatenate(out) if out else np.empty(0, np.int32)
            yield with_columns(batch, {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return docs.mapInArrow(run, fields(docs, ("ids", T.ArrayType(T.IntegerType()))))


def _decoded(codec: Pieces, column: pa.ListArray) -> pa.Array:
    """The text of each list of ids; lists are made from numpy, as Arrow's own make a scalar of every id."""
    return pa.array([codec.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in column], pa.string())


def decode_ids(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``: the text of ``ids`` (null: '')."""
    model = model or default_model()
    docs = without(docs, "decoded")

    def run(batches):
        codec = pieces(model)
        for batch in small_slices(batches, 500):
            column = batch.column(batch.schema.get_field_index("ids"))
            yield with_columns(batch, {"decoded": _decoded(codec, column)})

    return docs.mapInArrow(run, fields(docs, ("decoded", T.StringType())))


def token_counts(docs: DataFrame, model: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of ids of every whole text."""
    model = model or default_model()
    docs = without(docs, name)

    def run(batches):
        codec = pieces(model)
        for batch in small_slices(batches, 500):
            n = [codec.count(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield with_columns(batch, {name: pa.array(n, pa.int64())})

    return docs.mapInArrow(run, fields(docs, (name, T.LongType())))


def op2_piece_codec(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode_ids(encode_texts(docs).drop("text"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

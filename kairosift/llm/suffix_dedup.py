"""Operator 7: removal of every byte of a long string that also starts anywhere else, by suffix arrays.

Every start of a ``length``-byte window belongs to the leftmost least-hashed k-gram of its window (its anchor), so
equal windows, wherever they are, belong to k-grams of one hash, at one distance. The starts of an anchor follow
each other: they and the bytes of their windows are its slice. Only slices of anchors whose hash occurs twice can
hold a repeat; equal slices are counted as one class. The classes of a hash are one text for a suffix array
(linear grouping, see suffix_sort), in which windows of equal neighbours are repeats. Each window is in one
slice, so no window meets itself.

A hash with over ``most`` different slices is dealt out further: starts of an anchor are cut into shorter ranges,
and slices of a range are keyed by the bytes that all windows of the range share; at last a range is one start,
whose key is the window, and counting is enough. So no task holds more than ``most`` slices, however common a
passage is, and nothing is left out.

Equal documents are one class too: with ``length`` bytes or more all of each is removed.

A second, shorter length can be asked for beside it. A repeat of ``length`` bytes is a stretch of shorter ones, so
the anchors are those of the shorter length, and only stretches of slices that may repeat at it are sliced anew.

Defined cases: null text is empty; texts under ``length`` bytes lose nothing; rows that share a doc_id or have
none are documents of their own; repeated rows repeat each other; empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, forget, fresh, small_slices, stored, with_columns, without
from .suffix_sort import suffix_array

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
K = 32  # bytes of an anchor, a power of two
_PLACE = 24  # bits of a position within a stretch


def _pair(data: bytes) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(data)
    return (n >> 64) - (1 << 63), (n & (1 << 64) - 1) - (1 << 63)


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    h, width = _BYTE[data], 1
    power = np.array([_P])  # an array wraps around without a word
    while width < K:
        h = h[:-width] * power + h[width:]
        power = power * power
        width *= 2
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def slices(data: bytes, length: int):
    """(anchor hash, first start, last start, anchor) of each slice of a text, as four arrays."""
    n = len(data) - length + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    w = length - K + 1
    h = kgram_hashes(np.frombuffer(data, np.uint8))
    anchor = np.empty(n, np.int64)
    stretch = (1 << _PLACE) - w
    for at in range(0, n, stretch):
        part = h[at : at + stretch + w - 1]
        m = len(part) - w + 1
        value = (part >> _U(_PLACE) << _U(_PLACE)) | np.arange(len(part), dtype=np.uint64)  # the leftmost of equal ones
        value = np.concatenate([value, np.full(-len(part) % w, ~_U(0))]).reshape(-1, w)
        before = np.minimum.accumulate(value, 1).ravel()
        after = np.minimum.accumulate(value[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(after[:m], before[w - 1 : w - 1 + m])
        anchor[at : at + m] = at + (least & _U((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return h[anchor[first]].view(np.int64), first, last, anchor[first]


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def repeated_spans(texts: list[bytes], anchors: list[int], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each different slice the merged spans of its windows that are also in another, all for those counted twice."""
    spans: list[list[tuple[int, int]]] = [[(0, len(t))] if c > 1 else [] for t, c in zip(texts, counts)]
    if len(texts) < 2 or all(c > 1 for c in counts):
        return spans
    # nothing farther from the anchor than its longest agreement with any other slice can be repeated
    right, left = [0] * len(texts), [0] * len(texts)
    for reach, sides in ((right, [t[a:] for t, a in zip(texts, anchors)]), (left, [t[:a][::-1] for t, a in zip(texts, anchors)])):
        order = sorted(range(len(texts)), key=sides.__getitem__)
        for i, j in zip(order, order[1:]):
            c = common(sides[i], sides[j])
            reach[i], reach[j] = max(reach[i], c), max(reach[j], c)
    members: dict[bytes, list[int]] = {}  # what is left of equal slices is one class again
    for i in range(len(texts)):
        if left[i] + right[i] >= length:
            members.setdefault(texts[i][anchors[i] - left[i] : anchors[i] + right[i]], []).append(i)
    for own in members.values():
        if len(own) > 1:
            for i in own:
                spans[i] = spans[i] or [(anchors[i] - left[i], anchors[i] + right[i])]
    use = [own[0] for own in members.values()]
    if len(use) < 2 or all(spans[i] for i in use):
        return spans
    joined = b"\0".join(members)
    sizes = np.array([len(part) for part in members])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = np.frombuffer(joined, np.uint8).astype(np.int64) + 2
    symbols[(begin + sizes)[:-1]] = 1
    starts = np.zeros(len(joined) + 1, np.int64)
    np.add.at(starts, begin, 1)
    np.add.at(starts, begin + sizes - length + 1, -1)
    whole = np.cumsum(starts[:-1]) > 0  # starts of whole windows
    sa = np.array(suffix_array(symbols))
    sa = sa[whole[sa]]
    twice = np.zeros(len(joined), bool)
    places = sa.tolist()
    was = joined[places[0] : places[0] + length]
    for p, q in zip(places, places[1:]):
        now = joined[q : q + length]
        if now == was:
            twice[p] = twice[q] = True
        was = now
    for at, i in enumerate(use):
        if not spans[i]:
            hit = np.flatnonzero(twice[begin[at] : begin[at] + sizes[at]]) + anchors[i] - left[i]
            spans[i] = merge(zip(hit.tolist(), (hit + length).tolist()))
    return spans


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_L, _I, _B = T.LongType(), T.IntegerType(), T.BinaryType()
_SPANS = T.ArrayType(T.StructType([T.StructField("a", _I), T.StructField("b", _I)]))
_PA_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _anchors(length: int):
    """Rows (d1, d2, text) to a row for each slice."""

    def run(batches):
        for batch in small_slices(batches, 500):
            own, parts = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                found = slices(t.encode("utf-8", "surrogatepass"), length)
                own += [i] * len(found[0])
                parts.append(found)
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4
            own = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *[pa.array(c) for c in columns]], names=["d1", "d2", "h", "s0", "s1", "p"])

    return run


_SLICE = _struct(d1=_L, d2=_L, s0=_L, h=_L, c1=_L, c2=_L, p=_I, slice=_B, size=_I)


def stretches(first: np.ndarray, last: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and last starts of the stretches of at least so many starts that slices, in order, make without a gap."""
    begin = np.flatnonzero(np.concatenate([[True], first[1:] != last[:-1] + 1]))
    end = np.concatenate([begin[1:] - 1, [len(first) - 1]])
    return [(a, b) for a, b in zip(first[begin].tolist(), last[end].tolist()) if b - a + 1 >= least]


def _cut_slices(least: int, longer: int | None):
    """Rows (d1, d2, text, slices list of (s0, s1, p, h)) to a row for each slice, and for those of ``longer`` in their stretches."""

    def run(batches):
        for batch in small_slices(batches, 200):
            lists = batch.column(3)
            ends, found = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            all_s0, all_s1, all_p, all_h = (found.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            own, columns, cut, size = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                text = text.encode("utf-8", "surrogatepass")
                here = np.arange(ends[i], ends[i + 1])
                here = here[np.argsort(all_s0[here])]
                parts = [(least, all_h[here], all_s0[here], all_s1[here], all_p[here])]
                for a, b in stretches(parts[0][2], parts[0][3], longer - least + 1) if longer else ():
                    h, s0, s1, p = slices(text[a : b + least], longer)
                    parts.append((longer, h, s0 + a, s1 + a, p + a))
                for length, h, s0, s1, p in parts:
                    own += [i] * len(h)
                    size += [length] * len(h)
                    columns.append((s0, h, p - s0))
                    cut += [text[a : b + length] for a, b in zip(s0.tolist(), s1.tolist())]
            s0, h, p = (np.concatenate(x) for x in zip(*columns)) if columns else [np.empty(0, np.int64)] * 3
            pairs, own = [_pair(x) for x in cut], pa.array(own, pa.int64())
            arrays = [batch.column(0).take(own), batch.column(1).take(own), pa.array(s0), pa.array(h), pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(p.astype(np.int32)), pa.array(cut, pa.binary()), pa.array(size, pa.int32())], names=_SLICE.names)

    return run


_RESULT = _struct(h=_L, c1=_L, c2=_L, spans=_SPANS)


def _solve(length: int):
    """Rows of classes (h, c1, c2, n, p, slice), those of an h next to each other, to their repeated spans."""

    def emit(group):
        spans = repeated_spans([r[5] for r in group], [r[4] for r in group], [r[3] for r in group], length)
        return [(r[0], r[1], r[2], [{"a": a, "b": b} for a, b in s]) for r, s in zip(group, spans) if s]

    def run(batches):
        group, out = [], []
        for batch in small_slices(batches, 2000):
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if group and row[0] != group[0][0]:
                    out += emit(group)
                    group = []
                group.append(row)
            yield _rows(_RESULT.names, [pa.int64()] * 3 + [_PA_SPANS], out)
            out = []
        if group:
            yield _rows(_RESULT.names, [pa.int64()] * 3 + [_PA_SPANS], emit(group))

    return run


_SUB = _struct(up_h=_L, up_c1=_L, up_c2=_L, offset=_I, h=_L, c1=_L, c2=_L, n=_L, p=_I, slice=_B)


def _split(width: int, length: int):
    """Rows of classes to rows of their sub-slices: starts cut into ranges of ``width`` distances from the anchor."""

    def run(batches):
        for batch in small_slices(batches, 100):
            rows = []
            for h, c1, c2, n, p, part in zip(*(batch.column(i).to_pylist() for i in range(6))):
                last = len(part) - length  # starts 0..last lie p..p-last before the anchor
                for r in range(max(p - last, 0) // width, p // width + 1):
                    far, near = r * width + width - 1, r * width
                    shared = part[p - near : p - far + length]  # in every window of the range
                    a, b = max(p - far, 0), min(p - near, last)
                    sub = part[a : b + length]
                    key = xxhash.xxh3_64_intdigest(shared, seed=(h ^ (r * 0x9E3779B97F4A7C15)) & (1 << 64) - 1) - (1 << 63)
                    rows.append((h, c1, c2, a, key, *_pair(sub), n, p - a, sub))
            yield _rows(_SUB.names, [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 4 + [pa.int32(), pa.binary()], rows)

    return run


_CLASS = ["h", "c1", "c2"]


def solve_classes(classes: DataFrame, length: int, most: int, width: int) -> DataFrame:
    """(h, c1, c2, spans) of the classes (h, c1, c2, n, p, slice) that hold repeats."""
    keys = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all")).where("all > 1")
    few = classes.join(keys.where(F.col("k") <= most).select("h"), "h").select(*_CLASS, "n", "p", "slice")
    done = few.repartition("h").sortWithinPartitions("h", "c1", "c2").mapInArrow(_solve(length), _RESULT)
    many = keys.where(F.col("k") > most).select("h")
    if many.isEmpty():
        return done
    hot = classes.join(many, "h").select(*_CLASS, "n", "p", "slice")
    if width <= 1:  # a slice is one window, and so is its key
        return done.unionByName(hot.where("n > 1").select(*_CLASS, F.array(F.struct(F.lit(0).alias("a"), F.lit(length).alias("b"))).alias("spans")))
    narrower = max(1, width // 8)
    subs = stored(hot.mapInArrow(_split(narrower, length), _SUB), "suffix-split")
    found = solve_classes(stored(to_classes(subs), "suffix-classes"), length, most, narrower)
    back = subs.select("up_h", "up_c1", "up_c2", "offset", *_CLASS).join(found, _CLASS)
    moved = F.transform("spans", lambda x: F.struct((x.a + F.col("offset")).alias("a"), (x.b + F.col("offset")).alias("b")))
    back = back.groupBy("up_h", "up_c1", "up_c2").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    whole = hot.where("n > 1").select(*_CLASS, F.array(F.struct(F.lit(0).alias("a"), F.length("slice").alias("b"))).alias("spans"))
    return done.unionByName(back.toDF(*_CLASS, "spans")).unionByName(whole)


def to_classes(parts: DataFrame, *also: str) -> DataFrame:
    """Equal slices as one row, with their number."""
    return parts.groupBy(*also, *_CLASS).agg(F.sum("n").alias("n"), F.min("p").alias("p"), F.min("slice").alias("slice"))


def _removed(length: int, as_text: bool, shorter: int | None):
    def run(batches):
        for batch in small_slices(batches, 500):
            at = batch.schema.get_field_index
            kept, removed, runs, covered = [], [], [], []
            for text, spans, short, twins in zip(*(batch.column(at(c)).to_pylist() for c in ("text", "__spans", "__short", "__twins"))):
                data = (text or "").encode("utf-8", "surrogatepass")
                if shorter:
                    covered.append(len(data) if twins and len(data) >= shorter else sum(b - a for a, b in merge((s["a"], s["b"]) for s in short or ())))
                if twins and len(data) >= length:
                    gone = [(0, len(data))]
                else:
                    gone = merge((s["a"], s["b"]) for s in spans or ())
                if as_text:  # only whole characters go
                    gone = [(a, b) for a, b in ((_whole(data, a, True), _whole(data, b, False)) for a, b in gone) if b > a]
                parts, last = [], 0
                for a, b in gone:
                    parts.append(data[last:a])
                    last = b
                parts.append(data[last:])
                kept.append(b"".join(parts))
                removed.append(sum(b - a for a, b in gone))
                runs.append(len(gone))
            left = [i for i, n in enumerate(batch.schema.names) if n not in ("__spans", "__short", "__twins", "__d1", "__d2")]
            rest = pa.RecordBatch.from_arrays([batch.column(i) for i in left], names=[batch.schema.names[i] for i in left])
            kept = pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            new = {"text": kept} if as_text else {"kept": kept}
            new |= {"n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64())}
            yield with_columns(rest, new | ({"n_shorter": pa.array(covered, pa.int64())} if shorter else {}))

    return run


def _whole(data: bytes, at: int, up: bool) -> int:
    """The nearest start of a character from ``at`` on, or back."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1 if up else -1
    return at


def remove_repeats(docs: DataFrame, length: int = 400, most: int = 1024, as_text: bool = True, shorter: int | None = None) -> DataFrame:
    """``docs`` (text, any more) with n_bytes, n_removed, n_spans and the rest of the text.

    As text (whole characters alone are removed) or, if not ``as_text``, in ``kept`` as bytes, exactly. With ``shorter``
    (over 32, under ``length``) also n_shorter: the bytes covered by strings of that length that also start elsewhere;
    they stay.
    """
    inner = ["__d1", "__d2", "__bytes", "__spans", "__short", "__twins"]
    docs = without(docs, "n_bytes", "n_removed", "n_spans", *inner, *([] if as_text else ["kept"]), *(["n_shorter"] if shorter else []))
    least, text = shorter or length, F.coalesce("text", F.lit(""))
    hashed = docs.withColumns({"__d1": F.xxhash64(text), "__d2": F.xxhash64(F.lit(K), text), "__bytes": F.octet_length(text).cast("long")})
    own = hashed.where(F.col("__bytes") >= least).select(F.col("__d1").alias("d1"), F.col("__d2").alias("d2"), "text")
    anchors = stored(own.mapInArrow(_anchors(least), _struct(d1=_L, d2=_L, h=_L, s0=_L, s1=_L, p=_L)).distinct(), "suffix-anchors")
    again = stored(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "suffix-again")  # a plain table: Spark then splits a hot hash
    wanted = anchors.join(again, "h").groupBy("d1", "d2").agg(F.collect_list(F.struct("s0", "s1", "p", "h")).alias("found"))
    one = own.groupBy("d1", "d2").agg(F.min("text").alias("text"))  # copies meet before the shuffle
    cut = stored(one.join(wanted, ["d1", "d2"]).select("d1", "d2", "text", "found").mapInArrow(_cut_slices(least, length if shorter else None), _SLICE), "suffix-slices")
    forget(anchors)
    classes = stored(to_classes(cut.withColumn("n", F.lit(1).cast("long")), "size"), "suffix-classes")
    places = stored(cut.select("d1", "d2", "s0", "size", *_CLASS), "suffix-places")
    forget(cut)
    moved = F.transform("spans", lambda x: F.struct((x.a + F.col("s0")).cast("int").alias("a"), (x.b + F.col("s0")).cast("int").alias("b")))
    info = own.groupBy("d1", "d2").agg((F.count(F.lit(1)) > 1).alias("__twins"))
    for name, size in (("__spans", length), ("__short", shorter)):
        if size:
            spans = stored(solve_classes(classes.where(F.col("size") == size).drop("size"), size, most, size - K + 1), "suffix-spans")
            by_text = places.where(F.col("size") == size).join(spans, _CLASS).groupBy("d1", "d2").agg(F.flatten(F.collect_list(moved)).alias(name))
            info = info.join(by_text, ["d1", "d2"], "left")
        else:
            info = info.withColumn(name, F.lit(None).cast(_SPANS))
    forget(classes)
    info = info.where(F.col("__twins") | F.col("__spans").isNotNull() | F.col("__short").isNotNull())
    a, b = fresh(hashed, "__h1", "__h2")
    info = info.select(F.col("d1").alias(a), F.col("d2").alias(b), "__spans", "__short", "__twins")
    out = hashed.join(info, (F.col("__d1") == F.col(a)) & (F.col("__d2") == F.col(b)), "left").drop(a, b)
    more = [("n_bytes", _L), *([] if as_text else [("kept", _B)]), ("n_removed", _L), ("n_spans", _L), *([("n_shorter", _L)] if shorter else [])]
    return out.withColumnRenamed("__bytes", "n_bytes").mapInArrow(_removed(length, as_text, shorter), fields(docs, *more))


#: Bytes of the passages that op7 counts beside those it removes; 50 words have more in any of the languages.
SHORTER = 200


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, as_text=False, shorter=SHORTER).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("changed"),
        F.col("n_shorter").alias(f"n_repeated_{SHORTER}"), (F.col("n_shorter") > 0).alias(f"repeats_{SHORTER}"),
    )

"""Operator 5: MinHash near-dedup with tensored banding and exact verification.

Two collections of ``m`` sub-keys, each of ``r`` minhashes, are made for every document: 2*m*r minhashes. The
tables are the m*m pairs (left sub-key i, right sub-key j), each a key of 2*r minhashes; independent tables of
that strength would need 2*m*m*r minhashes. With m = 10 and r = 3 a pair of similarity 0.85 meets in some table
with probability 1 - 1.5e-4, of 0.9 with 1 - 2e-6.

Steps: texts of one shingle set are one class. In every table, the members of a bucket are compared on full sets with
the bucket's smallest set alone, its leader, so a bucket gives no more pairs than members. A leader with its members is a
star. A star whose members are all linked with it, or all in one component by then, is done. Of the others, each with at
most ``CELLS`` shingles in all (and bounded work) goes to one task, which finds the links that join its components: members
are compared by what they differ in from what most of them share (``Differences``), and only those that have a rare
difference in common are counted; it emits fewer links than members.

Larger stars go on in levels without comparing all pairs: let y and z be members of buckets led by x, one of them not
linked with x. Both have at least as many shingles as x, so to reach the similarity they must share a shingle that x
hasn't got. So members are put into new buckets, one for each such shingle (rarest first, as many as the needed overlap
asks for; of buckets with the same members one is kept). There all are compared with the bucket's leaders: all of a few
members, else the smallest of some hash classes. A bucket of leaders alone is done; the others are stars of their first
leader, finished by a task where they fit, else put into buckets by their shingles outside of that leader. Leaders grow
from level to level, so this ends; independent edits share nothing outside of x and make no bucket, however large the
group is, and a star of so many members that it doesn't fit is split at each level by shingles that not all have.

Defined cases
* null, empty or wordless text: n_shingles 0, linked with nothing;
* fewer words than a shingle has: the whole sequence is the one shingle;
* a row is judged by its own text: rows sharing a doc_id but not the text may be in different components;
* null doc_id: component null, kept true; empty table: empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, fresh, given_back, small_slices, stored
from .components import components

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word met, kept in a worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles. bytes.lower and bytes.split know ASCII alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, _U)
    w = np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, _U)
    for j in range(n):
        h = h * _P + w[j : len(w) - n + 1 + j]
    return np.unique(_mix(h))


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240607))
    a = rng.integers(1, 2**63, count, dtype=np.uint64) * _U(2) + _U(1)
    return a, rng.integers(0, 2**63, count, dtype=np.uint64)


def minhashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """A row of ``count`` minhashes for each set, none of them empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    a, b = _coefficients(count)
    out = np.empty((len(sets), count), _U)
    for j in range(count):
        out[:, j] = np.minimum.reduceat((flat ^ b[j]) * a[j], starts)
    return out


def sub_keys(signature: np.ndarray, m: int, r: int) -> np.ndarray:
    """2*m keys of r minhashes each: the first m make the left collection."""
    parts = signature.reshape(len(signature), 2 * m, r)
    key = np.zeros(parts.shape[:2], _U)
    for j in range(r):
        key = _mix(key * _P + parts[:, :, j])
    return key.view(np.int64)


_FEATURES = T.StructType(
    [*[T.StructField(c, T.LongType()) for c in ("id", "t1", "t2")], T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("n_shingles", T.LongType()),
     T.StructField("left_keys", T.ArrayType(T.LongType())), T.StructField("right_keys", T.ArrayType(T.LongType()))]
)


def _features(k: int, m: int, r: int):
    def run(batches):
        for batch in small_slices(given_back(batches), 64):
            sets = [shingle_set(t, k) for t in batch.column(3).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            c1, c2 = [None] * len(sets), [None] * len(sets)
            left, right = [None] * len(sets), [None] * len(sets)
            if full:
                keys = sub_keys(minhashes([sets[i] for i in full], 2 * m * r), m, r)
                for at, i in enumerate(full):
                    n = xxhash.xxh3_128_intdigest(sets[i].tobytes())
                    c1[i], c2[i] = (n >> 64) - (1 << 63), (n & (1 << 64) - 1) - (1 << 63)
                    left[i], right[i] = keys[at, :m], keys[at, m:]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                names=_FEATURES.names,
            )

    return run


def _sets(k: int):
    def run(batches):
        for batch in small_slices(given_back(batches), 64):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, k).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    return run


def _compare(batches):
    """Of each pair of full sets: both sizes, what they share, and the shingles of y alone."""
    for batch in small_slices(given_back(batches), 200):
        nx, ny, shared, more = [], [], [], []
        for a, b in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(a.as_buffer(), _U), np.frombuffer(b.as_buffer(), _U)
            extra = np.setdiff1d(b, a, assume_unique=True)
            nx.append(len(a))
            ny.append(len(b))
            shared.append(len(b) - len(extra))
            more.append(extra.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(nx, pa.int64()), pa.array(ny, pa.int64()), pa.array(shared, pa.int64()), pa.array(more, pa.list_(pa.int64()))],
            names=_COMPARED.names,
        )


class Differences:
    """Sets by what they differ in from the shingles that most of them have, the core.

    What two sets share is |core| - lost - lost' + common, where lost are a set's missing shingles of the core and common
    the differences, lost or extra, of both. So they are linked where (100 + percent) * common >= weight + weight' - slack,
    with weight = 100 * lost + percent * extra. Where that is 0 at most, nothing needs counting: such sets are linked with
    the lightest one too. All others share a difference among the first ones of both, the rarest coming first: of as many
    as they have in common at least, all but one may be left out. A set's own edits come first and nobody shares them.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        n, sizes, self.unit = len(sets), np.array([len(s) for s in sets]), 100 + percent
        which, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        core = np.flatnonzero(2 * df > n)
        slot = np.full(len(df), -1, np.int32)
        slot[core] = np.arange(len(core))
        slot, holder = slot[which], np.repeat(np.arange(n, dtype=np.int32), sizes)
        missing = np.ones((n, len(core)), bool)  # fewer than twice the shingles of all
        missing[holder[slot >= 0], slot[slot >= 0]] = False
        who, what = np.nonzero(missing)
        lost = np.bincount(who, minlength=n)
        extra = sizes + lost - len(core)
        self.size, self.weight, self.slack = lost + extra, 100 * lost + percent * extra, (100 - percent) * len(core)
        key = np.concatenate([which[slot < 0], core[what]])
        self.held = np.bincount(key, minlength=len(df))
        place = np.empty(len(df), np.int64)
        place[np.argsort(self.held, kind="stable")] = np.arange(len(df))
        cells = np.sort(np.concatenate([holder[slot < 0], who]) * len(df) + place[key])
        self.held = np.sort(self.held)
        self.lightest = self.weight.argmin()
        self.near = self.weight + self.weight.min() <= self.slack  # linked with the lightest
        least = np.where(self.near, self.slack - self.weight.min() + 1, self.weight.min())  # weight of the others to look for
        least = np.maximum(least, -(-percent * (self.weight - self.slack) // 100))  # with fewer differences it can't share enough
        need = np.maximum(1, -(-(self.weight + least - self.slack) // self.unit))
        self.key, self.begin = cells % len(df), np.cumsum(self.size) - self.size
        holder = (cells // len(df)).astype(np.int32)
        self.all = self._posted(holder, self.key)
        first = np.arange(len(cells)) - self.begin[holder] <= (self.size - need)[holder]
        first &= np.bincount(self.key[first], minlength=len(df))[self.key] > 1
        self.first_size = np.bincount(holder[first], minlength=n)
        self.first_key, self.first_begin = self.key[first], np.cumsum(self.first_size) - self.first_size
        self.first = self._posted(holder[first], self.first_key)

    def _posted(self, holder: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        n = np.bincount(key, minlength=len(self.held))
        return holder[np.argsort(key, kind="stable")], np.cumsum(n) - n, n

    @staticmethod
    def _holders(posted: tuple[np.ndarray, ...], keys: np.ndarray) -> np.ndarray:
        holder, start, count = posted
        n = count[keys]
        return holder[np.repeat(start[keys] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def candidates(self, z: int) -> np.ndarray:
        """All that may be linked with z but need counting."""
        seen = np.zeros(len(self.size), bool)
        seen[self._holders(self.first, self.first_key[self.first_begin[z] : self.first_begin[z] + self.first_size[z]])] = True
        seen[z] = False
        y = np.flatnonzero(seen)
        return y[self.unit * np.minimum(self.size[y], self.size[z]) >= self.weight[y] + self.weight[z] - self.slack]

    def linked(self, z: int, y: np.ndarray) -> np.ndarray:
        common = np.bincount(self._holders(self.all, self.key[self.begin[z] : self.begin[z] + self.size[z]]), minlength=len(self.size))
        return y[self.unit * common[y] >= self.weight[y] + self.weight[z] - self.slack]


def _links_within(percent: int):
    """Links between members (x, y, c: component, shingles) of a star, as many as join components that aren't joined yet.

    Every pair of two components has a member outside of the largest one, so these alone look for the others.
    """

    def run(star: pa.Table) -> pa.Table:
        ids, label = star["y"].to_numpy(), star["c"].to_numpy()
        found = Differences([np.frombuffer(s.as_buffer(), _U) for s in star["shingles"]], percent)
        number = np.unique(label, return_inverse=True)[1]
        out = []

        def join(z: int, linked: np.ndarray) -> None:
            for y in linked:
                if number[y] != number[z]:
                    out.append((ids[z], ids[y]))
                    number[number == number[y]] = number[z]

        join(found.lightest, np.flatnonzero(found.near))
        for z in np.flatnonzero((number != np.bincount(number).argmax()) & (found.first_size > 0)):
            y = found.candidates(z)
            y = y[number[y] != number[z]]
            if len(y):
                join(z, found.linked(z, y))
        pa.default_memory_pool().release_unused()  # else it stays for the groups that follow
        return pa.table({"x": pa.array([a for a, _ in out], pa.int64()), "y": pa.array([b for _, b in out], pa.int64())})

    return run


_COMPARED = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("nx", "ny", "shared")], T.StructField("more", T.ArrayType(T.LongType()))])


#: Leaders of a bucket after the first level, twice as many at each further one up to CLASSES, which are hash classes
#: of the members: a member is compared with so many at most.
LEADERS, CLASSES = 32, 256
#: A star is finished by one task if its members have so many shingles in all (8 bytes each), and ten thousand times as many
#: over all members: some seconds of work. Larger ones go on to the next level.
CELLS = 4_000_000
_RANK = "shiftleft({n}, 40) | (xxhash64({id}) & 1099511627775)"  # by size; ties by hash


class NearDuplicates:
    """One run over ``docs``: ``features`` holds the rows, ``nodes`` the different sets by 64 bits of their hash."""

    def __init__(self, docs: DataFrame, k: int, percent: int, m: int, r: int, cells: int = CELLS):
        self.k, self.percent, self.cells = k, percent, cells
        self.core = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), *text_keys(), "text")
        self.features = stored(self.core.mapInArrow(_features(k, m, r), _FEATURES), "minhash")
        first = F.min_by(F.struct("t1", "t2", "n_shingles", "left_keys", "right_keys"), F.struct("id", "t1", "t2")).alias("f")
        nodes = self.features.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("id").alias("rep"), first)
        self.nodes = stored(nodes.select(F.col("c1").alias("id"), "rep", "f.*"), "minhash-nodes")

    def run(self) -> DataFrame:
        tables = self.nodes.select("id", F.expr(_RANK.format(n="n_shingles", id="id")).alias("rank"), F.posexplode("left_keys").alias("i", "l"), "right_keys")
        tables = tables.select("id", "rank", "i", "l", F.posexplode("right_keys").alias("j", "r"))
        tables = tables.select(F.xxhash64("i", "j", "l", "r").alias("key"), "id", "rank")
        leaders = tables.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "rank").alias("x")).where("n > 1").drop("n")
        leaders = stored(leaders, "minhash-leaders")  # a plain table: Spark then splits a hot bucket
        stars = tables.select("key", F.col("id").alias("y")).join(leaders, "key").where("x <> y").select("x", "y").distinct()
        pairs = stored(stars, "minhash-pairs")
        forget(leaders)
        self.sets = self._sets_of(pairs)
        linked = F.expr(f"100 * shared >= {self.percent} * (nx + ny - shared)")
        found = self._compared(pairs)  # all of them: members unlike their leader may be alike
        links = found.where(linked).select("x", "y")
        labels = components(links)
        stars, seen, most = found, pairs, LEADERS  # the stars of the next level, and all the pairs that were in a star
        while True:
            stars, inside = self._finished(stars.withColumn("apart", ~linked), labels)
            if inside is not None and not inside.isEmpty():
                links = links.union(inside)
                labels = components(links)
            pairs = None if stars is None else self._beside(stars, labels, most)
            if pairs is None:
                break
            new = self._compared(stored(pairs.join(found, ["x", "y"], "left_anti").select("x", "y"), "minhash-pairs"))
            found = found.union(new)
            if not new.where(linked).isEmpty():  # what hangs together needs no more links
                links = links.union(new.where(linked).select("x", "y"))
                labels = components(links)
            fresh_pairs = stored(pairs.where("first").select("x", "y").join(seen, ["x", "y"], "left_anti"), "minhash-pairs")
            if fresh_pairs.isEmpty():
                break
            # a leader that has new members makes buckets of all its members, the ones it had before too
            seen = seen.union(fresh_pairs)
            again = seen.join(fresh_pairs.select("x").distinct(), "x", "left_semi")
            stars, most = found.join(again, ["x", "y"], "left_semi"), min(2 * most, CLASSES)
        forget(self.sets)
        return labels

    def _finished(self, stars: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """The stars that are left for another level, and the links that a task found in each star within the bounds."""
        of = labels.select(F.col("node").alias("y"), F.col("component").alias("c"))
        rows = stars.select("x", "y", "apart", "ny").join(of, "y", "left").withColumn("c", F.coalesce("c", "y"))
        ended = rows.groupBy("x").agg(F.max("apart").alias("open"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n"), F.sum("ny").alias("cells"))
        ended = ended.where("open and c0 <> c1").select("x", F.expr(f"cells <= {self.cells} and n * cells <= {10_000 * self.cells}").alias("fits"))
        ended = stored(ended, "minhash-open")  # a plain table: Spark then splits a hot star
        fits = {r["fits"] for r in ended.select("fits").distinct().collect()}
        inside = None
        if True in fits:
            mine = rows.join(ended.where("fits").select("x"), "x").select("x", "y", "c").join(self.sets.select(F.col("id").alias("y"), "shingles"), "y")
            inside = stored(mine.groupBy("x").applyInArrow(_links_within(self.percent), T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])), "minhash-inside")
        return stars.join(ended.where("not fits").select("x"), "x", "left_semi") if False in fits else None, inside

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        """(id, shingles) of all that is in ``pairs``; no later level asks for another."""
        ids = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct()
        own = self.nodes.select("id", "t1", "t2").join(ids.hint("merge"), "id", "left_semi")
        texts = self.core.drop("id").join(own.hint("merge"), ["t1", "t2"]).groupBy("id").agg(F.max("text").alias("text"))
        return stored(texts.mapInArrow(_sets(self.k), T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.BinaryType())])), "minhash-sets")

    def _compared(self, pairs: DataFrame) -> DataFrame:
        a = self.sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx"))
        b = self.sets.select(F.col("id").alias("y"), F.col("shingles").alias("sy"))
        return stored(pairs.join(a, "x").join(b, "y").select("x", "y", "sx", "sy").mapInArrow(_compare, _COMPARED), "minhash-stars")

    def _beside(self, stars: DataFrame, labels: DataFrame, most: int) -> DataFrame | None:
        """Pairs of the next level (x, y, first): leaders and members of buckets (x, shingle outside of x) of the members of x;
        ``first``: x is the first leader of a bucket with more members than leaders."""
        of = labels.select(F.col("node").alias("y"), F.col("component").alias("c"))
        rows = stars.join(of, "y", "left").withColumn("c", F.coalesce("c", "y"))
        # What a member must share outside of x with another one to link with it, where it is the larger of the two:
        need = f"greatest(1, cast(ceil({self.percent / 100} * ny - 1e-9) as long) - shared)"
        rows = rows.select("x", "y", "c", "apart", "ny", "more", F.expr(f"size(more) - {need} + 1").alias("left")).where("size(more) > 0 and left > 0")
        several = rows.groupBy("x").agg(F.max("apart").alias("open"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("open and c0 <> c1")
        rows = stored(rows.join(several.select("x"), "x", "left_semi"), "minhash-beside")
        each = rows.select("x", "y", F.explode("more").alias("e"))
        common = stored(each.groupBy("x", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "minhash-common")  # a plain table: Spark then splits a hot shingle
        if common.isEmpty():
            return None
        each = each.join(common, ["x", "e"]).groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("es"))
        each = rows.select("x", "y", "c", "apart", "ny", "left", F.size("more").alias("n")).join(each, ["x", "y"])
        left = (F.col("left") - F.col("n") + F.size("es")).cast("int")  # shingles that no other member has come first
        each = each.where(left > 0).select("x", "y", "c", "apart", F.expr(_RANK.format(n="ny", id="y")).alias("rank"), F.explode(F.slice("es", F.lit(1), left)).alias("s"))
        each = stored(each.select("x", "s.e", "y", "c", "apart", "rank"), "minhash-buckets")
        same = [F.sum(F.xxhash64("y", F.lit(n)).cast("decimal(38,0)")).alias(f"s{n}") for n in (1, 2)]  # of buckets with the same members one is enough
        open_ = each.groupBy("x", "e").agg(F.count(F.lit(1)).alias("n"), *same, F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("apart").alias("open")).where("n > 1 and open and c0 <> c1")
        open_ = stored(open_.groupBy("x", "n", "s1", "s2").agg(F.min("e").alias("e")).select("x", "e", "n"), "minhash-open")  # a plain table: Spark then splits a hot bucket
        if open_.isEmpty():
            return None
        h = F.when(F.col("n") <= most, F.col("y")).otherwise(F.pmod(F.xxhash64("y", F.lit(7)), F.lit(CLASSES))).alias("h")  # a small bucket's members all lead
        by_class = each.join(open_, ["x", "e"]).groupBy("x", "e", h).agg(F.min(F.struct("rank", "y", "c")).alias("least"), F.max("n").alias("n"))
        leaders = by_class.groupBy("x", "e").agg(F.slice(F.array_sort(F.collect_list("least")), 1, most).alias("to"), F.max("n").alias("n"))  # CLASSES at most
        leaders = stored(leaders.select("x", "e", "to", (F.col("n") > F.size("to")).alias("more")), "minhash-leaders")
        # of one component only the first leader and its members meet, where the bucket goes on
        met = each.join(leaders, ["x", "e"]).withColumn("to", F.filter(F.transform("to", lambda l, i: F.struct(l.rank.alias("rank"), l.y.alias("y"), l.c.alias("c"), (i == 0).alias("first"))), lambda l: (l.c != F.col("c")) | (l.first & F.col("more"))))
        met = met.select("y", "rank", "more", F.explode("to").alias("l")).where("y <> l.y")
        swap = F.col("rank") < F.col("l.rank")  # the smaller set comes first
        met = met.select(F.when(swap, F.col("y")).otherwise(F.col("l.y")).alias("x"), F.when(swap, F.col("l.y")).otherwise(F.col("y")).alias("y"), (F.col("more") & F.col("l.first")).alias("first"))
        out = stored(met.groupBy("x", "y").agg(F.max("first").alias("first")), "minhash-pairs")
        for done in (rows, common, each, open_, leaders):
            forget(done)
        return out


def text_keys() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2")


def labelled_rows(docs: DataFrame, shingle: int = 5, percent: int = 80, m: int = 10, r: int = 3, cells: int = CELLS) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, component_id) of every row of ``docs`` with a doc_id; t1 and t2 are keys of its text."""
    found = NearDuplicates(docs, shingle, percent, m, r, cells)
    labels = found.run()
    reps = found.nodes.select("id", "rep").join(labels, F.col("id") == F.col("node"), "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    least = stored(least, "minhash-least")  # a plain table: Spark then splits a large component
    classes = stored(reps.join(least, "component").select(F.col("id").alias("c1"), "component_id"), "minhash-classes")
    rows = found.features.select("id", "t1", "t2", "c1", "n_shingles").join(classes, "c1", "left")
    return rows.select(F.col("id").alias("doc_id"), "t1", "t2", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, m: int = 10, r: int = 3, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text, any more)."""
    out = labelled_rows(docs, shingle, percent, m, r, cells).drop("t1", "t2")
    nulls = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nulls).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less every row whose doc_id isn't the least one of its text's component."""
    gone = labelled_rows(docs, shingle, percent).where("doc_id <> component_id").select("doc_id", "t1", "t2").distinct()
    own = fresh(docs, "__id", "__t1", "__t2")
    gone = gone.select(*[F.col(c).alias(o) for c, o in zip(("doc_id", "t1", "t2"), own)])
    on = [a == F.col(o) for a, o in zip((F.col("doc_id"), *text_keys()), own)]
    return docs.join(gone, on, "left_anti")


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, percent=85)


#: DuckDB: every pair with a shared shingle is measured; components are what can be reached over links.
OP5_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM texts WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_shared >= 85 * (p.n + q.n - n_shared)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

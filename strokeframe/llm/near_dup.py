"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup 2017): in round r every element of a set is thrown into one of
t bins with a value between r and r + 1, and a bin keeps its least value; after t rounds of hashed
placement, round t + k throws every element into bin k, so that every bin of a non-empty set fills.
Sketches agree in a coordinate with the probability of the sets' Jaccard similarity, and the number of
agreeing coordinates is concentrated about its mean.

Equal sets are one class. Classes that agree on a band are candidates; a candidate pair with sketches
too far apart is discarded (at the threshold the chance is below 10^-7), the others are verified on the
full sets. A band shared by many classes is not expanded into pairs: its members are compared with the
band's hub, and only those that are not in the hub's component with one another and with the rest, in
blocks of bounded size that return no more links than they join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .flat import Words, mix, slices
from .store import discard, written

COORDINATES, ROWS = 128, 4
#: Agreeing coordinates of COORDINATES below which a pair is discarded: 5.7 standard deviations below 0.8.
SLACK = 0.2
#: Sets of one side of a verification group.
GROUP = 256
_ROUND = np.uint64(0xD1342543DE82EF95)


def sketch(elements: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """uint32 array (sets, t) of the sets elements[bounds[i]:bounds[i+1]] of 64-bit hashes; 0 where a set is empty."""
    n = len(bounds) - 1
    best = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    live = np.flatnonzero(np.diff(bounds) > 0)
    for r in range(2 * t):
        if not len(live):
            break
        sizes = np.diff(bounds)[live]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(bounds[live] - ends + sizes, sizes)
        h = mix(elements[at] + np.uint64((r + 1) * int(_ROUND) & (1 << 64) - 1))
        bin_of = (h >> np.uint64(32)) % np.uint64(t) if r < t else np.full(len(h), r - t, np.uint64)
        value = (np.uint64(r) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, (np.repeat(live, sizes) * t + bin_of.astype(np.int64)), value)
        filled = (best.reshape(n, t)[live] != np.iinfo(np.uint64).max).all(axis=1)
        live = live[~filled]
    empty = best == np.iinfo(np.uint64).max
    out = (mix(best) >> np.uint64(32)).astype(np.uint32)
    out[empty] = 0
    return out.reshape(n, t)


def sets_of(column: pa.Array, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their counts."""
    hashes, bounds = Words(column).shingles(n)
    found = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
    return found, np.array([len(x) for x in found], np.int64)


def signatures(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, low, bands) of every row of ``docs``.

    set_hi and set_lo are 128 bits that depend on the set alone, low has the low byte of each coordinate, and
    bands a hash of each run of ROWS coordinates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets, counts = sets_of(b.column("text"), words)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            flat = np.concatenate(sets)
            s = sketch(flat, bounds)
            rows = s.reshape(len(counts), -1, ROWS).astype(np.uint64)
            band = np.zeros(rows.shape[:2], np.uint64)
            for k in range(ROWS):
                band = mix(band * _ROUND + rows[:, :, k])
            band = mix(band + np.arange(band.shape[1], dtype=np.uint64))
            digests = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(salt)), dtype=np.uint64)])
                digests.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
            at = pa.array(np.arange(len(counts) + 1) * band.shape[1], pa.int32())
            columns = {
                "doc_id": b.column("doc_id"), "n_shingles": pa.array(counts), "set_hi": pa.array(digests[0]), "set_lo": pa.array(digests[1]),
                "low": pa.array([x.tobytes() for x in s.astype(np.uint8)], pa.binary()),
                "bands": pa.ListArray.from_arrays(at, pa.array(band.reshape(-1).view(np.int64))),
            }
            yield pa.record_batch(columns)

    picked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_hi bigint, set_lo bigint, low binary, bands array<bigint>")


def _screen(pairs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b, low_a, low_b) that agree in at least ``least`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("low_a", "low_b"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union; texts: (rep, text).

    A group is a document a and at most GROUP of its partners: it reads the set of a first and streams the
    partners, so that a document with very many partners is many groups.
    """
    # numbered within 64 parts, so that a document's pairs are not sorted in one task
    number = F.row_number().over(W.partitionBy("a", "part").orderBy("b"))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(64))).withColumn("cut", F.floor((number - 1) / GROUP))
    hosts = dealt.select("a", "part", "cut").distinct().select("*", F.lit(0).alias("side"), F.col("a").alias("rep"))
    sides = hosts.unionByName(dealt.select("a", "part", "cut", F.lit(1).alias("side"), F.col("b").alias("rep")))
    with_text = sides.join(texts, "rep").select("a", "part", "cut", "side", "rep", "text")
    ordered = with_text.repartition("a", "part", "cut").sortWithinPartitions("a", "part", "cut", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for b in slices(batches, "text"):
            sets, _ = sets_of(b.column("text"), words)
            good = []
            for i, guest in enumerate(b.column("side").to_pylist()):
                if not guest:
                    own = sets[i]
                    continue
                both = len(np.intersect1d(own, sets[i], assume_unique=True))
                if 100 * both >= percent * (len(own) + len(sets[i]) - both):
                    good.append(i)
            found = b.take(pa.array(good, pa.int64()))
            yield pa.record_batch({"a": found.column("a"), "b": found.column("rep")})

    return ordered.mapInArrow(run, "a bigint, b bigint")


def connected(links: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b), the least node reachable.

    Rounds of large-star and small-star (Kiveris et al. 2014). A round shuffles the links and is written to
    the shared folder; the driver only learns whether it changed anything.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        # large-star: u's greater neighbours link to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its lesser neighbours link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(edges)
        # the links as a set: their number and a hash of 64 bits
        before, mark = mark, tuple(after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        edges = after
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _check_block(least: int, words: int, percent: int):
    """A function of one pair of blocks (rep, component, left, right, low, text) that gives the links between
    different components: every left row is compared with every right row."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets, sizes = sets_of(table.column("text"), words)
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        reps, component = (np.asarray(table.column(c)) for c in ("rep", "component"))
        left, right = (np.asarray(table.column(c)) for c in ("left", "right"))
        at = np.flatnonzero(right)
        joined = {c: c for c in set(component.tolist())}  # components linked so far need no further link

        def root(c: int) -> int:
            while joined[c] != c:
                joined[c] = c = joined[joined[c]]
            return c

        found = []
        for i in np.flatnonzero(left):
            agree = (low[at] == low[i]).sum(axis=1)
            fits = (agree >= least) & (component[at] != component[i]) & (100 * np.minimum(sizes[at], sizes[i]) >= percent * np.maximum(sizes[at], sizes[i]))
            near = at[fits]
            for j in near[np.argsort(-agree[fits], kind="stable")]:
                x, y = root(int(component[i])), root(int(component[j]))
                if x != y:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                        joined[max(x, y)] = min(x, y)
                        found.append((int(reps[i]), int(reps[j])))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _with_component(df: DataFrame, name: str, component: DataFrame | None, out: str) -> DataFrame:
    """``df`` with the component ``out`` of its column ``name``; what has none is its own."""
    if component is None:
        return df.withColumn(out, F.col(name))
    return df.join(component.toDF(name, "_c"), name, "left").withColumn(out, F.coalesce("_c", name)).drop("_c")


def _links(classes: DataFrame, docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame | None:
    """(rep, component) of the classes (rep, n_shingles, low, bands) that are linked with another; None if there are none.

    First every class is compared with the hub of each of its bands: the class with the most companions. Two
    classes that share a band are then both known to its hub. Among the classes of a hub, only those outside
    its component may still have links that matter; they are compared with the rest in blocks, and a block
    gives no more links than it joins components.
    """
    bands = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = written(bands.join(shared, "band"), "bands")
    companions = rows.groupBy("rep").agg(F.sum("k").alias("degree"))
    ranked = written(rows.join(companions, "rep"), "ranked")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("rep")).alias("order"), "n")).alias("h"))
    hubs = written(hubs.select("band", (-F.col("h.order")).alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    known = written(rows.join(hubs, "band").where("rep <> hub").select("hub", "rep", "hub_n", "n").distinct(), "known")
    if known.isEmpty():
        return None
    alive = known.select("rep").union(known.select("hub")).distinct()
    texts = docs.select(F.col(doc_id).cast("bigint").alias("rep"), F.col(text).alias("text"))
    # the same plan at every size: the documents are shuffled once, and what is alive is written
    texts = written(texts.join(alive.hint("merge"), "rep", "left_semi"), "texts")
    low = classes.select("rep", "low")
    least = int((percent / 100 - SLACK) * COORDINATES)

    pairs = known.where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    close = pairs.join(low.toDF("a", "low_a"), "a").join(low.toDF("b", "low_b"), "b").select("a", "b", "low_a", "low_b")
    screened = written(_screen(close, least), "screened")
    first = written(_verify(screened, texts, words, percent), "found")
    component = None if first.isEmpty() else written(connected(first).toDF("rep", "component"), "components")

    # joins by hub stand alone between tables, so that a hub with very many classes can be split among tasks
    hubs = written(_with_component(known.select("hub").distinct(), "hub", component, "home"), "hubs")
    members = written(_with_component(known.select("hub", "rep"), "rep", component, "component"), "members")
    members = written(members.join(hubs, "hub").withColumn("outside", F.col("component") != F.col("home")), "members")
    sizes = members.groupBy("hub").agg(F.count_if("outside").alias("r"), F.count_if(~F.col("outside")).alias("m"))
    sizes = written(sizes.where("r > 0 AND r + m > 1"), "sizes")
    r, m = (F.ceil(F.col(c) / GROUP).cast("int") for c in ("r", "m"))
    placed = members.join(sizes, "hub").select("hub", "rep", "component", "outside", r.alias("r"), m.alias("m"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("outside"), F.col("r")).otherwise(F.col("m"))).cast("int")
    placed = placed.withColumn("own", own)
    none = F.array().cast("array<int>")

    def upto(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(none)

    def side(i, j, kind, left, right):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"))

    # those outside: their blocks with one another (i <= j), and each with each block of the component's members
    me = F.col("own")
    among = F.transform(upto("r"), lambda o: side(F.least(me, o), F.greatest(me, o), "outside", me <= o, me >= o))
    across = F.transform(upto("m"), lambda o: side(me, o, "inside", F.lit(True), F.lit(False)))
    inside = F.transform(upto("r"), lambda o: side(o, me, "inside", F.lit(False), F.lit(True)))
    dealt = placed.withColumn("places", F.when(F.col("outside"), F.concat(among, across)).otherwise(inside))
    dealt = dealt.select("hub", "rep", "component", F.explode_outer("places").alias("p")).select("hub", "rep", "component", "p.*").where("i IS NOT NULL")
    blocks = written(dealt, "placed").join(low, "rep").join(texts, "rep")
    key = ["hub", "kind", "i", "j"]
    second = written(blocks.groupBy(*key).applyInArrow(_check_block(least, words, percent), "a bigint, b bigint"), "found")
    for done in (rows, ranked, known, screened, texts, hubs, members, sizes):
        discard(done)
    if second.isEmpty():
        return component
    # a component's least rep stands for it, so the links of both rounds make the final components
    return written(connected(first.unionByName(second)).toDF("rep", "component"), "components")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Words are split at white space with A-Z lower-cased; a document's set holds its distinct shingles of
    ``words`` words, or its whole sequence as one if it has fewer. Documents with
    100 * intersection >= percent * union are linked; component_id is the least doc_id reachable. Null and
    empty texts, and texts without words, have an empty set and are linked with nothing. A doc_id names one
    text; repeated rows are each returned. A row without doc_id has no component and is kept.

    Shingles are compared by hashes of 64 bits: that two different ones of a pair of texts of a million shingles each are
    taken for one has a chance of about 10^-7. Sets are equal if two sums of such hashes and the sizes are: among 10^12 different sets
    two are taken for equal with a chance of about 10^-15.
    """
    if percent < 60:
        raise ValueError("the sketches are banded for a similarity of 0.6 or more")
    sig = written(signatures(docs, words, doc_id, text), "signatures")
    key = ["set_hi", "set_lo", "n_shingles"]
    # equal sets are one class, represented by its least doc_id
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy(*key).agg(F.min(F.struct("doc_id", "low", "bands")).alias("m"))
    classes = written(classes.select(*key, F.col("m.doc_id").alias("rep"), F.col("m.low").alias("low"), F.col("m.bands").alias("bands")), "classes")
    component = _links(classes.select("rep", "n_shingles", "low", "bands"), docs, words, percent, doc_id, text)
    named = classes.select(*key, "rep")
    named = named.withColumn("component", F.col("rep")) if component is None else named.join(component, "rep", "left")
    named = named.select(*key, F.coalesce("component", "rep").alias("component"))
    joined = sig.select("doc_id", *key).join(named, key, "left")
    component_id = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component_id.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near duplicates stays (the least doc_id); all columns stay."""
    gone = near_duplicates(docs, words, percent, doc_id, text).where("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti")

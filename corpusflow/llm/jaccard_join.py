"""Exact Jaccard join of documents' shingle sets as a metric-space join.

**Outer pivots.** Most documents share nothing, so they are at distance 1 from every document
that could serve as a pivot, and no window around such pivots separates them. The outermost
pivots are therefore single shingles, in one order over the corpus, rare ones first. Under
the metric |x ∆ y| a set's nearest pivot is the first one that it contains: that is the
Voronoi region which is its home. Linked sets differ in few shingles (x has at most n - ceil(t n)
that y lacks), so a set's window reaches exactly that many pivots beyond its home: linked sets
meet in the region of the first pivot that they share. The order comes from document
frequencies in a table of fixed size; any order is exact, and rare ones first keep stock
passages from making large regions.

**Inner pivots.** A region's sets, in overlapping bands of size, are joined recursively. One of
them becomes the region's pivot and all others are compared with it. Regions whose sets are then
all in one component are finished, so a cluster of thousands of near copies costs a comparison
a set, not one a pair; what is left of a small region is joined by signatures in one task. Other
regions are cut into rings around the pivot, as wide as linked sets of the region's sizes can be apart: by
the triangle inequality these lie in one ring or in neighbouring ones, so each set is replicated
into the next ring, and each ring is a region of the next round.

Rings are cut, and pairs screened, by *signatures*: the parity of a set's shingles in each of
SIGN_BITS classes or, in long texts, of a larger power of two (half of which is folded out of it
by xor). Their Hamming distance is a metric and at most |x ∆ y|. A pair that it doesn't rule
out is decided by the texts' shingles. Regions that hold the same sets (the pivots of one
passage make many) are joined once.

Equal sets are one set from the start. A shingle is the 64-bit hash of its three words; two
different shingles of a measured pair count as one with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, Words, chunks, keyed, materialize, may_match, mix, small_batches, windows, with_key, without
from .hot import spread_join
from .order_minhash import components

#: Words of a shingle.
SIZE = 3
#: Document frequencies are counted for this power of two of shingle classes.
CLASS_BITS = 20
SLICES = 64
#: Words of more bytes are hashed one by one: their polynomial hashes may be alike by construction.
LONG = 32
#: A region of at most this many sets is joined in one task; twice as many in each further round.
SMALL = 1024
MOST_SMALL = 1 << 15
#: Classes of the smallest and the largest signatures.
SIGN_BITS = 1024
MOST_SIGN_BITS = 1 << 16
#: Bytes of text whose words and shingles a worker holds at once (one longer text is held alone).
AT_ONCE = 1 << 18
#: Bytes of rows that Spark hands to a worker at once (one longer row is handed alone).
BATCH_BYTES = 1 << 20
#: Sets that one task compares with a pivot.
SPOKES = 256
#: A region of at most this many sets loses, before the first round, those that no other can be linked with.
FEW = 32
#: Steps of the rarity of shingles to a doubling of their documents.
STEPS = 8


def word_hashes(words: Words) -> np.ndarray:
    hashes = words.hashes()
    for i in np.flatnonzero(words.end - words.start > LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(words.data[words.start[i] : words.end[i]].tobytes())
    return hashes


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: its 3-word windows, or all its words if they are fewer."""
    words = Words(data, offsets, lower=True)
    hashes = word_hashes(words)
    found, at = windows(hashes, words.doc, SIZE)
    cuts = np.searchsorted(words.doc[at], np.arange(words.n_docs + 1)) if len(at) else np.zeros(words.n_docs + 1, np.int64)
    first = np.concatenate([[0], np.cumsum(words.per_doc)])
    out = []
    for d, n in enumerate(words.per_doc):
        if n >= SIZE:
            out.append(np.unique(found[cuts[d] : cuts[d + 1]]))
        else:
            few = hashes[first[d] : first[d] + n]
            whole = np.full(min(n, 1), n, np.uint64)
            for h in few:
                whole = whole * np.uint64(MULT) + h
            out.append(mix(whole))
    return out


def signature(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each class of their low bits; long sets have more classes."""
    bits = min(max(SIGN_BITS, 1 << (len(s) // 2).bit_length()), MOST_SIGN_BITS)
    classes = (s & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(classes, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sign: bytes, size: int) -> np.ndarray:
    """A signature of ``size`` bytes out of one with as many or more."""
    x = np.frombuffer(sign, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _texts(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    return keyed(docs, key, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))


def set_rows(texts: DataFrame) -> DataFrame:
    """Of (doc_id, text): a row (doc_id, n, same, sign) per document, n the set's size, same its digest and
    sign its signature, and per task rows (slice, counts): documents with a shingle of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "same", "sign", "slice", "counts"]
        seen = None
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text"), AT_ONCE):
                sets = shingles(data, offsets)
                size = last - first
                if seen is None:
                    seen = np.zeros(1 << CLASS_BITS, np.int64)
                every = np.concatenate(sets)
                seen += np.bincount((every >> np.uint64(64 - CLASS_BITS)).astype(np.int64), minlength=len(seen))
                columns = [
                    batch.column("doc_id").slice(first, size),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([signature(s) for s in sets], pa.binary()),
                    pa.nulls(size, pa.int32()),
                    pa.nulls(size, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
        if seen is not None:
            parts = np.split(seen, SLICES)
            none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            columns = [*none, pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, "doc_id long, n long, same binary, sign binary, slice int, counts binary")


def rarity(counts: DataFrame) -> np.ndarray:
    """STEPS times the power of two of the documents with a shingle of each class (2**CLASS_BITS bytes,
    whatever the rows). Large tables have hundreds in every class: whole powers would all be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, some in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(some, np.int64)
        if sums:
            powers = [np.minimum(STEPS * np.log2(np.maximum(s, 1)), 255).astype(np.uint8).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(powers, pa.binary())], ["slice", "powers"])

    rows = counts.repartition("slice").mapInArrow(run, "slice int, powers binary").collect()  # SLICES rows
    return np.concatenate([np.frombuffer(r["powers"], np.uint8) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else np.zeros(1 << CLASS_BITS, np.uint8)


def pivots(texts: DataFrame, powers: np.ndarray, percent: int) -> DataFrame:
    """(pivot, doc_id, n, place): the outer pivots that each set's window reaches, by place in their order."""
    table = texts.sparkSession.sparkContext.broadcast(powers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text"), AT_ONCE):
                ids = batch.column("doc_id").slice(first, last - first).to_numpy(zero_copy_only=False)
                some, owner, sizes, places = [], [], [], []
                for i, s in enumerate(shingles(data, offsets)):
                    if not len(s):
                        continue
                    order = np.argsort(table.value[s >> np.uint64(64 - CLASS_BITS)], kind="stable")  # then by hash: s is sorted
                    reach = len(s) - -(-percent * len(s) // 100) + 1
                    some.append(s[order[:reach]])
                    owner.append(np.full(reach, ids[i], np.int64))
                    sizes.append(np.full(reach, len(s), np.int32))
                    places.append(np.arange(reach, dtype=np.int32))
                if some:
                    columns = [np.concatenate(some).view(np.int64), *map(np.concatenate, (owner, sizes, places))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pivot", "doc_id", "n", "place"])

    return texts.mapInArrow(run, "pivot long, doc_id long, n int, place int")


def _apart(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Hamming distances of signatures, each pair at the size of the smaller."""
    out = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
        size = min(len(x), len(y))
        out[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
    return out


def _by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each region in turn, of rows sorted by region."""
    every = (row for batch in batches for row in batch.to_pylist())
    for _, region in groupby(every, key=lambda r: r["region"]):
        yield list(region)


def _allowed(region: list[dict], percent: int, apart_only: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, j's) of the rows (n, sign) of a region, sorted by n: the j > i that sizes and signatures allow to
    be linked with i, of those with another value of ``apart_only``."""
    n = np.array([r["n"] for r in region])
    size = min(len(r["sign"]) for r in region)
    signs = np.stack([folded(r["sign"], size) for r in region])
    for i in range(len(region) - 1):
        last = int(np.searchsorted(percent * n[i + 1 :], 100 * n[i], "right"))
        some = np.arange(i + 1, i + 1 + last)
        if apart_only is not None:
            some = some[apart_only[some] != apart_only[i]]
        if len(some):
            apart = np.bitwise_count(signs[some] ^ signs[i]).sum(1, dtype=np.int64)
            yield i, some[(100 + percent) * apart <= (100 - percent) * (n[some] + n[i])]


def within(rows: DataFrame, percent: int) -> DataFrame:
    """Of (region, doc_id, n, root, sign, others), the pairs (hub, spoke) of sets of a region that are in
    different components and that sizes and signatures allow to be linked. A region is one task's:
    MOST_SMALL signatures at most. ``others`` are a set's regions of lesser number: two sets that
    share one of them are a pair there, so that a pair is made once, not in each region of both."""

    def joined(region: list[dict]) -> Iterator[tuple[int, int]]:
        region.sort(key=lambda r: r["n"])
        others = [set(r["others"]) for r in region]
        for i, some in _allowed(region, percent, np.array([r["root"] for r in region])):
            for j in some:
                if others[i].isdisjoint(others[j]):
                    yield tuple(sorted((region[i]["doc_id"], region[j]["doc_id"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region in _by_region(batches):
            found = list(joined(region))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["hub", "spoke"])

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "hub long, spoke long")


def hopeful(members: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Members (doc_id, n, most, region) out of those with ``size``, that of their region: regions of more than
    FEW sets whole, of others the sets that size and signature allow to be linked with another one there.

    Sets that share a pivot by chance, whose number grows faster than the rows', end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region in _by_region(batches):
            region.sort(key=lambda r: r["n"])
            kept = np.zeros(len(region), bool)
            for i, some in _allowed(region, percent):
                kept[some] = True
                kept[i] |= len(some) > 0
            if kept.any():
                yield pa.RecordBatch.from_pylist([{c: region[i][c] for c in schema.names} for i in np.flatnonzero(kept)], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("most", pa.float64()), ("region", pa.int64())])
    rows = members.where(F.col("size") <= FEW).join(signs.select("doc_id", "sign"), "doc_id").select(*schema.names, "sign")
    rows = rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "doc_id long, n int, most double, region long")
    return rows.unionByName(members.where(F.col("size") > FEW).drop("size"))


def distinct_regions(members: DataFrame) -> DataFrame:
    """``members`` of regions of two sets or more, one of the regions with the same sets each, with the region's ``size``."""
    one, other = (F.bit_xor(F.xxhash64("doc_id", F.lit(k))) for k in (1, 2))
    kinds = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), one.alias("one"), other.alias("other")).where("size > 1")
    kinds = kinds.groupBy("size", "one", "other").agg(F.min("region").alias("region")).select("region", "size")
    return spread_join(members, materialize(kinds, "jaccard-kinds", force=True), "region", "size", "doc_id")


def screened(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, spoke) whose sizes and signatures (doc_id, n, sign) allow a link."""
    hubs = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("spokes")).join(signs.select(F.col("doc_id").alias("hub"), F.col("n").alias("n_hub"), F.col("sign").alias("sign_hub")), "hub")
    rows = spread_join(pairs, hubs, "hub", "spokes", "spoke").join(signs.withColumnRenamed("doc_id", "spoke"), "spoke")
    rows = rows.where(100 * F.least("n", "n_hub") >= percent * F.greatest("n", "n_hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                both = batch.column("n_hub").to_numpy() + batch.column("n").to_numpy()
                allowed = (100 + percent) * _apart(batch.column("sign_hub"), batch.column("sign")) <= (100 - percent) * both
                yield batch.select(["hub", "spoke"]).filter(pa.array(allowed))

    return rows.select("hub", "spoke", "n_hub", "n", "sign_hub", "sign").mapInArrow(run, "hub long, spoke long")


def rings(rows: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Members (doc_id, n, most, region) of the next round: the sets (with region, pivot, size) of
    each region but its pivot, in rings around it."""
    pivots_ = rows.groupBy("region").agg(F.first("pivot").alias("doc_id"), F.count(F.lit(1)).alias("in_region"))
    pivots_ = pivots_.join(signs.select("doc_id", F.col("sign").alias("sign_hub")), "doc_id").drop("doc_id")
    met = spread_join(rows.where("doc_id <> pivot").select("doc_id", "n", "most", "region"), pivots_, "region", "in_region", "doc_id")
    met = met.join(signs.select("doc_id", "sign"), "doc_id").select("doc_id", "n", "most", "region", "sign_hub", "sign")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                away = pa.array(_apart(batch.column("sign_hub"), batch.column("sign")))
                yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "n", "most", "region"]).columns, away], ["doc_id", "n", "most", "region", "away"])

    met = met.mapInArrow(run, "doc_id long, n int, most double, region long, away long")
    width = F.col("most") * F.lit(2 * (100 - percent) / (100 + percent)) + 1e-6
    ring = F.floor(F.col("away") / width).cast("long")
    each = F.when(width >= SIGN_BITS, F.array(F.lit(0).cast("long"))).otherwise(F.array(ring, ring + 1))
    return met.select("doc_id", "n", "most", F.col("region").alias("within"), F.explode(each).alias("ring")).select("doc_id", "n", "most", F.xxhash64("within", "ring").alias("region"))


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, spoke, both, either): sizes of intersection and union of the pairs (hub, spoke).

    The spokes of a hub are dealt over tasks, at most about SPOKES in each, and the hub's text
    is sent to each of them once."""
    hubs = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("spokes")).withColumn("blocks", F.ceil(F.col("spokes") / SPOKES).cast("int"))
    dealt = spread_join(pairs, hubs, "hub", "spokes", "spoke").select("hub", "spoke", F.pmod(F.xxhash64("spoke"), "blocks").cast("int").alias("block"))
    wanted = materialize(pairs.select(F.col("hub").alias("doc_id")).union(pairs.select("spoke")).distinct(), "jaccard-wanted", force=True)
    some = may_match(texts, "doc_id", wanted, "doc_id").where("__may").join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    some = materialize(some, "jaccard-texts", force=True)
    spokes = dealt.join(some.withColumnRenamed("doc_id", "spoke"), "spoke").select("hub", "block", "spoke", "text")
    heads = hubs.join(some.withColumnRenamed("doc_id", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("spoke"), "text")
    rows = spokes.unionByName(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column("text"), AT_ONCE):
                part = batch.slice(first, last - first)
                out = []
                for h, s, x in zip(part.column("hub").to_pylist(), part.column("spoke").to_pylist(), shingles(data, offsets), strict=True):
                    if s is None:
                        hub = x
                        continue
                    both = int((hub[np.minimum(np.searchsorted(hub, x), len(hub) - 1)] == x).sum())
                    out.append((h, s, both, len(hub) + len(x) - both))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["hub", "spoke", "both", "either"])

    rows = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("spoke").asc_nulls_first())
    return rows.mapInArrow(run, "hub long, spoke long, both long, either long")


def _regions(members: DataFrame, roots: DataFrame | None, round_: int) -> DataFrame:
    """(region, pivot, size) of the regions that hold sets of different components."""
    least = F.min_by("doc_id", F.struct(F.xxhash64("doc_id", F.lit(round_)), "doc_id")).alias("pivot")
    found = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), least).where("size > 1")
    if roots is None:
        return found
    # only linked sets meet their roots: a region is settled if all its sets have one and the same
    same = members.join(roots, members["doc_id"] == roots["node"]).groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    return found.join(same.where("low = high").select("region", "size"), ["region", "size"], "left_anti")


def linked(texts: DataFrame, found: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(node, root) of linked sets: the least doc_id of each component of more than one.

    ``found``: rows of :func:`pivots`, stored; ``texts``: one document a set; ``signs``: (doc_id, n, sign)."""
    t = percent / 100.0
    # outer regions with one set are done; the others fall into overlapping bands of size
    shared = found.groupBy("pivot").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("pivot", "size")
    shared = materialize(shared, "jaccard-pivots", force=True)
    met = spread_join(may_match(found, "pivot", shared, "pivot").where("__may").drop("__may"), shared, "pivot", "size", "doc_id")
    step = -float(np.log(t)) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("long")
    met = met.select("pivot", "doc_id", "n", "place", F.explode(F.array(band, band + 1)).alias("band"))
    # of the first pivot that two sets share, at most n - place more follow: enough for a link with a set of the band?
    other = F.greatest(F.col("n") * F.lit(t), F.exp((F.col("band") - 1) * F.lit(step)))
    met = met.where(F.col("n") - F.col("place") >= (F.col("n") + other) * F.lit(t / (1 + t)) - 1e-6)
    members = met.select("doc_id", "n", F.exp((F.col("band") + 1) * F.lit(step)).alias("most"), F.xxhash64("pivot", "band").alias("region"))
    members = hopeful(distinct_regions(materialize(members, "jaccard-banded", force=True)), signs, percent)
    members = materialize(members, "jaccard-members", force=True)
    links, roots, round_ = None, None, 0
    while True:
        regions = materialize(_regions(members, roots, round_), "jaccard-regions", force=True)
        if regions.isEmpty():
            return members.limit(0).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root")) if roots is None else roots
        limit = min(SMALL << round_, MOST_SMALL)
        rows = materialize(spread_join(members, regions, "region", "size", "doc_id"), "jaccard-round", force=True)
        # first all sets with their region's pivot; then, most of a region being one component, the rest of small ones
        star = rows if roots is None else rows.where(F.col("size") > limit)
        pairs = star.where("doc_id <> pivot").select(F.col("pivot").alias("hub"), F.col("doc_id").alias("spoke")).distinct()
        pairs = screened(materialize(pairs, "jaccard-tried", force=True), signs, percent)
        if roots is not None:
            small = rows.where(F.col("size") <= limit).select("region", "doc_id")
            sets = small.groupBy("doc_id").agg(F.collect_list("region").alias("regions")).join(signs, "doc_id")  # a set has few regions: its window's
            sets = sets.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
            small = sets.withColumn("region", F.explode("regions")).withColumn("others", F.filter("regions", lambda r: r < F.col("region")))
            pairs = pairs.unionByName(within(small.select("region", "doc_id", "n", "root", "sign", "others"), percent)).distinct()
        pairs = materialize(pairs, "jaccard-pairs", force=True)
        new = materialize(measured(pairs, texts), "jaccard-measured", force=True)
        more = new.where(100 * F.col("both") >= percent * F.col("either")).select(F.col("hub").alias("a"), F.col("spoke").alias("b"))
        links = more if links is None else links.unionByName(more)
        new_roots = components(links)
        # a small region is done once its pairs were tried; the others go on if they hold several components still
        rest = rows.where("size > 2") if roots is None else rows.where(F.col("size") > limit)  # a pair was one with its pivot
        roots = new_roots
        unsettled = materialize(_regions(rest.select("region", "doc_id"), roots, round_).select("region", F.col("size").alias("left")), "jaccard-unsettled", force=True)
        rest = spread_join(rest, unsettled, "region", "left", "doc_id").drop("left")
        members = rings(rest.where(F.col("size") > limit), signs, percent).unionByName(rest.where(F.col("size") <= limit).select("doc_id", "n", "most", "region"))
        members = materialize(distinct_regions(materialize(members, "jaccard-rest", force=True)).drop("size"), "jaccard-members", force=True)
        round_ += 1


def join(docs: DataFrame, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the least id that links lead to.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of 3-word
    shingles (A-Z as a-z). Fewer words than three are one shingle; null and empty texts and texts
    without words have no shingles and no links. Repeated ids are documents of their own with one
    id; a null id is in no minimum, so a component of null ids alone has the id null."""
    small_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    plain = docs.schema[id_col].dataType.simpleString()
    docs, key = with_key(docs, id_col, ordered=True)
    texts = _texts(docs, key, text_col)
    rows = materialize(set_rows(texts), "jaccard-sets", force=True)
    sets = rows.where("slice IS NULL AND n > 0").groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    sets = materialize(sets, "jaccard-distinct", force=True)
    members = materialize(spread_join(rows.where("slice IS NULL AND n > 0").select("doc_id", "n", "same"), sets, "same", "copies", "doc_id").select("doc_id", "n", "first"), "jaccard-copies", force=True)
    powers = rarity(rows.where("slice IS NOT NULL").select("slice", "counts"))
    one = without(texts, "doc_id", members.where("doc_id <> first"), "doc_id")
    found = materialize(pivots(one, powers, percent), "jaccard-windows", force=True)
    roots = linked(texts, found, rows.where("slice IS NULL AND n > 0").select("doc_id", "n", "sign"), percent)
    named = sets.join(roots, sets["first"] == roots["node"], "left").select("first", "copies", F.coalesce("root", "first").alias("root"))
    out = spread_join(members, named, "first", "copies", "doc_id").select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    out = out.unionByName(rows.where("slice IS NULL AND n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    if key == id_col:
        return out.select(F.col("doc_id").cast(plain), "n_shingles", F.col("component_id").cast(plain))
    ids = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(id_col).alias("id"))
    out = materialize(out.join(ids, "doc_id"), "jaccard-named", force=True)
    least = out.groupBy("component_id").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    return spread_join(out, least, "component_id", "size", "doc_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))

"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification, connected components.

Circulant MinHash: one permutation places every shingle in a universe of cells, a second one orders the cells, and the k-th
coordinate of a signature is the least order among the document's cells shifted by k. So the coordinates of one shingle
are a window of consecutive entries of the second permutation.

Copies collapse into classes first: rows of equal shingle sets have equal digests. Classes are banded, and every bucket's
members are compared with its first one, the head. What a head leaves in several components is settled without pairing all
with all: its members are compared with the one nearest to the head, the centre, and then written as differences from the
centre. Two sets are alike only if they share enough of their differences, so members meet by an exact prefix filter over
those that occur in several components, rarest first. No link between a bucket's members is lost, and what sets merely have
in common with the centre pairs nobody. Links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.blocks import byte_blocks
from larkspur.llm.common import for_python, split_lower, written
from larkspur.llm.components import components

#: Cells of the universe, and coordinates of a signature.
UNIVERSE, COORDINATES = 1 << 20, 256
#: Each band has ROWS coordinates. The signature is cut twice, into neighbouring and into distant coordinates, which
#: makes 2 * 256 / 8 = 64 bands. Coordinates are used twice and depend on each other, so the share of pairs of similarity 0.8
#: that miss all bands is measured, not computed: about 1 in 10,000 (the tests draw such pairs).
ROWS = 8
BANDS = 2 * COORDINATES // ROWS
SEED = 20_240
#: Up to this many keys (16 bytes each) are broadcast to find the texts of classes that meet others; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Words whose hash a task remembers.
MEMORY = 500_000

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of word shingles."""

    def __init__(self, width: int):
        import xxhash

        self.hash, self.width, self.known = xxhash.xxh3_64_intdigest, width, {}

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted hashes of a text's distinct shingles; a shorter text is one shingle as a whole."""
        words = split_lower(text)
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        try:
            codes = list(map(known.__getitem__, words))
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = self.hash(w)
            codes = list(map(known.__getitem__, words))
        h, n = np.array(codes, dtype=np.uint64), min(self.width, len(words))
        total = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            total += mixed(h[i : len(h) - n + 1 + i] + np.uint64(i)) * MIX[i]
        return np.unique(mixed(total))


class Circulant:
    """Signatures and band hashes."""

    def __init__(self):
        random = np.random.Generator(np.random.PCG64(SEED))
        self.place = random.permutation(UNIVERSE).astype(np.uint32)
        order = random.permutation(UNIVERSE).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: COORDINATES - 1]]), COORDINATES)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        cells = self.place[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        found = np.full(COORDINATES, UNIVERSE, dtype=np.uint32)
        for at in range(0, len(cells), 4096):
            np.minimum(found, self.windows[cells[at : at + 4096]].min(axis=0), out=found)
        return found

    def buckets(self, signatures: np.ndarray) -> np.ndarray:
        """BANDS hashes for each signature; the band's number is part of the hash."""
        n = COORDINATES // ROWS
        near = signatures.reshape(-1, n, ROWS)
        far = signatures.reshape(-1, ROWS, n).transpose(0, 2, 1)
        bands = np.concatenate([near, far], axis=1).astype(np.uint64)
        total = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), bands.shape[:2]).copy()
        for i in range(ROWS):
            total = mixed(total ^ (bands[:, :, i] + np.uint64(1)) * MIX[i])
        return total.view(np.int64)


_TOOLS: dict[int, tuple[Shingler, Circulant]] = {}


def _tools(width: int) -> tuple[Shingler, Circulant]:
    """One set of tables for each worker process."""
    if width not in _TOOLS:
        _TOOLS[width] = Shingler(width), Circulant()
    return _TOOLS[width]


def _digest(shingles: np.ndarray) -> bytes:
    from hashlib import blake2b

    return blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, mark (of the text itself), n_shingles, digest (of the set; null if empty), buckets of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, circulant = _tools(width)
        for rows, texts in byte_blocks(batches, "text"):
            sets = [shingler.shingles(x) for x in texts]
            buckets = circulant.buckets(np.stack([circulant.signature(s) for s in sets])).reshape(-1)
            filled = np.array([len(s) > 0 for s in sets])
            ends = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("key"),
                    rows.column("mark"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets[np.repeat(filled, BANDS)])),
                ],
                names=["key", "mark", "n_shingles", "digest", "buckets"],
            )

    plain = docs.select(F.col(key).cast("long").alias("key"), mark_of(F.col(text)).alias("mark"), F.col(text).alias("text"))
    return for_python(plain).mapInArrow(run, "key long, mark string, n_shingles long, digest binary, buckets array<long>")


def mark_of(text: Column) -> Column:
    """Tells texts of equal keys apart; a null text is one of its own."""
    return F.md5(text.cast("binary"))


def sets_of(docs: DataFrame, key: str, text: str, width: int, nodes: DataFrame) -> DataFrame:
    """cid and shingles (array<long>) of the classes in nodes (cid, first_key, digest), from one row of each."""
    few = nodes.count() <= BROADCAST_KEYS
    wanted = nodes.select(F.col("first_key").alias("wanted")).distinct()
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = plain.join(F.broadcast(wanted) if few else wanted, F.col("key").eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _tools(width)[0]
        for part, texts in byte_blocks(batches, "text"):
            sets = [shingler.shingles(x) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(map(_digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "digest", "shingles"])

    found = for_python(rows).mapInArrow(run, "key long, digest binary, shingles array<long>")
    # a key may stand for several texts: the digest tells which is the class's own
    own = (found["digest"] == nodes["digest"]) & found["key"].eqNullSafe(nodes["first_key"])
    return found.join(nodes, own).select("cid", "shingles").dropDuplicates(["cid"])


def alike(a: Column, b: Column, both: Column, percent: int) -> Column:
    return 100 * both >= percent * (a + b - both)


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """Sets whose sizes differ more can't be similar enough."""
    return (100 * F.least(a, b)) >= percent * F.greatest(a, b)


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs, how many shingles only one of them has, and whether they are similar enough; on their full sets."""
    named = lambda c: sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"{c}_set"))
    joined = pairs.select("u", "v").join(named("v"), "v").join(named("u"), "u")
    a, b, both = F.size("u_set"), F.size("v_set"), F.size(F.array_intersect("u_set", "v_set"))
    sized = joined.select("u", "v", a.alias("a"), b.alias("b"), both.alias("both"))
    return sized.select("u", "v", (F.col("a") + F.col("b") - 2 * F.col("both")).alias("apart"), alike(F.col("a"), F.col("b"), F.col("both"), percent).alias("linked"))


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds the root of the component of the class `v`, itself where it has no link."""
    found = roots.select(F.col("node").alias("v"), F.col("root").alias("v_root"))
    return members.join(found, "v", "left").withColumn("root", F.coalesce("v_root", "v")).drop("v_root")


def of_several(members: DataFrame) -> DataFrame:
    """The members of the groups whose members are in several components."""
    several = members.groupBy("u").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a < z").select("u")
    return members.join(several, "u")


def excess(n: Column, apart: Column, percent: int) -> Column:
    """What a set of n shingles, `apart` of which differ from the centre, adds to the demand on shared differences.

    Sets x, y are alike iff (100 - percent) (|x| + |y|) >= (100 + percent) |x ^ y|, and |x ^ y| is the sum of their differences
    from a third set less twice those they share: iff 2 (100 + percent) * shared >= excess(x) + excess(y).
    """
    return (100 + percent) * apart - (100 - percent) * n


def candidates(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: the pairs of members of a group (u, v, root, centre) in different components that can be alike, by an exact prefix filter.

    Members become their differences from the centre. Those that one component alone has can't be shared across and go. Of
    k that are left a member must share `least` with any partner, so it shares one of its k - least + 1 rarest with it; and
    from the first shared one on, both must have as many left as the pair demands.
    """
    own = sets.select(F.col("cid").alias("v"), "shingles")
    middle = sets.select(F.col("cid").alias("centre"), F.col("shingles").alias("middle"))
    # dealt by the member, so that no group meets in one task
    apart = F.concat(F.array_except("shingles", "middle"), F.array_except("middle", "shingles"))
    placed = members.filter("v != centre").join(middle, "centre").join(own, "v")
    placed = placed.select(F.col("u").alias("g"), "v", "root", F.size("shingles").cast("long").alias("n"), apart.alias("apart"))
    placed = written(placed.withColumn("excess", excess(F.col("n"), F.size("apart").cast("long"), percent)), "differences")

    by_root = placed.groupBy("g", "root").agg(F.min("excess").alias("excess"))
    first = by_root.groupBy("g").agg(F.min(F.struct("excess", "root")).alias("first"))
    second = by_root.join(first, "g").filter(F.col("root") != F.col("first.root")).groupBy("g", "first").agg(F.min("excess").alias("second"))
    partner = F.when(F.col("root") == F.col("first.root"), F.col("second")).otherwise(F.col("first.excess"))
    least = F.greatest(F.lit(1), F.ceil((F.col("excess") + partner) / (2.0 * (100 + percent))))
    asked = placed.join(second, "g").select("g", "v", "root", "n", "excess", "apart", least.alias("least"))
    each = written(asked.filter(F.size("apart") >= F.col("least")).select("g", "v", "root", "n", "excess", "least", F.explode("apart").alias("f")), "each-difference")

    shares = each.groupBy("g", "f", "root").agg(F.count(F.lit(1)).alias("k"))
    shared = shares.groupBy("g", "f").agg(F.sum("k").alias("often"), F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    shared = shared.filter("roots > 1").select("g", "f", "often", "main")
    mine = Window.partitionBy("g", "v")
    useful = each.join(shared, ["g", "f"]).withColumn("k", F.count(F.lit(1)).over(mine)).filter(F.col("k") >= F.col("least"))
    useful = useful.withColumn("at", F.row_number().over(mine.orderBy("often", "f"))).filter(F.col("at") <= F.col("k") - F.col("least") + 1)
    index = written(useful.select("g", "f", "v", "root", "main", "n", "excess", (F.col("k") - F.col("at") + 1).alias("left")), "index")

    # members of a difference's main component meet those outside it, not each other
    outside = index.filter("root != main").select("g", "f", *[F.col(c).alias(f"o_{c}") for c in ("v", "root", "n", "excess", "left")])
    enough = 2 * (100 + percent) * F.least("left", "o_left") >= F.col("excess") + F.col("o_excess")
    found = outside.join(index, ["g", "f"]).filter((F.col("root") != F.col("o_root")) & ((F.col("root") == F.col("main")) | (F.col("o_v") < F.col("v"))) & enough & sizes_fit(F.col("n"), F.col("o_n"), percent))
    return found.select(F.least("v", "o_v").alias("u"), F.greatest("v", "o_v").alias("v")).distinct()


def linked(classes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """node, root of the classes (cid, digest, first_key, n, buckets) that have links."""
    banded = classes.select("cid", "n", F.explode("buckets").alias("bucket"))
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "cid")).alias(f"h{seed}") for seed in (1, 2)]
    heads = banded.groupBy("bucket").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("k"), *hashes).filter("k > 1")
    # bands that gather the same classes count once
    heads = heads.groupBy("head", "k", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket", "head")
    met = banded.join(heads, "bucket").groupBy("head", "cid").agg(F.first("n").alias("n"))
    met = written(met.select(F.col("head").alias("u"), F.col("cid").alias("v"), "n"), "members")
    nodes = written(classes.select("cid", "first_key", "digest").join(met.select(F.col("v").alias("cid")).distinct(), "cid"), "nodes")
    sets = written(sets_of(docs, key, text, width, nodes), "sets")
    sizes = met.filter("u = v").select("u", F.col("n").alias("u_n"))
    star = met.filter("u != v").join(sizes, "u").filter(sizes_fit(F.col("n"), F.col("u_n"), percent))
    star = written(compared(star, sets, percent), "compared")
    links = star.filter("linked").select("u", "v")
    roots = written(components(links), "roots")

    # the head is settled: it has been compared with all whose sizes fit
    members = met.filter("u != v").select("u", "v")
    near = members.join(star.select("u", "v", "apart"), ["u", "v"], "left")
    centres = near.groupBy("u").agg(F.min_by("v", F.struct(F.col("apart").isNull().alias("far"), "apart", "v")).alias("centre"))
    mixed_ = written(of_several(rooted(members, roots)).join(centres, "u"), "mixed-groups")
    if mixed_.isEmpty():
        return roots
    at = mixed_.filter("v = centre").select("u", F.col("root").alias("c_root"))
    second = mixed_.join(at, "u").filter("root != c_root").select(F.least("v", "centre").alias("u"), F.greatest("v", "centre").alias("v")).distinct()
    links = links.unionAll(written(compared(second, sets, percent), "compared").filter("linked").select("u", "v"))
    roots = written(components(links), "roots")
    left = written(of_several(rooted(mixed_.select("u", "v", "centre"), roots)), "mixed-groups")
    if left.isEmpty():
        return roots
    third = written(candidates(left, sets, percent), "candidates")
    links = links.unionAll(written(compared(third, sets, percent), "compared").filter("linked").select("u", "v"))
    return written(components(links), "roots")


def classified(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """key, mark, n_shingles, component_id, and component: the digest that names the component, null for empty sets."""
    rows = written(signed(docs, key, text, width), "signatures")
    # a class for each set, whatever the number of its copies: each task sends one row per class it has met
    classes = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("key").alias("first_key"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = linked(classes, docs, key, text, width, percent)
    firsts = roots.join(classes.select(F.col("cid").alias("node"), "first_key", "digest"), "node")
    least = firsts.groupBy("root").agg(F.min("first_key").alias("least"), F.min("digest").alias("component"))
    found = firsts.join(least, "root").select(F.col("node").alias("cid"), "least", "component", F.lit(True).alias("has_links"))
    named = classes.select("cid", "digest", "first_key").join(found, "cid", "left")
    ours = F.col("has_links").isNotNull()
    named = named.select("digest", F.when(ours, F.col("least")).otherwise(F.col("first_key")).alias("component_id"), F.when(ours, F.col("component")).otherwise(F.col("digest")).alias("component"))
    named = written(named, "class-components")
    # a class with a third of all rows is split by the adaptive skew join
    filled = rows.filter("n_shingles > 0").select("key", "mark", "n_shingles", "digest").join(named, "digest").drop("digest")
    bare = rows.filter("n_shingles = 0").select("key", "mark", "n_shingles", F.col("key").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return filled.unionByName(bare)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept.

    Rows are linked where the sets of their `width`-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; fewer
    words: the sequence as one) have a Jaccard similarity of at least `percent` / 100. component_id is the least key
    reachable by links, kept whether that is the row's own. A null text, or one without words, has no shingles and no
    links. Repeated rows are links of each other; rows of equal keys are kept or not alike. A null key counts as larger
    than any other. An empty table gives no rows. Other columns of docs aren't read.
    """
    found = classified(docs, key, text, width, percent)
    return found.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row stays, as it is: that of the least key.

    A null key counts as larger than any other; among rows of equal keys that of the least hash of its text stays. Rows of
    equal keys and texts count as one. Rows without shingles are no near-duplicates of any and stay. An empty table stays
    empty; other columns, whatever their names, come back untouched.
    """
    found = written(classified(docs, key, text, width, percent).select("key", "mark", "component"), "found")
    filled = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("late"), "key", "mark")).alias("r"))
    stay = written(filled.select("r.key", "r.mark").unionAll(found.filter("component IS NULL").select("key", "mark")).distinct(), "stay")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("k"), mark_of(F.col(text)).alias("m"))
    left = whole.join(stay, F.col("k").eqNullSafe(F.col("key")) & F.col("m").eqNullSafe(F.col("mark")), "left_semi").dropDuplicates(["k", "m"])
    return left.select("row.*")

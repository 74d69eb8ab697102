"""N-gram Jaccard join: groups of documents linked by shared word shingles, by signature trees.

1. Sketch. A set's shingles are dealt by hash range into P parts. Sets with a Jaccard similarity of t %
   differ in at most (100 - t) * (a + b) / (100 + t) shingles, so with more parts than that, at least one
   part is the same in both. One signature a part goes to the shuffle: linked sets always meet. Sets of
   about one size share P (a size class); a set also joins the next class if a partner may be there.
   A signature that many sets of one task have is folded into one row before the shuffle.
2. Sets with a signature in common are tied to the least id that has it. There are spare parts, so a linked
   set shares m signatures or more with its partner. Ties to an id that a set meets in few signatures are
   dropped if all of them together are fewer than m / 2: of two linked sets' m common signatures one at
   least then keeps both ties. What stays tied is a rough group; it holds every link but is no link yet.
   Most documents are tied to none and are done. Equal sets are folded into one.
3. In each rough group a signature tree is built: nodes hold the OR of their sets' bitmaps and the range
   of their sizes. A dual traversal drops pairs of nodes whose greatest possible overlap is too small,
   and pairs that are one component already; the pairs of sets that remain are counted exactly.
4. A tree that would hold more than a block (BLOCK sets or BLOCK_HASHES hashes) is cut: sets of about one size
   are dealt into bins, the tree's upper nodes, with their own bitmaps and ranges of sizes. The upper part of the
   dual traversal works on these alone: pairs of bins that can't link, or that are one component already, are
   dropped before any set is sent. Each pair that is left is traversed below. In groups of more than BINS bins
   sets first go, with their fellows in blocks, to a set that they are tied to: to the least one, then to those
   that they weren't linked through yet. Trees over these find most components, whose bins needn't meet any more.

Defined results: null and empty texts have an empty set, linked with nothing; a document with fewer words
than a shingle has its whole sequence as one; rows with a null id keep their size and get a null
component; rows that repeat an id are one node; an empty table gives an empty result; columns other than
id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, give_back, packed, shared_dir, table, written
from .components import components
from .shingles import mix, shingle_set

#: Sets in one block of a large rough group, and hashes in them: 8 MB.
BLOCK, BLOCK_HASHES = 1024, 1 << 20
#: Bins of a group from which on components are looked for before bins meet.
BINS = 16
#: Bits of a bin's bitmap.
BIN_BITS = 1 << 13
#: Signatures of one task that are held and folded at a time.
FOLD = 1 << 18
#: Owners of one signature among those held from which on it is folded.
HOT = 64
LEAF, FANOUT = 16, 8

_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


# --- sketch ---------------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def size_class(size: int) -> int:
    """The upper end of size's class; each class reaches half as far again as the one before."""
    top = 2
    while top < size:
        top += max(1, top // 2)
    return top


@lru_cache(maxsize=1024)
def parts(top: int, t: int) -> np.ndarray:
    """Lower bounds of a class's parts.

    One part more than sets can differ in would do; spare ones are added so that all but very few sets needn't
    send empty parts, which match by chance, and so that linked sets share several.
    """
    k = 2 * top * (100 - t) // (100 + t)
    spare = 2 + k // 16 + int(2 * (k + 1) * np.exp(-(2 * top / 3) / (k + 1))) if k else 0
    n = k + 1 + spare
    return np.array([int(x) for x in (np.arange(n, dtype=object) * (1 << 64)) // n], np.uint64)


def signatures(h: np.ndarray, t: int) -> list[tuple[int, int, np.ndarray]]:
    """(class, m, signatures) of a set's sorted hashes, for each class that a linked set may be in.

    m: how many signatures it shares at least with a linked set of that class; 0 if that isn't known.
    """
    size = len(h)
    most = 100 * size // t
    top = size_class(size)
    spread = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _K1))])
    out = []
    while True:
        starts = parts(top, t)
        at = np.searchsorted(h, starts)
        ends = np.append(at[1:], size)
        full = ends > at
        sig = mix(spread[ends] - spread[at] + (np.arange(1, len(starts) + 1, dtype=np.uint64) + np.uint64(top << 32)) * _K2)
        # equal parts, less those that may be equal for being empty
        m = len(starts) - (100 - t) * (size + min(top, most)) // (100 + t) - int(len(full) - np.count_nonzero(full))
        out.append((top, m, sig[full]) if m > 0 else (top, 0, sig))
        if top >= most:
            return out
        top = size_class(top + 1)


ROW = "kind int, key long, id long, other long, class int, m int, digest binary"
DOC, SIGNATURE, EDGE = 0, 1, 2
#: m of a tie that is always kept.
ALWAYS = -1


def _sketch(n: int, t: int):
    names = [x.split()[0] for x in ROW.split(", ")]

    def rows(kind, key, ids, other, class_=None, m=None, digests=None):
        size = len(key)
        ints = [pa.array(np.zeros(size, np.int32) if x is None else x.astype(np.int32)) for x in (class_, m)]
        digests = pa.nulls(size, pa.binary()) if digests is None else pa.array(digests, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(key.view(np.int64)), pa.array(ids, pa.int64()), pa.array(other, pa.int64()), *ints, digests], names=names)

    def fold(held):
        sig = np.concatenate([s for _, _, _, s in held])
        sizes = [len(s) for _, _, _, s in held]
        owner, class_, m = (np.repeat(np.array([x[i] for x in held], np.int64), sizes) for i in range(3))
        order = np.lexsort((owner, sig))
        sig, owner, class_, m = sig[order], owner[order], class_[order], m[order]
        first = np.r_[True, sig[1:] != sig[:-1]]
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        hot = (np.diff(np.append(starts, len(sig))) >= HOT)[group]
        kept = ~hot | first
        yield rows(SIGNATURE, sig[kept], owner[kept], owner[kept], class_[kept], np.where(hot, ALWAYS, m)[kept])
        if hot.any():
            pairs = np.unique(np.stack([owner[hot], owner[starts][group[hot]]], 1), axis=0)
            pairs = np.ascontiguousarray(pairs[pairs[:, 0] != pairs[:, 1]].T)
            yield rows(EDGE, mix(pairs[0].astype(np.uint64)), pairs[0], pairs[1])

    def run(batches):
        held, n_held = [], 0
        for batch in batches:
            ids, sizes, digests = batch.column(0).to_pylist(), [], []
            for id, text in zip(ids, batch.column(1), strict=True):
                h = shingle_set(text.as_py(), n)
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                if len(h) and id is not None:
                    for class_, m, sig in signatures(h, t):
                        held.append((id, class_, m, sig))
                        n_held += len(sig)
                    if n_held >= FOLD:
                        yield from fold(held)
                        held, n_held = [], 0
            yield rows(DOC, np.frombuffer(b"".join(x[:8] for x in digests), np.uint64), ids, sizes, digests=digests)
        if held:
            yield from fold(held)
        held = None
        give_back()

    return run


def sketch(docs: DataFrame, n: int, t: int, folder: str) -> DataFrame:
    """A row for each document (its size and set), and the edges between documents that meet."""
    rows = docs.mapInArrow(_sketch(n, t), ROW)
    # documents and edges are spread by their own keys; signatures meet by theirs
    least = F.expr(f"CASE WHEN kind = {SIGNATURE} THEN min(id) OVER (PARTITION BY key) ELSE other END")
    met = rows.withColumn("other", least).where(f"kind <> {SIGNATURE} OR other <> id")
    return written(met.drop("key"), f"{folder}/met")


def ties(found: DataFrame) -> DataFrame:
    """(u, v) of the ties that are needed for no link to be lost, from sketch's rows."""
    met = found.where(f"kind = {SIGNATURE}").groupBy("id", "other", "class").agg(F.count(F.lit(1)).alias("c"), F.max("m").alias("m"), F.min("m").alias("least"))
    low = (F.col("c") * 4 < F.col("m")) & (F.col("least") != ALWAYS)
    lost = F.sum(F.when(low, F.col("c")).otherwise(0)).over(Window.partitionBy("id", "class"))
    met = met.withColumn("low", low).withColumn("lost", lost).where("NOT low OR 2 * lost >= m")
    return met.select(F.col("id").alias("u"), F.col("other").alias("v")).unionByName(found.where(f"kind = {EDGE}").select(F.col("id").alias("u"), F.col("other").alias("v"))).distinct()


# --- signature tree -------------------------------------------------------------------------------


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def tie(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def bitmap(h: np.ndarray, bits: int) -> np.ndarray:
    row = np.zeros(bits, bool)
    row[(h & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(row).view(np.uint64)


def _bitmaps(sets: list[np.ndarray], bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set's hashes, and how many more hashes than bits the set has."""
    bits = bits or 1 << min(16, max(8, int(4 * max(len(h) for h in sets) - 1).bit_length()))
    maps = np.stack([bitmap(h, bits) for h in sets])
    extra = np.array([len(h) for h in sets], np.int64) - np.bitwise_count(maps).sum(1, dtype=np.int64)
    return maps, extra


class Level:
    """Nodes of one height: OR of the bitmaps below, range of sizes, most extra hashes, first child, past the last."""

    def __init__(self, maps, low, high, extra, first, last):
        self.maps, self.low, self.high, self.extra, self.first, self.last = maps, low, high, extra, first, last

    def above(self, width: int) -> Level:
        starts = np.arange(0, len(self.low), width)
        return Level(np.bitwise_or.reduceat(self.maps, starts, 0), np.minimum.reduceat(self.low, starts), np.maximum.reduceat(self.high, starts), np.maximum.reduceat(self.extra, starts), starts, np.minimum(starts + width, len(self.low)))

    def may_link(self, a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
        """Whether some set below a and some set below b can reach t %, by sizes and by common bits."""
        out = np.zeros(len(a), bool)
        step = max(1, (1 << 20) // max(1, self.maps.shape[1]))
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            common = np.bitwise_count(self.maps[x] & self.maps[y]).sum(1, dtype=np.int64)
            most = np.minimum(common + np.minimum(self.extra[x], self.extra[y]), np.minimum(self.high[x], self.high[y]))
            sized = (100 * self.high[x] >= t * self.low[y]) & (100 * self.high[y] >= t * self.low[x])
            out[i : i + step] = sized & ((100 + t) * most >= t * (self.low[x] + self.low[y]))
        return out


def tree_links(sets: list[np.ndarray], t: int) -> Union:
    """The components of sets under exact links of t %, found by dual traversal of a signature tree."""
    size = len(sets)
    found = Union(size)
    order = sorted(range(size), key=lambda i: (len(sets[i]), int(sets[i][0])))
    maps, extra = _bitmaps(sets)
    sizes = np.array([len(h) for h in sets])
    order_a = np.array(order)
    levels = [Level(maps[order_a], sizes[order_a], sizes[order_a], extra[order_a], None, None)]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].above(LEAF if len(levels) == 1 else FANOUT))
    pairs_a = pairs_b = np.zeros(1, np.int64)
    for height in range(len(levels) - 1, 1, -1):
        node, below = levels[height], levels[height - 1]
        a, b = [], []
        for x, y in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
            p, q = np.meshgrid(np.arange(node.first[x], node.last[x]), np.arange(node.first[y], node.last[y]), indexing="ij")
            up = (p <= q) if x == y else np.ones(p.shape, bool)
            a.append(p[up])
            b.append(q[up])
        pairs_a, pairs_b = np.concatenate(a), np.concatenate(b)
        ok = below.may_link(pairs_a, pairs_b, t)
        pairs_a, pairs_b = pairs_a[ok], pairs_b[ok]
        if not len(pairs_a):
            return found
    if len(levels) == 1:
        return found
    leaves, base = levels[1], levels[0]
    near_first = np.argsort(pairs_b - pairs_a, kind="stable")  # ties made early spare pairs later
    for x, y in zip(pairs_a[near_first].tolist(), pairs_b[near_first].tolist(), strict=True):
        p = range(leaves.first[x], leaves.last[x])
        q = range(leaves.first[y], leaves.last[y])
        roots = {i: found.root(order[i]) for i in {*p, *q}}
        if len({*roots.values()}) == 1:
            continue
        open_pairs = [(i, j) for i in p for j in q if i < j and roots[i] != roots[j]]
        a, b = np.array(open_pairs).T
        ok = base.may_link(a, b, t)
        for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            i, j = order[i], order[j]
            if found.root(i) != found.root(j) and linked(sets[i], sets[j], t):
                found.tie(i, j)
    return found


def linked(x: np.ndarray, y: np.ndarray, t: int) -> bool:
    """Exactly: 100 * |x and y| >= t * |x or y|, of sorted distinct hashes."""
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= t * (len(x) + len(y) - common)


# --- exact links inside rough groups --------------------------------------------------------------


def _sets(n: int):
    """(id, text) -> (id, size, lead, hashes)."""

    def run(batches):
        for batch in batches:
            made = [shingle_set(x.as_py(), n) for x in batch.column("text")]
            size = pa.array([len(h) for h in made], pa.int64())
            lead = pa.array([int(h[0]) >> 1 if len(h) else None for h in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, lead, pa.array([h.tobytes() for h in made], pa.binary())], names=["id", "size", "lead", "hashes"])

    return run


def _tiles(t: int):
    """Runs of rows of one tile -> an edge for each set that isn't its component's first in the tile."""

    def solve(ids, sets):
        if len(ids) < 2:
            return []
        found = tree_links(sets, t)
        return [(ids[i], ids[r]) for i in range(len(ids)) if (r := found.root(i)) != i]

    def run(batches):
        tile, ids, sets = None, [], []
        for batch in batches:
            out = []
            for key, id, h in zip(batch.column("tile").to_pylist(), batch.column("id").to_pylist(), batch.column("hashes"), strict=True):
                if key != tile:
                    out += solve(ids, sets)
                    tile, ids, sets = key, [], []
                ids.append(id)
                sets.append(np.frombuffer(h.as_py(), np.uint64))
            yield _edges(out)
        yield _edges(solve(ids, sets))
        ids = sets = None
        give_back()

    return run


def _edges(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["u", "v"])


def solve_tiles(tiles: DataFrame, sets: DataFrame, t: int, path: str) -> DataFrame:
    """tiles: (tile, id). Exact links (u, v) inside each tile, enough to tie its components."""
    rows = tiles.join(sets, "id").select("tile", "id", "hashes")
    return written(rows.repartition("tile").sortWithinPartitions("tile", "id").mapInArrow(_tiles(t), "u long, v long"), path)


BIN = "rough long, own long, bin long, low long, high long, extra long, bitmap binary"
#: Bins hold sets whose sizes differ by this factor at most.
WIDTH = 1.1


def size_classes(t: int) -> int:
    """How many classes of sizes apart two sets that reach t % can be."""
    return math.ceil(math.log(100 / max(t, 1)) / math.log(WIDTH)) + 1


def _bins():
    """Rows (rough, own, bin, size, hashes) in order of bin -> a row for each bin: range of sizes, most extra hashes, OR of bitmaps."""
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = [x.split()[0] for x in BIN.split(", ")]

    def run(batches):
        now, node, low, high, extra = None, None, 0, 0, 0
        for batch in batches:
            out = []
            for rough, own, bin_, size, raw in zip(*[batch.column(c).to_pylist() for c in ("rough", "own", "bin", "size", "hashes")], strict=True):
                if now != (rough, own, bin_):
                    if now:
                        out.append((*now, low, high, extra, node.tobytes()))
                    now, node, low, high, extra = (rough, own, bin_), np.zeros(BIN_BITS // 64, np.uint64), size, 0, 0
                bits = bitmap(np.frombuffer(raw, np.uint64), BIN_BITS)
                node, low, high = node | bits, min(low, size), max(high, size)
                extra = max(extra, size - int(np.bitwise_count(bits).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        last = [(*now, low, high, extra, node.tobytes())] if now else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in last], k) for i, k in enumerate(kinds)], names=names)

    return run


def _open_pairs(t: int):
    """Pairs of bins -> those that some two sets below may link in, by the test of the tree's nodes."""

    def side(batch, s):
        maps = np.stack([np.frombuffer(x, np.uint64) for x in batch.column(f"bitmap{s}").to_pylist()])
        return Level(maps, *[batch.column(f"{c}{s}").to_numpy() for c in ("low", "high", "extra")], None, None)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = side(batch, 1), side(batch, 2)
                n = len(a.low)
                both = Level(*[np.concatenate([getattr(a, c), getattr(b, c)]) for c in ("maps", "low", "high", "extra")], None, None)
                ok = pa.array(both.may_link(np.arange(n), np.arange(n) + n, t))
                yield batch.select(["rough", "bin1", "bin2"]).filter(ok)

    return run


def exact_links(docs: DataFrame, members: DataFrame, met: DataFrame, n: int, t: int, folder: str, block: int = BLOCK, hashes: int = BLOCK_HASHES) -> DataFrame:
    """members: (id, rough) of distinct sets in rough groups of two or more. Returns links (u, v)."""
    texts = docs.join(broadcast_if_small(members.select("id")), "id", "left_semi")
    sets = written(texts.select("id", "text").mapInArrow(_sets(n), "id long, size long, lead long, hashes binary"), f"{folder}/sets")
    sized = written(members.join(sets.select("id", "size", "lead"), "id"), f"{folder}/sized")
    groups = sized.groupBy("rough").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    large = written(groups.where((F.col("n") > block) | (F.col("s") > hashes)).select("rough"), f"{folder}/large")
    if large.isEmpty():
        return solve_tiles(members.select(F.col("rough").alias("tile"), "id"), sets, t, f"{folder}/links")
    inside = written(sized.join(broadcast_if_small(large), "rough", "left_semi"), f"{folder}/inside")
    small = sized.join(broadcast_if_small(large), "rough", "left_anti").select(F.xxhash64("rough", F.lit(-1)).alias("tile"), "id")
    links = solve_tiles(small, sets, t, f"{folder}/links-0")

    def blocks_of(n: str, s: str):
        return F.greatest(F.ceil(F.col(n) * 2 / block), F.ceil(F.col(s) * 2 / hashes))

    def by_hub(tied: DataFrame, path: str) -> DataFrame:
        """(tile, id): the sets of tied (id, size, hub) with their hub, in blocks."""
        tied = written(tied.select("id", "size", "hub"), f"{path}-tied")
        counts = written(tied.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).select("hub", blocks_of("n", "s").alias("blocks")), f"{path}-blocks")
        placed = tied.join(broadcast_if_small(counts), "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("k"))
        heads = placed.select(F.col("hub").alias("id"), "hub", "k").distinct()
        return placed.unionByName(heads).distinct().select(F.xxhash64("hub", "k").alias("tile"), "id")

    ends = inside.withColumn("root", F.col("id"))
    huge = written(inside.groupBy("rough").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).where(blocks_of("n", "s") > BINS).select("rough"), f"{folder}/huge")
    if not huge.isEmpty():
        # each set with the least one that it is tied to
        many = written(inside.join(broadcast_if_small(huge), "rough", "left_semi").select("id", "size").distinct(), f"{folder}/many")
        near = met.groupBy("u").agg(F.min("v").alias("hub"))
        first = solve_tiles(by_hub(many.join(near, many.id == near.u), f"{folder}/near"), sets, t, f"{folder}/links-1")
        # then with the others, where these links don't tie them yet
        tied = written(first.groupBy("u").agg(F.min("v").alias("w")), f"{folder}/first")
        of = lambda c: met.join(tied.select(F.col("u").alias(c), F.col("w").alias(f"w{c}")), c, "left")
        cross = of("u").join(tied.select(F.col("u").alias("v"), F.col("w").alias("wv")), "v", "left").where("coalesce(wu, u) <> coalesce(wv, v)").select(F.col("u").alias("id"), F.col("v").alias("hub"))
        second = solve_tiles(by_hub(cross.join(many, "id"), f"{folder}/cross"), sets, t, f"{folder}/links-2")
        found = written(components(first.unionByName(second), f"{folder}/two"), f"{folder}/two-roots")
        links = links.unionByName(first).unionByName(second)
        ends = inside.join(found, inside.id == found.node, "left").select("rough", "id", "size", F.coalesce("root", "id").alias("root"))

    # bins: sets of one large component, or of many small ones, of about one size
    big = ends.groupBy("rough", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).where((F.col("n") * 4 > block) | (F.col("s") * 4 > hashes))
    big = written(big.select("rough", "root", F.col("root").alias("own")), f"{folder}/big")
    ends = ends.join(broadcast_if_small(big), ["rough", "root"], "left").withColumn("width", F.floor(F.log(WIDTH, F.col("size").cast("double"))))
    ends = written(ends.select("rough", "id", "size", "own", "width"), f"{folder}/ends")
    per = ends.groupBy("rough", "own", "width").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).select("rough", "own", "width", blocks_of("n", "s").alias("blocks"))
    dealt = ends.alias("e").join(broadcast_if_small(written(per, f"{folder}/widths")).alias("p"), F.expr("e.rough = p.rough AND e.own <=> p.own AND e.width = p.width"))
    binned = dealt.select("e.rough", "e.own", "e.id", "e.size", F.xxhash64("e.own", "e.width", F.pmod(F.xxhash64("e.id"), F.col("p.blocks"))).alias("bin"))
    binned = written(binned, f"{folder}/binned")
    # a rough group that is one component has no pairs of bins
    open_ = binned.groupBy("rough").agg(F.count_if(F.col("own").isNull()).alias("loose"), F.countDistinct("own").alias("owns")).where("loose > 0 OR owns > 1").select("rough")
    rows = binned.join(broadcast_if_small(written(open_, f"{folder}/open")), "rough", "left_semi").join(sets.select("id", "hashes"), "id")
    nodes = written(rows.repartition("rough", "bin").sortWithinPartitions("rough", "own", "bin").select("rough", "own", "bin", "size", "hashes").mapInArrow(_bins(), BIN), f"{folder}/nodes")

    # the upper part of the dual traversal: bins that may link and aren't one component
    # only bins whose ranges of sizes allow a link meet: each side is looked for under its own class of sizes and those near it
    near = F.explode(F.sequence(F.lit(-size_classes(t)), F.lit(size_classes(t))))
    classed = nodes.withColumn("width", F.floor(F.log(WIDTH, F.col("low").cast("double"))))
    side = lambda s, *more: classed.select("rough", *more, *[F.col(c).alias(f"{c}{s}") for c in ("own", "bin", "low", "high", "extra", "bitmap")])
    first = side(1, "width")
    second = side(2, "width", near.alias("near")).withColumn("width", F.col("width") + F.col("near")).drop("near")
    pairs = first.join(second, ["rough", "width"]).where(f"bin1 <= bin2 AND NOT coalesce(own1 = own2, false) AND 100 * high1 >= {t} * low2 AND 100 * high2 >= {t} * low1")
    pairs = written(pairs.mapInArrow(_open_pairs(t), "rough long, bin1 long, bin2 long").select(F.xxhash64("rough", "bin1", "bin2").alias("tile"), "rough", "bin1", "bin2"), f"{folder}/pairs")
    ends_of = pairs.select("tile", "rough", F.col("bin1").alias("bin")).unionByName(pairs.select("tile", "rough", F.col("bin2").alias("bin"))).distinct()
    tiles = ends_of.join(binned, ["rough", "bin"]).select("tile", "id")
    return links.unionByName(solve_tiles(tiles, sets, t, f"{folder}/links-3"))


def jaccard_join(docs: DataFrame, n: int = 5, t: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hashes: int = BLOCK_HASHES) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (least id reachable by links of t %)."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "jaccard")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = sketch(docs, n, t, folder)
    all_docs = found.where(f"kind = {DOC}").select("id", F.col("other").alias("n"), "digest")
    met = written(ties(found), f"{folder}/ties")
    rough = written(components(met, f"{folder}/rough"), f"{folder}/rough-roots")

    # equal sets are one; its least id stands for it
    named = written(all_docs.where("id IS NOT NULL AND n > 0").join(rough.withColumnRenamed("node", "id"), "id").select("id", "digest", F.col("root").alias("rough")).distinct(), f"{folder}/named")
    heads = written(named.groupBy("digest").agg(F.min("id").alias("head"), F.min("rough").alias("rough")), f"{folder}/heads")
    groups = heads.groupBy("rough").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(heads.join(groups, "rough", "left_semi").select(F.col("head").alias("id"), "rough").distinct(), f"{folder}/members")
    links = exact_links(docs, members, met, n, t, folder, block, hashes)
    same = named.join(heads.select("digest", "head"), "digest").where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v"))
    roots = written(components(links.unionByName(same), f"{folder}/exact"), f"{folder}/roots")
    out = all_docs.join(roots, all_docs.id == roots.node, "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, t: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are their group's least id, with the columns they came with."""
    found = jaccard_join(docs, n, t, id_col, text_col)
    gone = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), f"{shared_dir(docs.sparkSession, 'jaccard')}/gone")
    rows = docs.select(packed(docs), F.col(f"`{id_col}`").cast("long").alias("id"))
    return rows.join(broadcast_if_small(gone), F.col("id") == F.col("gone"), "left_anti").select("row.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=3, t=90)

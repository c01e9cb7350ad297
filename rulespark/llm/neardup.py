"""Near duplicates from bottom-k sketches of one hash function.

1. Every text becomes the set of its hashed word shingles. Equal sets collapse to one representative,
   by two 64-bit lanes.
2. Values are ordered from rare to common: by the power of two of their count in every fourth text,
   which a table of ``SLOTS`` bytes keeps by the first bits of the value, the greatest of those that
   fall together; then by hash. The table shapes the order only, so any table gives the same links.
   It must know the values of more than ``SHORT_LIST`` texts, else long lists chain all texts.
3. A set retains its sketch, the ``width`` smallest hashes, and its first n - ceil(t n) + 1 values in
   that order, its *prefix*, and posts them. Two sets with similarity t or more share a value of both
   prefixes, so none is lost here, and a shared passage ties no texts together unless it makes up
   nearly all of them. Values that many sets of a task retain are posted once for all of them, which
   are tied to the one that stands for them.
4. Short inverted lists give overlap counts per pair; the union-sketch estimate drops pairs that
   cannot reach t. Where sketch values in long lists leave it open, the two sketches are compared
   whole. Long lists give no pairs: each member that has the value in its prefix is tied to one.
5. Both kinds of ties form clusters. A cluster's full sets are compared exactly, block by block;
   a large cluster is first compared with one centre, and a pair is skipped if the triangle
   inequality of the Jaccard distance rules it out or both are already linked to the centre.
6. Verified links form the connected components.

The only chance in it is the estimate of step 4: it drops a pair at the threshold with probability
under ``MISS``. Sets with at most ``width`` shingles are never estimated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .components import connected_components
from .scratch import Scratch

WIDTH = 24
#: Inverted lists above this length give ties to one member instead of pairs.
SHORT_LIST = 32
#: Bytes of the table of common values that all tasks know; half as many values at most are noted in it.
SLOTS = 1 << 24
#: One of so many texts, by its hash, has its values counted for that table.
COUNTED = 4
#: Clusters with more shingles than this are compared in blocks of about so many.
BLOCK = 400_000
#: The chance that the estimate drops a linked pair.
MISS = 1e-12
#: Members of clusters are broadcast up to this count (40 bytes each), else joined by shuffle.
BROADCAST_ROWS = 400_000
NULL_ID = -(1 << 63)


def set_lanes(values: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit identities of a set of hashes; zeros for the empty set."""
    if not len(values):
        return 0, 0
    one, two = T.mix(values), T.mix(values * T.U64(T.BASE) + T.U64(len(values)))
    h = T.mix(np.array([one.sum(dtype=T.U64), np.bitwise_xor.reduce(one), two.sum(dtype=T.U64), np.bitwise_xor.reduce(two)], dtype=T.U64))
    lanes = T.mix(h[::2] * T.U64(T.BASE) + h[1::2]).view(np.int64)
    return int(lanes[0]) or 1, int(lanes[1])


def set_id(values: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    """The first lane; for first lanes that different sets have (``clashes``), both lanes mixed."""
    a, b = set_lanes(values)
    return a if a not in clashes else int(T.mix(np.array([a, b], np.int64).view(T.U64)).sum(dtype=T.U64).view(np.int64)) or 1


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for part in T.slices(batches):
        buf, offs = T.packed(part.column(part.schema.get_field_index("text")))
        yield part, T.shingle_sets(buf, offs, k)


def _sketcher(k: int, width: int):
    """Rows (did, th, text): (did, th, n, sid, lane, low); ``low`` is the sketch in hash order, the whole set of a text whose values are counted."""

    def run(batches):
        for part, sets in _sets(batches, k):
            lanes = [set_lanes(s) for s in sets]
            whole = part.column(1).to_numpy() % COUNTED == 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in lanes], pa.int64()), pa.array([b for _, b in lanes], pa.int64()), T.lists([T.signed(s if w else s[:width]) for s, w in zip(sets, whole.tolist(), strict=True)], pa.int64())],
                names=["did", "th", "n", "sid", "lane", "low"],
            )

    return run


def prefix_length(n: int, per_cent: int) -> int:
    return n - math.ceil(per_cent * n / 100) + 1


POSTS = "v long, sid long, n int, hidden int, sketch boolean, must boolean, weight int"


def slot_of(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each value in a table whose length is a power of two, 2 at least."""
    return (values >> T.U64(65 - len(table).bit_length())).astype(np.int64)


def _retained(s: np.ndarray, classes: np.ndarray | None, width: int, per_cent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, whether each is of the sketch, of the prefix) of a set in hash order; ``classes`` as in step 2."""
    prefix = prefix_length(len(s), per_cent)
    if classes is None:
        at = np.arange(min(len(s), max(width, prefix)))
        return s[at], at < width, at < prefix
    order = np.argsort(classes, kind="stable")
    sketch, must = order < width, np.arange(len(s)) < prefix
    keep = sketch | must
    return s[order[keep]], sketch[keep], must[keep]


class _Poster:
    """The posts of one task: rows (v, sid, n, hidden, sketch, must, weight), one a retained value.

    ``hidden`` counts sketch values that were not posted; ``weight`` is over the limit of short lists
    where a post stands for others of the task, of which those that must are tied to it by a list of
    their own.
    """

    def __init__(self, short_list: int):
        self.many = short_list + 1
        self.stands: dict[int, int | None] = {}  # values that many sets of this task retain, and the set that stands for them

    def rows(self, sids: np.ndarray, sizes: np.ndarray, retained: list) -> list[np.ndarray]:
        v, sketch, must = (np.concatenate([r[i] for r in retained]) for i in range(3))
        of = np.repeat(np.arange(len(sids)), [len(r[0]) for r in retained])
        weight, keep = np.ones(len(v), np.int32), np.ones(len(v), bool)
        order = np.argsort(v, kind="stable")
        new = np.ones(len(v), bool)
        new[1:] = v[order[1:]] != v[order[:-1]]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(v)))
        heavy = count >= self.many
        if self.stands:
            heavy |= np.isin(v[order[first]], np.fromiter(self.stands, T.U64, len(self.stands)))
        ties = []
        for a, n in zip(first[heavy].tolist(), count[heavy].tolist(), strict=True):
            rows = order[a : a + n]
            value = int(v[rows[0]])
            keep[rows] = False
            bound = rows[must[rows]]
            if self.stands.get(value) is None and (value not in self.stands or len(bound)):
                # sids are sorted, so the first row is the least; without one that must, any marks the list as long
                lead = (bound if len(bound) else rows)[0]
                self.stands[value] = int(sids[of[lead]]) if len(bound) else None
                keep[lead], weight[lead] = True, self.many
            if len(bound):
                ties.append(np.column_stack([sids[of[bound]], np.full(len(bound), self.stands[value], np.int64)]))
        hidden = np.bincount(of[~keep & sketch], minlength=len(sids))
        cols = [T.signed(v[keep]), sids[of[keep]], sizes[of[keep]], hidden[of[keep]], sketch[keep], must[keep], weight[keep]]
        if ties:
            pairs = np.unique(np.concatenate(ties), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            own = T.signed(T.mix(pairs[:, 0].view(T.U64) * T.U64(T.BASE) + T.mix(pairs[:, 1].view(T.U64))))
            z = np.zeros(2 * len(pairs), np.int64)
            more = [np.concatenate([own, own]), pairs.T.ravel(), z, z, z > 0, z == 0, z + self.many]
            cols = [np.concatenate(x) for x in zip(cols, more, strict=True)]
        return cols


def _poster(k: int, width: int, per_cent: int, table: np.ndarray, clashes: frozenset[int], short_list: int):
    def run(batches):
        seen: set[int] = set()  # copies within a task post once
        task = _Poster(short_list)
        for _, sets in _sets(batches, k):
            named = {set_id(s, clashes): s for s in sets if len(s)}
            fresh = named.keys() - seen
            seen |= fresh
            if not fresh:
                continue
            sids = np.array(sorted(fresh), np.int64)
            sets = [named[z] for z in sids.tolist()]
            sizes = np.array([len(s) for s in sets])
            flat, ends = np.concatenate(sets), np.cumsum(sizes)
            kind = table[slot_of(flat, table)]
            hot = np.add.reduceat(kind > 0, ends - sizes, dtype=np.int64) > 0
            retained = [_retained(s, kind[e - len(s) : e] if h else None, width, per_cent) for s, e, h in zip(sets, ends.tolist(), hot.tolist(), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32()]
            cols = task.rows(sids, sizes, retained)
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(cols, kinds, strict=True)], names=["v", "sid", "n", "hidden", "sketch", "must", "weight"])

    return run


def similar(a: int, n: int, m: int, per_cent: int) -> bool:
    return 100 * a >= per_cent * (n + m - a)


def block_links(left: list, right: list, per_cent: int) -> list[tuple[int, int]]:
    """Verified links between two lists of (sid, set, distance to the centre or None, linked to the centre).

    Links that cannot join anything new within this block are left out; all others are exact.
    ``right`` may be ``left`` itself.
    """
    same_side = right is left
    every = left if same_side else [*left, *right]
    base = 0 if same_side else len(left)
    far = 1 - per_cent / 100 + 1e-9
    sizes = np.array([len(s) for _, s, _, _ in every], dtype=np.int64)
    values, ids = np.unique(np.concatenate([s for _, s, _, _ in every]), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    dist = np.array([np.nan if d is None else d for _, _, d, _ in every])
    group = np.arange(len(every))
    near = np.array([z for _, _, _, z in every], dtype=bool)
    if near.any():
        group[near] = group[near][0]
    mark = np.zeros(len(values), dtype=np.uint8)
    right_sizes, right_ids, right_dist = sizes[base:], ids[starts[base] :], dist[base:]
    right_starts = starts[base:] - starts[base]
    out = []
    for i in range(len(left)):
        n = sizes[i]
        fits = (100 * np.minimum(right_sizes, n) >= per_cent * np.maximum(right_sizes, n)) & (group[base:] != group[i])
        if every[i][2] is not None:
            fits &= ~(np.abs(right_dist - dist[i]) > far)
        if same_side:
            fits[: i + 1] = False
        if not fits.any():
            continue
        own = ids[starts[i] : ends[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[right_ids], right_starts, dtype=np.int64)
        mark[own] = 0
        for j in np.flatnonzero(fits & (100 * shared >= per_cent * (n + right_sizes - shared))).tolist():
            if group[base + j] != group[i]:
                group[group == group[base + j]] = group[i]
                out.append((left[i][0], right[j][0]))
    return out


def _runs(batches: Iterator[pa.RecordBatch], key: int):
    """Consecutive rows (as tuples) with equal first ``key`` values."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() if not pa.types.is_list(c.type) and not pa.types.is_string(c.type) else c for c in batch.columns), strict=True):
            if row[:key] != now:
                if rows:
                    yield now, rows
                now, rows = row[:key], []
            rows.append(row[key:])
    if rows:
        yield now, rows


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links_batch(links: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=LINKS)


def _values(cell) -> np.ndarray:
    return np.asarray(cell.values).view(T.U64)


def _small_clusters(per_cent: int):
    def run(batches):
        for _, rows in _runs(batches, 1):
            members = [(sid, _values(s), None, False) for sid, s in rows]
            if links := block_links(members, members, per_cent):
                yield _links_batch(links)

    return run


def _to_centre(per_cent: int):
    """Rows (cluster, first, sid, set), the centre first: (cluster, sid, set, distance, linked)."""

    def run(batches):
        now = centre = None
        for batch in batches:
            cluster, sids, sets = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            is_centre = batch.column(1).to_pylist()
            dist, near = [], []
            for c, z, s in zip(cluster, is_centre, sets, strict=True):
                s = _values(s)
                if c != now or z == 0:
                    now, centre = c, s
                a = len(np.intersect1d(centre, s, assume_unique=True))
                dist.append(1 - a / (len(centre) + len(s) - a))
                near.append(similar(a, len(centre), len(s), per_cent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sets, pa.array(dist, pa.float64()), pa.array(near, pa.bool_())], names=["cluster", "sid", "set", "dist", "near"])

    return run


def _blocks(per_cent: int):
    """Rows (cluster, lb, rb, side, sid, set, dist, near) sorted: links between the two sides of each block pair."""

    def run(batches):
        for (_, lb, rb), rows in _runs(batches, 3):
            sides = ([], [])
            for side, sid, s, d, near in rows:
                sides[side].append((sid, _values(s), d, near))
            if links := block_links(sides[0], sides[0] if lb == rb else sides[1], per_cent):
                yield _links_batch(links)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, per_cent: int = 80, width: int = WIDTH, short_list: int = SHORT_LIST, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept, component_key, text_hash) for every row of ``docs``.

    Rows are linked if 100 * intersection >= per_cent * union of their shingle sets; component_id is
    the smallest id reachable over links, kept whether it is the row's own. Words are runs of
    non-white-space bytes after lower-casing A-Z. A null or wordless text has the empty set and is
    linked with nothing, its own component with a null component_key. A null id is less than any other
    and stays null in the result. Rows are judged by their texts: rows that share an id are not linked
    by it, and rows with equal sets are one class whatever their ids. text_hash is ``xxhash64`` of the
    text. Extra columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    tmp = Scratch(spark, "neardup")
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    rows, sketches, table, clashes = _rows(src, tmp, shingle, width)
    # rows of hot sets are aggregated before they are dealt out
    reps = tmp.save(rows.filter("n > 0").groupBy("sid").agg(F.min(F.struct("did", "th")).alias("r"), F.max("n").alias("n")).select("sid", "r.did", "r.th", "n"))
    posts = _posts(src, tmp, _poster(shingle, width, per_cent, table, clashes, short_list))
    clusters = connected_components(_ties(posts, sketches, width, per_cent, short_list), tmp).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
    clusters = tmp.save(reps.join(clusters, "sid"))
    tmp.drop(posts, sketches)
    sizes = clusters.groupBy("cluster").agg(F.sum("n").alias("shingles"))
    members = tmp.save(clusters.select("sid", "did", "th", "cluster").join(sizes, "cluster"))
    links = _verified(src, members, tmp, shingle, per_cent, block, clashes)
    found = connected_components(links, tmp).select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    classes = tmp.save(reps.join(found, "sid", "left").select("sid", "did", F.coalesce("comp", "sid").alias("comp")))
    least = classes.groupBy("comp").agg(F.min("did").alias("least"))
    classes = tmp.save(classes.join(least, "comp").select(F.col("sid").alias("of"), "comp", "least"))
    out = rows.join(classes, F.col("sid") == F.col("of"), "left").withColumn("least", F.coalesce("least", "did"))
    plain = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(plain("did").alias(id_col), F.col("n").alias("n_shingles"), plain("least").alias("component_id"), (F.col("did") == F.col("least")).alias("kept"), F.col("comp").alias("component_key"), F.col("th").alias("text_hash"))


def _rows(src: DataFrame, tmp: Scratch, shingle: int, width: int) -> tuple[DataFrame, DataFrame, np.ndarray, frozenset[int]]:
    """((did, th, n, sid) of every row, (sid, sketch) of every set, the table of common values, first lanes that different sets have)."""
    full = tmp.save(src.mapInArrow(_sketcher(shingle, width), "did long, th long, n long, sid long, lane long, low array<long>"))
    # two different sets have one first lane about once in 2**64 pairs: none, or a handful at the largest scale
    clashes = frozenset(r.sid for r in full.groupBy("sid").agg(F.min("lane").alias("a"), F.max("lane").alias("b")).filter("a <> b").select("sid").collect())
    sid = F.col("sid")
    if clashes:
        mixed = F.udf(lambda a, b: int(T.mix(np.array([a, b], np.int64).view(T.U64)).sum(dtype=T.U64).view(np.int64)) or 1, "long")
        sid = F.when(F.col("sid").isin(*clashes), mixed("sid", "lane")).otherwise(F.col("sid"))
    rows = tmp.save(full.select("did", "th", "n", sid.alias("sid")))
    sketches = tmp.save(full.filter("n > 0").groupBy(sid.alias("sid")).agg(F.min(F.slice("low", 1, width)).alias("sketch")))
    counts = tmp.save(full.filter(F.pmod("th", F.lit(COUNTED)) == 0).select(F.explode("low").alias("v")).groupBy("v").count().filter(F.col("count") > 1))
    table = _common(counts)
    tmp.drop(full, counts)
    return rows, sketches, table, clashes


def _common(counts: DataFrame) -> np.ndarray:
    """The powers of two of the counts (v, count), by ``slot_of`` the value; 0 for values that are not noted."""
    power = F.floor(F.log2("count")).cast("byte")
    powers = sorted((r.p, r.n) for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect())
    # the least power of two that at most half as many counts reach as there are slots
    total = sum(n for _, n in powers)
    at = 0
    while at < len(powers) and total > SLOTS // 2:
        total -= powers[at][1]
        at += 1
    table = np.zeros(min(SLOTS, max(2, 1 << (4 * total).bit_length())), np.int8)
    if at < len(powers):
        slot = F.shiftrightunsigned("v", 65 - len(table).bit_length()).cast("int")
        top = counts.filter(F.col("count") >= F.lit(1 << powers[at][0])).groupBy(slot.alias("slot")).agg(F.max(power).alias("p")).toArrow()
        table[top["slot"].to_numpy()] = top["p"].to_numpy()
    return table


def _posts(src: DataFrame, tmp: Scratch, poster) -> DataFrame:
    """(v, sid, n, hidden, sketch, must, m, bound, tie): the inverted lists that stand for two sets or more.

    ``m`` is how many, ``bound`` how many of them must, ``tie`` the least of those.
    """
    by = Window.partitionBy("v")
    most = [F.max(c).alias(c) for c in ("n", "hidden", "sketch", "must", "weight")]
    must = F.when(F.col("must"), F.col("weight")).otherwise(0)
    return tmp.save(
        src.mapInArrow(poster, POSTS).repartition("v").groupBy("v", "sid").agg(*most)
        .select("*", F.sum("weight").over(by).alias("m"), F.sum(must).over(by).alias("bound"), F.min(F.when(F.col("must"), F.col("sid"))).over(by).alias("tie")).filter("m > 1").drop("weight")
    )


def _ties(posts: DataFrame, sketches: DataFrame, width: int, per_cent: int, short_list: int) -> DataFrame:
    """(a, b): pairs of short lists that the estimate lets pass, and members that must of long lists with their least."""
    long = F.col("m") > short_list
    # of each set, the sketch values whose matches are not counted
    unseen = posts.groupBy("sid").agg((F.max("hidden") + F.count_if(F.col("sketch") & long)).alias("unseen")).filter("unseen > 0")
    short = posts.filter(~long | (F.col("must") & (F.col("bound") <= short_list))).select("v", "sid", "n", "sketch", long.alias("long"))
    least = least_overlap(width, per_cent)
    x, y = short.alias("x"), short.alias("y")
    a, b = unseen.withColumnsRenamed({"sid": "a", "unseen": "p"}), unseen.withColumnsRenamed({"sid": "b", "unseen": "q"})
    n, m, shared = F.col("n"), F.col("m"), F.col("shared")
    most = shared + F.least(F.coalesce("p", F.lit(0)), F.coalesce("q", F.lit(0)))
    # two sets that are their own sketches are counted, others estimated; with one of each nothing can be said
    reach = lambda c: F.when(F.greatest(n, m) <= width, 100 * c >= per_cent * (n + m - c)).otherwise((c >= least) | (F.least(n, m) <= width))
    pairs = (
        x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.sid") < F.col("y.sid")) & (100 * F.least("x.n", "y.n") >= per_cent * F.greatest("x.n", "y.n")))
        .groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
        .agg(F.count_if(F.col("x.sketch") & F.col("y.sketch") & ~F.col("x.long")).cast("int").alias("shared"), F.max("x.n").alias("n"), F.max("y.n").alias("m"))
        .join(a, "a", "left").join(b, "b", "left").filter(reach(most))
        .join(sketches.withColumnsRenamed({"sid": "a", "sketch": "s"}), "a").join(sketches.withColumnsRenamed({"sid": "b", "sketch": "t"}), "b")
        .filter(reach(F.size(F.array_intersect("s", "t")))).select("a", "b")
    )
    bound = posts.filter(F.col("must") & (F.col("bound") > short_list)).select(F.col("tie").alias("a"), F.col("sid").alias("b"))
    return pairs.union(bound)


def least_overlap(width: int, per_cent: int) -> int:
    """The largest overlap count that pairs at the threshold fall short of with probability under ``MISS``."""
    p, total = per_cent / 100, 0.0
    for c in range(width + 1):
        total += math.comb(width, c) * p**c * (1 - p) ** (width - c)
        if total > MISS:
            return c
    return width


def _verified(src: DataFrame, members: DataFrame, tmp: Scratch, shingle: int, per_cent: int, block: int, clashes: frozenset[int]) -> DataFrame:
    """Exact links inside the clusters."""
    few = members.count() <= BROADCAST_ROWS
    wanted = members.withColumnsRenamed({"sid": "want", "did": "rep", "th": "rep_th"})

    def sets(batches):
        for part, made in _sets(batches, shingle):
            keep = pa.array([set_id(s, clashes) == w for s, w in zip(made, part.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), T.lists([T.signed(s) for s in made], pa.int64())], names=["sid", "cluster", "shingles", "set"]).filter(keep)

    full = src.join(F.broadcast(wanted) if few else wanted, (F.col("did") == F.col("rep")) & (F.col("th") == F.col("rep_th"))).select("text", "want", "cluster", "shingles")
    full = tmp.save(full.mapInArrow(sets, "sid long, cluster long, shingles long, set array<long>").dropDuplicates(["sid"]))
    link = "a long, b long"
    small = full.filter(F.col("shingles") <= block).select("cluster", "sid", "set")
    small_links = small.repartition("cluster").sortWithinPartitions("cluster", "sid").mapInArrow(_small_clusters(per_cent), link)
    large = full.filter(F.col("shingles") > block)
    if large.isEmpty():
        return small_links
    # the member that shares most with the others would be best; any member is a cheap stand-in
    centres = large.groupBy("cluster").agg(F.min(F.struct(F.xxhash64("sid"), "sid")).alias("c")).select("cluster", F.col("c.sid").alias("centre"))
    spread = F.pmod(F.xxhash64("sid"), F.lit(64))
    centre_sets = large.join(centres, ["cluster"]).filter("sid = centre").select("cluster", "sid", "set")
    lead = centre_sets.select("cluster", F.lit(0).alias("first"), "sid", "set", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("salt"))
    rest = large.select("cluster", F.lit(1).alias("first"), "sid", "set", spread.alias("salt"))
    placed = lead.union(rest).repartition("cluster", "salt").sortWithinPartitions("cluster", "salt", "first").select("cluster", "first", "sid", "set")
    near = placed.mapInArrow(_to_centre(per_cent), "cluster long, sid long, set array<long>, dist double, near boolean").dropDuplicates(["sid"])
    near = tmp.save(near)
    star = near.filter("near").join(centres, "cluster").filter("sid <> centre").select(F.col("centre").alias("a"), F.col("sid").alias("b"))
    # numbers of blocks, by shingles
    size = lambda test: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.when(test, F.size("set"))), F.lit(0)) / F.lit(block))).cast("long")
    near = near.join(near.groupBy("cluster").agg(size(~F.col("near")).alias("many"), size(F.col("near")).alias("linked"), F.count_if(~F.col("near")).alias("loose")), "cluster")
    own = lambda total: F.pmod(F.xxhash64("sid", F.lit(7)), F.col(total))
    # unlinked x unlinked (each unordered pair of blocks once), then unlinked x linked
    loose = near.filter(~F.col("near")).withColumn("b", own("many"))
    many = F.col("many")
    as_left = loose.select("cluster", F.col("b").alias("lb"), F.explode(F.sequence(F.col("b"), many - 1)).alias("rb"), F.lit(0).alias("side"), "sid", "set", "dist", "near")
    as_right = loose.filter("b > 0").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("lb"), F.col("b").alias("rb"), F.lit(1).alias("side"), "sid", "set", "dist", "near")
    to_linked = loose.select("cluster", F.col("b").alias("lb"), F.explode(F.sequence(many, many + F.col("linked") - 1)).alias("rb"), F.lit(0).alias("side"), "sid", "set", "dist", "near")
    grid = near.filter("near and loose > 0").withColumn("b", own("linked") + many)
    linked_right = grid.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("lb"), F.col("b").alias("rb"), F.lit(1).alias("side"), "sid", "set", "dist", "near")
    cells = as_left.union(as_right).union(to_linked).union(linked_right)
    block_pairs = cells.repartition("cluster", "lb", "rb").sortWithinPartitions("cluster", "lb", "rb", "side", "sid").mapInArrow(_blocks(per_cent), link)
    return small_links.union(star).union(block_pairs)

"""N-gram Jaccard self-join by the chosen-path method.

A text is the set of its five-word shingles (a shorter text: one shingle of all
its words). Equal sets are joined by their 128-bit digest. For the others, 64
minimum hashes stand for the set, and a run splits the sets recursively: a
bucket's own random choice names hash positions, and sets go to the bucket of
each position's value. Similar sets share a position's value with a chance equal
to their similarity. Buckets of up to ``LEAF`` sets are compared by their
sketches, larger ones are split again: the first ``DEPTH`` times on one position,
then on two positions at once, by which a pair at the threshold has children in
common as often as not however deep it goes. A bucket that holds more than ``KEPT``
of the one it was split from (half of it, where it was split on two positions) does
not come apart (it holds copies of one text) and is not split further:
its sets are compared with a few pivots from among them, and only those that
are linked to none of the pivots' class meet the others, in pairs of blocks. The number of runs follows from the recall
that is asked for. What the sketches may link is one candidate component; within
it all pairs are compared exactly on the whole shingle sets, so a link between
members is found even if no run met that pair.

Edge cases: texts without a word (null, empty) link to nothing and are their own
class; rows with equal texts are copies of each other, whatever their ids; the
class id is the smallest doc_id of the class, nulls aside; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import word_list
from twinloom.llm.graph import connected_components, groups, in_blocks, local_labels, met
from twinloom.storage import written

SHINGLE = 5
THRESHOLD = 0.8
#: Chance that a pair at the threshold is met; links within a candidate component do not hang on it.
RECALL = 0.999
SKETCH = 64
#: Sets a bucket (or block) may hold to be compared at once.
LEAF = 256
#: Sets of a component that are compared exactly with as many others at once; pairs of such blocks are dealt evenly.
BLOCK = 128
#: Splits on one position; further ones are on BRANCHES positions.
DEPTH = 3
BRANCHES = 2
#: A bucket with more than this share of the one it was split from on one position does not come apart: its sets are as similar as linked ones.
KEPT = 0.75
#: Sets of a bucket that does not come apart which all of it is compared with first.
PIVOTS = 8
#: Shingles a set of a block has on average at most; blocks of longer ones hold fewer.
SET_SHINGLES = 2048
#: Chance that the sketches of a pair at the threshold agree too seldom to be looked at.
SKETCH_MISS = 1e-5
#: Up to so many candidates (16 bytes each) are broadcast to the texts.
BROADCAST_ROWS = 500_000

_rng = np.random.default_rng(20240)
_MUL = (_rng.integers(0, 2**63, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64)
_word_ids: dict[bytes, int] = {}


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold has met with the given chance.

    Of a pair's SKETCH positions k agree. A run starts at a position of its own, and its further DEPTH - 1 splits fall on any;
    from there on the pair stays together in some branch with at least the chance that solves f = 1 - (1 - f k / SKETCH) ** BRANCHES.
    """
    if threshold >= 1:
        return 1
    at = np.arange(SKETCH + 1)
    share = at / SKETCH
    chance = np.array([math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k) for k in at.tolist()])
    deeper = np.ones(SKETCH + 1)
    for _ in range(200):
        deeper = 1 - (1 - deeper * share) ** BRANCHES
    lost = 1 - share ** (DEPTH - 1) * deeper
    for runs in range(1, SKETCH + 1):
        # of the first positions of the runs j agree, a hypergeometric number
        missed = 0.0
        for k in range(SKETCH + 1):
            ways = [math.comb(k, j) * math.comb(SKETCH - k, runs - j) for j in range(runs + 1)]
            missed += chance[k] * sum(w * lost[k] ** j for j, w in enumerate(ways)) / math.comb(SKETCH, runs)
        if missed <= 1 - recall:
            return runs
    return SKETCH


def agree_for(threshold: float) -> int:
    """Positions that two sketches have to share: a pair at the threshold has fewer with SKETCH_MISS at most (0.8: 36)."""
    fewer = 0.0
    for k in range(SKETCH):
        fewer += math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)
        if fewer > SKETCH_MISS:
            return k
    return SKETCH


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_word(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = word_list(text)
    if not words:
        return np.zeros(0, np.uint64)
    ids = _word_ids
    if len(ids) > 100_000:
        ids.clear()
    for w in set(words).difference(ids):
        ids[w] = _hash_word(w)
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def _sketch(s: np.ndarray) -> bytes:
    """SKETCH minimum hashes, 32 bits each."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 2048):
        least = np.minimum(least, (s[lo : lo + 2048, None] * _MUL + _ADD).min(axis=0))
    return (_mix(least) >> np.uint64(32)).astype("<u4").tobytes()


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            digests, sketches, sizes = [], [], []
            for text in part.column(2).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                sketches.append(_sketch(s) if len(s) else None)
            yield pa.record_batch(
                {"doc_id": part.column(0), "text_key": part.column(1), "digest": pa.array(digests, pa.binary()), "size": pa.array(sizes, pa.int64()), "sketch": pa.array(sketches, pa.binary())}
            )


def _shingler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, comp, n, copies, shingles."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            sets = [shingles(t) for t in part.column("text").to_pylist()]
            yield part.drop_columns(["text"]).append_column("shingles", pa.array([s.tobytes() for s in sets], pa.binary()))


def _hubs(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each row the smallest node id of its local component."""
    labels = local_labels(linked)
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, nodes)
    return least[labels]


def _near(agreed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (a, b) that span what the sketches of a leaf may link."""
        a, b = [], []
        for t in groups(batches, ["path", "bi", "bj"]):
            if t.num_rows < 2:
                continue
            m = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u4").reshape(-1, SKETCH)
            agree = np.zeros((len(m), len(m)), np.int16)
            for k in range(SKETCH):
                agree += m[:, k][:, None] == m[:, k][None, :]
            nodes = np.asarray(t.column("node"))
            linked = agree >= agreed
            hubs = _hubs(linked, nodes)
            if t.column("bi")[0].as_py() != t.column("bj")[0].as_py():
                # both blocks also meet themselves: here one link for each of their classes is enough
                own = np.asarray(t.column("own"))
                firsts = _hubs(linked & (own[:, None] == own[None, :]), nodes) == nodes
                nodes, hubs = nodes[firsts], hubs[firsts]
            a.append(nodes[hubs != nodes])
            b.append(hubs[hubs != nodes])
            if len(a) >= 1000:
                yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SKETCH)


def _main_class(agreed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bucket's pivots the largest class of linked ones."""
        for batch in batches:
            out = []
            for path, pivots in zip(batch.column("path").to_pylist(), batch.column("pivots").to_pylist()):
                m = np.frombuffer(b"".join(x["sketch"] for x in pivots), "<u4").reshape(-1, SKETCH)
                labels = local_labels((m[:, None] == m[None, :]).sum(axis=2) >= agreed)
                main = [x for x, label in zip(pivots, labels) if label == np.bincount(labels).argmax()]
                out.append({"path": path, "hubs": [x["node"] for x in main], "sketches": [x["sketch"] for x in main]})
            yield pa.RecordBatch.from_pylist(out, pa.schema({"path": pa.int64(), "hubs": pa.list_(pa.int64()), "sketches": pa.list_(pa.binary())}))

    return run


def _to_pivots(agreed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pivots that each set is linked to: for a pivot all of them, for others the first."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                hubs = part.column("hubs")
                row = np.repeat(np.arange(len(part)), np.asarray(hubs.value_lengths()))
                to, nodes = np.asarray(hubs.flatten()), np.asarray(part.column("node"))
                linked = (_sketches(part.column("sketch"))[row] == _sketches(part.column("sketches").flatten())).sum(axis=1) >= agreed
                row, to = row[linked], to[linked]
                pivot = np.zeros(len(part), bool)
                pivot[row[to == nodes[row]]] = True
                wanted = pivot[row] | np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
                row, to = row[wanted], to[wanted]
                offsets = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.record_batch({"path": part.column("path"), "node": nodes, "n": part.column("n"), "sketch": part.column("sketch"), "to": pa.ListArray.from_arrays(pa.array(offsets), pa.array(to))})

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    if n <= 3:
        out = np.diag([len(s) for s in sets]).astype(np.int64)
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    alone = np.bincount(row[~shared], minlength=n)
    row, col = row[shared], (np.cumsum(times > 1) - 1)[col[shared]]
    out = np.zeros((n, n), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64) + np.diag(alone)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, hub, links): for each row of a pair of blocks its local class and the copies it links to."""
        for t in groups(batches, ["comp", "bi", "bj"]):
            nodes = np.asarray(t.column("node"))
            _, first = np.unique(nodes, return_index=True)
            if len(first) < len(nodes):  # the same document row twice
                t, nodes = t.take(first), nodes[first]
            sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
            both = _common(sets)
            size = np.diag(both)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            own, bi, bj = np.asarray(t.column("own")), t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
            if bi != bj:
                linked &= own[:, None] != own[None, :]
            np.fill_diagonal(linked, False)
            links = linked @ np.asarray(t.column("copies"), dtype=np.int64)
            np.fill_diagonal(linked, True)
            yield pa.record_batch({"a": nodes, "hub": _hubs(linked, nodes), "links": links.astype(np.int64)})

    return run


def _split(buckets: DataFrame) -> DataFrame:
    """Buckets of two sets or more with their size n; of equal buckets one stays."""
    sizes = buckets.groupBy("path").agg(F.count("*").alias("n"), F.expr("bit_xor(node)").alias("x"), F.expr("bit_xor(xxhash64(node))").alias("y"))
    sizes = sizes.where("n > 1").groupBy("n", "x", "y").agg(F.min("path").alias("path")).select("path", "n")
    return buckets.join(sizes, "path")


def _value(sketch: Column, position: Column) -> Column:
    return F.substr(sketch, position * 4 + 1, F.lit(4))


def candidate_leaves(sets: DataFrame, recall: float, threshold: float) -> DataFrame:
    """(path, node, n): the buckets at which the recursion ends."""
    runs = runs_for(recall, threshold)
    keys = F.array(*[F.xxhash64(F.lit(r), _value(F.col("sketch"), F.lit(r % SKETCH))) for r in range(runs)])
    # a set's whole way down is known from its own sketch: each bucket's choice of a position hangs on its path alone
    ways = sets.select("node", "sketch", F.explode(keys).alias("path1"))
    for depth in range(2, DEPTH + 1):
        above = f"path{depth - 1}"
        position = F.pmod(F.xxhash64(above), F.lit(SKETCH)).cast("int")
        ways = ways.withColumn(f"path{depth}", F.xxhash64(above, _value(F.col("sketch"), position)))
    ways = ways.drop("sketch")
    leaves = []
    ways = ways.withColumn("n_above", F.lit(None).cast("long"))
    for depth in range(1, DEPTH + 1):
        buckets = written(_split(ways.withColumnRenamed(f"path{depth}", "path")), "buckets")
        done = (F.col("n") <= LEAF) | F.coalesce(F.col("n") > KEPT * F.col("n_above"), F.lit(False))
        leaves.append(buckets.where(done).select("path", "node", "n"))
        large = buckets.where(~done)
        ways = large.drop("path", "n_above").withColumnRenamed("n", "n_above")
        if large.isEmpty():
            break
    while not large.isEmpty():
        parents = large.select("node", F.col("path").alias("above"), F.col("n").alias("n_above")).join(sets.select("node", "sketch"), "node")
        ways = parents.withColumn("branch", F.explode(F.array(*map(F.lit, range(BRANCHES)))))
        position = F.pmod(F.xxhash64("above", "branch", F.lit("deeper")), F.lit(SKETCH)).cast("int")
        ways = ways.select("node", "n_above", F.xxhash64("above", "branch", _value(F.col("sketch"), position)).alias("path"))
        buckets = written(_split(ways), "buckets")
        done = (F.col("n") <= LEAF) | (2 * F.col("n") > F.col("n_above"))
        leaves.append(buckets.where(done).select("path", "node", "n"))
        large = buckets.where(~done)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out


def near_links(leaves: DataFrame, sets: DataFrame, agreed: int) -> DataFrame:
    """Links (a, b) that span what the sketches of the leaves (path, node, n) may link.

    Members of a leaf of more than LEAF sets that are linked to its pivots' class need no comparison with each other:
    the others (r of them, as a rule few) meet each other and all members, r x n pairs and not n x n.
    """
    sketches = sets.select("node", "sketch")
    compare = _near(agreed)
    cols = ["path", "bi", "bj", "own", "node", "sketch"]
    small = in_blocks(leaves.where(F.col("n") <= LEAF).join(sketches, "node"), "path", "node", "n", LEAF)
    near = met(small, "path").select(cols).mapInArrow(compare, "a long, b long")
    large = leaves.where(F.col("n") > LEAF).join(sketches, "node")
    slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("slot")
    # nodes are numbered without regard to their texts; the smallest ones are likely those of other buckets too, so links repeat
    drawn = large.groupBy("path", slot).agg(F.min(F.struct("node", "sketch")).alias("pivot"))
    drawn = drawn.groupBy("path").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))
    pivots = written(drawn.mapInArrow(_main_class(agreed), "path long, hubs array<long>, sketches array<binary>"), "pivots")
    starred = written(large.join(pivots, "path").mapInArrow(_to_pivots(agreed), "path long, node long, n long, sketch binary, to array<long>"), "starred")
    near = near.unionByName(starred.select(F.col("node").alias("a"), F.explode("to").alias("b")).where("a <> b"))
    apart = F.size("to") == 0
    if starred.where(apart).isEmpty():
        return near
    left = starred.where(apart).groupBy("path").agg(F.count("*").alias("r"))
    both = starred.join(left, "path").select("path", "node", "n", "r", "sketch", apart.alias("apart"))
    rest = met(in_blocks(both.where("apart"), "path", "node", "r", LEAF), "path").select(cols)
    # blocks of members that have a pivot count down from -1, those of the rest up from 0
    place = F.xxhash64("node", "path")
    n_rest, n_linked = (F.ceil(F.col(x) / LEAF).cast("int") for x in ("r", "n"))
    of_rest, of_linked = F.pmod(place, n_rest).cast("int"), (-1 - F.pmod(place, n_linked)).cast("int")
    own = F.when(F.col("apart"), of_rest).otherwise(of_linked)
    others = F.when(F.col("apart"), F.sequence(-n_linked, F.lit(-1))).otherwise(F.sequence(F.lit(0), n_rest - 1))
    cross = both.withColumn("own", own).withColumn("other", F.explode(others))
    cross = cross.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other"))
    return near.unionByName(rest.mapInArrow(compare, "a long, b long")).unionByName(met(cross, "path").select(cols).mapInArrow(compare, "a long, b long"))


def text_key(text: Column) -> Column:
    """What tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _classed(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """doc_id, text_key, class (null: a text without words), class_id, first (doc_id and text_key of the class's first row), n_links of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    base = written(rows.mapInArrow(_sketcher, "doc_id long, text_key long, digest binary, size long, sketch binary"), "sketches")
    # the first row of a set: nulls come last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep")
    sets = base.where("digest is not null").groupBy("digest").agg(first, F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    comps = connected_components(near_links(candidate_leaves(sets, recall, threshold), sets, agree_for(threshold)))
    found = comps.join(sets.select("node", "rep", "copies", "size"), F.col("id") == F.col("node"))
    sizes = found.groupBy("comp").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") / SET_SHINGLES)).alias("n"))
    members = written(found.join(sizes, "comp").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), "copies", "comp", "n"), "members")
    few = members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = rows["doc_id"].eqNullSafe(members["rep_id"]) & (rows["text_key"] == members["rep_key"])
    held = rows.join(F.broadcast(members) if few else members, same)
    full = held.select("node", "comp", "n", "copies", "text").mapInArrow(_shingler, "node long, comp long, n long, copies long, shingles binary")
    ready = met(in_blocks(full, "comp", "node", "n", BLOCK), "comp").select("comp", "bi", "bj", "own", "node", "copies", "shingles")
    links = written(ready.mapInArrow(_verify(threshold), "a long, hub long, links long"), "links")

    degree = links.groupBy("a").agg(F.sum("links").alias("links"), F.min("hub").alias("hub"))
    if not members.where(F.col("n") > BLOCK).isEmpty():
        own = connected_components(links.select("a", F.col("hub").alias("b")))
        degree = degree.join(own, F.col("a") == F.col("id"), "left").withColumn("hub", F.coalesce("comp", "hub"))
    classed = sets.select("node", "digest", "rep", "copies").join(degree, F.col("node") == F.col("a"), "left").select(
        "digest", "rep", F.coalesce("hub", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    classed = written(classed, "classed")
    known = classed.join(classed.groupBy("class").agg(F.min("rep").alias("first")), "class").select("digest", "class", "first", "n_links")
    return base.select("doc_id", "text_key", "digest").join(known, "digest", "left")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links (documents with a similarity of ``threshold`` or more) for each row of ``docs``."""
    return _classed(docs, threshold, recall).select(
        "doc_id",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row a class: that with the smallest doc_id (null ids last), and of texts under one id that with the smallest hash.

    Rows that repeat in id and text are copies too: of those that differ in other columns the one with the smallest hash
    of all columns stays. Texts without words belong to no class and all stay.
    """
    rows = written(_classed(docs, threshold, recall).where("class is not null"), "rows")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    keys = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"), F.first(kept).alias("kept"))
    touched = written(keys.where("times > 1 or not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "kept"), "touched")
    few = touched.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def of(wanted: DataFrame, how: str) -> DataFrame:
        same = docs["doc_id"].cast("long").eqNullSafe(wanted["_id"]) & (text_key(docs["text"]) == wanted["_key"])
        return docs.join(F.broadcast(wanted) if few else wanted, same, how)

    alone = of(touched, "left_anti")
    repeated = of(touched.where("kept"), "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    one = repeated.groupBy(F.col("r.doc_id").alias("_id"), text_key(F.col("r.text")).alias("_key")).agg(F.min_by("r", F.xxhash64("r")).alias("r"))
    return alone.unionByName(one.select("r.*"))

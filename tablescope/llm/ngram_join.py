"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A text is the set of its five-word shingles (A-Z lower-cased; a text of one to
four words is one shingle). Texts with equal sets form a class of copies, and one
row stands for it from then on. Every class gets ``TREES`` MinHash signatures of
``DEPTH`` values. All signatures are sorted once, tree by tree; the common prefix of each
with its predecessor (LCP) is the sorted list's prefix trie, for every depth at once:
classes share a prefix of d values in a tree if all LCPs between them are d or more.

Two classes are compared if they share a prefix in some tree. The first round takes whole
signatures. Its verified pairs, weighed by the chance that a pair of their similarity is
found at that depth, tell which share of all pairs each shorter prefix would find, and the
prefixes are shortened to the greatest depth that reaches the target recall (at least
to what a pair right at the threshold needs if nothing is found). The second round compares
the classes that share such a prefix but no whole signature.

Verification is exact, on whole shingle sets. Classes that hang together by prefixes are dealt
to one task, each set once. Where that would be too large, every shared prefix is a task
of its own (in pairs of blocks if it is too large itself), and a pair is counted in the
first tree whose prefix it shares. Tasks return numbers of links, a
spanning label per class and a histogram, never the pairs. Links' components are the groups.

Edge cases: texts without words form no group and have no links; a null id takes
part in groups, and a group's id is its smallest non-null one; repeated rows are
copies of one class; very long texts are whole sets like others; similarities at the threshold count; an
empty table gives an empty result; other columns are
ignored by ``groups`` and kept by ``one_of_each``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textarrays as ta
from .common import fresh, join_hot, prepare, written
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.999
#: Bins of the similarities from 0 to 1 of verified pairs.
BINS = 50
BATCH_BYTES = 8 << 20
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 2_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 44) - 1)


def found_share(similarity, depth: int, trees: int):
    """Chance that a pair shares a prefix of ``depth`` values in one of the trees."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def depth_for(threshold: float, trees: int, recall: float, longest: int = DEPTH, histogram: np.ndarray | None = None) -> int:
    """The longest prefix that finds the wanted share of the pairs.

    ``histogram`` counts the verified pairs of the round with the longest prefixes by similarity; each stands
    for as many pairs as there are for one found. Without pairs all are taken to lie at the threshold.
    """
    if histogram is None or not histogram.sum():
        pairs, at = np.ones(1), np.array([threshold])
    else:
        # the lower end of each bin, so that no pair counts as easier to find than it is
        at = np.maximum(np.arange(len(histogram)) / len(histogram), threshold)
        pairs = histogram / np.maximum(found_share(at, longest, trees), 1e-9)
    for depth in range(longest, 1, -1):
        if (pairs * found_share(at, depth, trees)).sum() >= recall * pairs.sum():
            return depth
    return 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """(document, shingle hash) of consecutive documents, with repeats."""
    h, _, _, counts = ta.words(data, offsets)
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))  # words from here to the document's end
    docs, found = [], []
    total = np.repeat(counts, counts)
    for length in range(1, size + 1):
        at = np.flatnonzero((left >= size) if length == size else (left == length) & (total == length))
        x = np.full(len(at), length, np.uint64)
        for k in range(length):
            x = x * _M + h[at + k]
        docs.append(doc[at])
        found.append(ta.fmix(x))
    return np.concatenate(docs), np.concatenate(found)


def _distinct(doc: np.ndarray, hashes: np.ndarray):
    """Distinct (document, hash) with hashes cut to 44 bits, sorted by document."""
    keys = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (hashes & _LOW))
    return (keys >> np.uint64(44)).astype(np.int64), keys & _LOW


def _node(doc: np.ndarray, x: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit digest of every document's set, and the set's size."""
    sums = np.zeros(n_docs, np.uint64)
    size = np.bincount(doc, minlength=n_docs)
    full = np.flatnonzero(size)
    if len(full):
        starts = (np.cumsum(size) - size)[full]
        sums[full] = np.add.reduceat(ta.fmix(x * _M + np.uint64(77)), starts)
    return ta.fmix(sums + size.astype(np.uint64) * _M), size


def _signatures(doc: np.ndarray, x: np.ndarray, size: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """(documents, trees, depth) MinHash values of 16 bits, stored so that their bytes sort like the values."""
    full = np.flatnonzero(size)
    starts = (np.cumsum(size) - size)[full]
    y = ta.fmix(x + np.uint64(0x51ED27))
    rng = np.random.default_rng(11)
    values = np.zeros((len(size), trees, depth), ">u2")
    for t in range(trees):
        for k in range(depth):
            a, b = (np.uint64(v) for v in rng.integers(0, 1 << 63, 2))
            # the values are mixed again: minima of a linear map of close numbers would not be independent
            z = y * (a << np.uint64(1) | np.uint64(1)) + b
            z ^= z >> np.uint64(32)
            if len(full):
                values[full, t, k] = (ta.fmix(np.minimum.reduceat(z, starts)) >> np.uint64(48)).astype(">u2")
    return values


def _runs(texts: pa.Array):
    """(first, last document, bytes, offsets) of runs of documents of about BATCH_BYTES and under 2^20 documents."""
    data, offsets = ta.flat(texts)
    for i, j in ta.batches_of(np.diff(offsets) + 64, BATCH_BYTES):
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]


def _row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    text_key = F.xxhash64(F.coalesce(text, F.lit("")))
    return F.coalesce(doc_id, text_key), text_key


def sketch(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int) -> DataFrame:
    """(doc_id, row_key, text_key, node, size, labels), one row per input row; labels holds one signature after the other."""
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    row_key, text_key = _row_key(doc_id, text)
    rows = docs.select(doc_id.alias("doc_id"), row_key.alias("row_key"), text_key.alias("text_key"), text.alias("_t"))

    def sketched(batches):
        for b in batches:
            for i, j, data, offsets in _runs(b.column("_t")):
                doc, x = _distinct(*shingles(data, offsets))
                node, size = _node(doc, x, j - i)
                labels = _signatures(doc, x, size, trees, depth)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[i:j], b.column("row_key")[i:j], b.column("text_key")[i:j], pa.array(node.view(np.int64)),
                     pa.array(size.astype(np.int64)), pa.array([v.tobytes() for v in labels], pa.binary())],
                    ["doc_id", "row_key", "text_key", "node", "size", "labels"])

    return rows.mapInArrow(sketched, "doc_id long, row_key long, text_key long, node long, size long, labels binary")


def _label(tree, depth: int, prefix: int | None = None):
    """The first ``prefix`` values of a tree's signature."""
    width = 2 * depth
    return F.substring(F.col("labels"), F.lit(1) + tree * width, F.lit(2 * prefix if prefix else width))


def _adjacent(depth: int, least: int):
    """Edges (u, v, lcp) of the sorted signatures of a range: ``lcp`` is what u shares with its predecessor, v the first
    signature of the range that shares as much with u. As edges to the predecessors they hang the same signatures together
    at every depth, but in stars instead of chains, which take more rounds to be found as components.
    The range's first and last signature come out as well (``last`` 0 and 1)."""
    names = ["u", "v", "lcp", "range", "last", "tree", "label"]

    def linked(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId()
        end = None  # the last row so far: tree, label, node
        heads = {}  # by depth, the first node of those that share so many values with the last row

        def edge(row, last):
            return pa.RecordBatch.from_arrays(
                [pa.array([row[2]], pa.int64()), pa.array([row[2]], pa.int64()), pa.array([-1], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([last], pa.int32()), pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.binary())], names)

        for b in batches:
            if not b.num_rows:
                continue
            tree, node = (b.column(c).to_numpy() for c in ("tree", "node"))
            values = np.frombuffer(b"".join(b.column("label").to_pylist()), ">u2").reshape(-1, depth)
            if end is None:
                yield edge((int(tree[0]), values[0].tobytes(), int(node[0])), 0)
                heads = dict.fromkeys(range(least, depth + 1), node[0])
            else:
                tree, node = np.concatenate([[end[0]], tree]), np.concatenate([[end[2]], node])
                values = np.concatenate([np.frombuffer(end[1], ">u2")[None, :], values])
            # the label as it came: numpy swaps the bytes of the values where it joins them to others
            end = (int(tree[-1]), b.column("label")[-1].as_py(), int(node[-1]))
            lcp = np.cumprod(values[1:] == values[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            head = node[:-1].copy()
            for d in range(least, depth + 1) if len(lcp) else ():
                start = np.maximum.accumulate(np.where(lcp < d, np.arange(1, len(node)), 0))
                first = np.where(start > 0, node[start], heads[d])
                head[lcp == d] = first[lcp == d]
                heads[d] = first[-1]
            at = np.flatnonzero(lcp >= least)
            nothing = pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(node[at + 1]), pa.array(head[at]), pa.array(lcp[at].astype(np.int32)), nothing, nothing,
                                              nothing, pa.nulls(len(at), pa.binary())], names)
        if end is not None:
            yield edge(end, 1)

    return linked


def forest(classes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """(u, v, lcp): edges that hang together what shares ``least`` or more first values in some tree: those of at least
    d common values do so for every depth d."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    rows = classes.select("node", "labels", tree).select("tree", _label(F.col("tree"), depth).alias("label"), "node")
    rows = rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = written(rows.mapInArrow(_adjacent(depth, least), "u long, v long, lcp int, range int, last int, tree int, label binary"), "tries")
    # two rows per range: the end of one and the beginning of the next are neighbours too
    before = F.lag(F.struct("tree", "label", "u")).over(Window.orderBy("range", "last"))
    ends = found.where("lcp < 0").withColumn("b", before).where((F.col("last") == 0) & (F.col("b.tree") == F.col("tree")))
    same = [F.substring("label", 1, 2 * d) == F.substring(F.col("b.label"), 1, 2 * d) for d in range(1, depth + 1)]
    lcp = sum((F.when(x, 1).otherwise(0) for x in same), F.lit(0))
    ends = ends.select("u", F.col("b.u").alias("v"), lcp.alias("lcp")).where(F.col("lcp") >= least)
    return found.where("lcp >= 0").select("u", "v", "lcp").unionByName(ends)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The wanted classes (row_key, node, keys, old, units) with their whole sets of shingles instead of row_key."""
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    rows = docs.select(_row_key(doc_id, text)[0].alias("row_key"), text.alias("_t")).join(wanted, "row_key")
    kept = ["node", "keys", "old", "units"]

    def gathered(batches):
        for b in batches:
            want = np.asarray(b.column("node").to_numpy(zero_copy_only=False), np.int64)
            for i, j, data, offsets in _runs(b.column("_t")):
                doc, s = shingles(data, offsets)
                node, _ = _node(*_distinct(doc, s), j - i)
                same = np.flatnonzero(node.view(np.int64) == want[i:j])
                order = np.lexsort((s, doc))
                doc, s = doc[order], s[order]
                new = np.ones(len(s), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
                doc, s = doc[new], s[new]
                bounds = np.searchsorted(doc, np.arange(j - i + 1))
                for d in same:
                    k = i + int(d)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(c)[k:k + 1] for c in kept] + [pa.array([s[bounds[d]:bounds[d + 1]].tobytes()], pa.binary())],
                        [*kept, "shingles"])

    types = dict(wanted.dtypes)
    found = rows.mapInArrow(gathered, ", ".join(f"{c} {types[c]}" for c in kept) + ", shingles binary")
    return found.dropDuplicates(["node"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of every pair of sets."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    often = np.diff(np.append(first, len(flat)))
    out = np.zeros(m * m, np.float32)
    # shingles of few sets add to their pairs one by one, the others by a product of 0/1 matrices in slices
    few = min(16, m)
    for k in range(2, few + 1):
        at = first[often == k]
        for a in range(0, len(at), 1 << 16):
            rows = owner[at[a:a + (1 << 16), None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            pair = rows[:, i] * m + rows[:, j]
            out += np.bincount(pair.ravel(), minlength=m * m).astype(np.float32)
    out = out.reshape(m, m)
    out += out.T
    many = np.flatnonzero(often > few)
    for a in range(0, len(many), 2048):
        part = many[a:a + 2048]
        table = np.zeros((m, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), often[part])
        spot = np.repeat(first[part], often[part]) + np.arange(len(column)) - np.repeat(np.cumsum(often[part]) - often[part], often[part])
        table[owner[spot], column] = 1
        out += table @ table.T
    return np.rint(out).astype(np.int64)


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest row of every row's connected component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // max(1, len(lists)))


def _sharing(keys: np.ndarray) -> np.ndarray:
    """Which pairs of rows have an equal key in some column."""
    out = np.zeros((len(keys), len(keys)), bool)
    for column in keys.T:
        out |= column[:, None] == column[None, :]
    return out


def _verify(threshold: float, bins: int):
    """Verifies the units of a task: rows (unit, tree, block, a, b, node, keys, old, shingles) to (node, links, label, pairs)."""
    def verified(table: pa.Table) -> pa.Table:
        unit, tree, left, right, block, node = (table.column(c).to_numpy() for c in ("unit", "tree", "a", "b", "block", "node"))
        packed = table.column("shingles").to_pylist()
        keys, old = (_matrix(table.column(c)) for c in ("keys", "old"))
        order = np.lexsort((node, right, left, tree, unit))
        own = np.stack([unit, tree, left, right], axis=1)[order]
        starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
        nodes, links, labels, pairs = [], [], [], []
        for s, e in zip(starts, np.append(starts[1:], len(order))):
            rows = order[s:e]
            if len(rows) < 2:
                continue
            t = tree[rows[0]]
            # a unit of one tree leaves the pairs that share a prefix in an earlier one to that
            wanted = _sharing(keys[rows]) if t < 0 else ~_sharing(keys[rows, :t])
            if old.shape[1]:
                wanted &= ~_sharing(old[rows])
            if left[rows[0]] != right[rows[0]]:
                wanted &= block[rows][:, None] != block[rows][None, :]
            np.fill_diagonal(wanted, False)
            busy = np.flatnonzero(wanted.any(axis=1))
            if not len(busy):
                continue
            rows, wanted = rows[busy], wanted[np.ix_(busy, busy)]
            sets = [np.frombuffer(packed[r], np.uint64) for r in rows]
            size = np.array([len(x) for x in sets])
            common = _overlaps(sets)
            linked = wanted & (common * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9)
            nodes.append(node[rows])
            links.append(linked.sum(axis=1))
            labels.append(node[rows][_labels(linked)])
            i, j = np.nonzero(np.triu(linked))
            likeness = common[i, j] / (size[i] + size[j] - common[i, j])
            found = np.bincount(np.minimum((likeness * bins).astype(np.int64), bins - 1), minlength=bins)
            pairs.append(found)
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        links, nodes, labels = join(links), join(nodes), join(labels)
        # the task's histogram stands in one more row, of no class
        total = np.sum(pairs, axis=0).astype(np.int64) if pairs else np.zeros(bins, np.int64)
        return pa.table({"node": pa.array([*nodes.tolist(), None], pa.int64()), "links": pa.array([*links.tolist(), None], pa.int64()),
                         "label": pa.array([*labels.tolist(), None], pa.int64()),
                         "pairs": pa.array([*[None] * len(nodes), total.tolist()], pa.list_(pa.int64()))})

    return verified


def _hashed(depth: int, prefix: int, trees: int) -> Column:
    """One 64-bit key per tree for the first ``prefix`` values of its signature."""
    return F.array(*[F.xxhash64(F.lit(t), _label(F.lit(t), depth, prefix)) for t in range(trees)])


def _round(docs: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, prefix: int, before: int | None, trees: int, threshold: float,
           block_rows: int, block_shingles: int, id_col: str, text_col: str) -> DataFrame:
    """Verified classes (node, links, label) and histograms (pairs) of all pairs that share a prefix, and none of ``before`` values."""
    near = edges.where(F.col("lcp") >= prefix)
    chained = components(near.select("u", "v"))
    members = chained.join(nodes.select("node", "row_key", "size", "labels"), "node")
    if before is not None:
        # where all neighbours share the longer prefix, nothing is new
        new = near.where(F.col("lcp") < before).select(F.col("u").alias("node")).distinct()
        roots = chained.join(new, "node", "left_semi").select("root").distinct()
        members = members.join(roots, "root", "left_semi")
    old = _hashed(depth, before, trees) if before else F.array().cast("array<bigint>")
    members = written(members.select("node", "root", "row_key", "size", _hashed(depth, prefix, trees).alias("keys"), old.alias("old")), "candidates")
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("shingles"))

    def cut(sizes: DataFrame) -> Column:
        return F.ceil(F.greatest(F.col("m") / block_rows, F.col("shingles") / block_shingles)).cast("int")

    total = sizes.agg(F.sum("shingles").alias("s")).first()["s"] or 0
    packs = max(1, -(-total // (block_shingles // 2)))
    known = written(join_hot(members, sizes.select("root", cut(sizes).alias("blocks")), "root", "inner"), "sized")
    small = known.where("blocks = 1").select("node", F.struct(
        F.pmod(F.xxhash64("root"), F.lit(packs)).alias("pack"), F.col("root").alias("unit"), F.lit(-1).alias("tree"), F.lit(0).alias("block"),
        F.lit(0).alias("a"), F.lit(0).alias("b")).alias("u"))
    # large: a unit for every prefix that several members share, in pairs of blocks if need be
    spots = known.where("blocks > 1").select("node", "size", F.posexplode("keys").alias("tree", "unit"))
    shared = spots.groupBy("unit").agg(F.count("*").alias("m"), F.sum("size").alias("shingles")).where("m > 1")
    spots = join_hot(spots, shared.select("unit", cut(shared).alias("blocks")), "unit", "inner")
    spots = spots.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spots = spots.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a, b = F.least("block", "_o"), F.greatest("block", "_o")
    large = spots.select("node", F.struct(F.xxhash64("unit", a, b).alias("pack"), "unit", "tree", "block", a.alias("a"), b.alias("b")).alias("u"))
    units = small.unionByName(large).groupBy("node").agg(F.collect_list("u").alias("units"))
    wanted = known.select("node", "row_key", "keys", "old").join(units, "node")
    sets = _sets(docs, wanted, id_col, text_col)
    dealt = sets.select("node", "keys", "old", "shingles", F.explode("units").alias("u")).select("u.*", "node", "keys", "old", "shingles")
    checked = dealt.groupBy("pack").applyInArrow(_verify(threshold, BINS), "node long, links long, label long, pairs array<long>")
    return written(checked, "verified")


def _histogram(checked: DataFrame) -> np.ndarray:
    """Verified pairs by similarity: one number per bin."""
    row = checked.where("pairs IS NOT NULL").agg(*[F.sum(F.col("pairs")[i]).alias(f"b{i}") for i in range(BINS)]).first()
    return np.array([row[i] or 0 for i in range(BINS)], float)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES,
           recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES, depth: int = DEPTH) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id of its group), n_links (different texts at the threshold or
    more), n_copies (rows with the same shingles, itself included), and text_key and first (the group's kept row's id and text key)."""
    prepare(docs.sparkSession)
    sketches = written(sketch(docs, id_col, text_col, trees, depth), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key"))
    nodes = written(sketches.where("size > 0").groupBy("node").agg(
        first.alias("first"), F.min("row_key").alias("row_key"), F.max("size").alias("size"), F.count("*").alias("n_copies"),
        F.min("labels").alias("labels")), "classes")
    # no pair needs shorter prefixes than one right at the threshold
    least = depth_for(threshold, trees, recall, depth)
    edges = written(forest(nodes, trees, depth, least), "forest")
    options = (trees, threshold, block_rows, block_shingles, id_col, text_col)
    checked = _round(docs, nodes, edges, depth, depth, None, *options)
    prefix = max(least, depth_for(threshold, trees, recall, depth, _histogram(checked)))
    if prefix < depth:
        checked = checked.unionByName(_round(docs, nodes, edges, depth, prefix, depth, *options))
    checked = checked.where("node IS NOT NULL").select("node", "links", "label")
    linked = components(checked.where("node != label").select(F.col("node").alias("u"), F.col("label").alias("v")))
    degree = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    known = nodes.select("node", "first", "n_copies").join(linked, "node", "left").join(degree, "node", "left").select(
        "node", "first", "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = written(known, "class-links")
    chosen = known.groupBy("root").agg(F.min("first").alias("first"))
    known = written(join_hot(known.drop("first"), chosen, "root", "inner").drop("root"), "class-groups")
    found = join_hot(sketches.select("doc_id", "text_key", "node", "size"), known, "node", "left")
    alone = F.col("first").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "text_key",
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))).alias("first"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of every group the row with the smallest id, all columns as they are."""
    row, key = fresh(docs, "row", "text_key")
    row_key, text_key = _row_key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    kept = groups(docs, id_col, text_col, **options).where("first").select(
        F.coalesce("doc_id", "text_key").alias(row), F.col("text_key").alias(key)).distinct()
    keyed = docs.withColumns({row: row_key, key: text_key})
    # rows repeated with id and text are one; the join has dealt them out by both already
    return keyed.join(kept, [row, key], "left_semi").dropDuplicates([row, key]).select(*[F.col(f"`{c}`") for c in docs.columns])

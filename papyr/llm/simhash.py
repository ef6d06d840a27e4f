"""SimHash near-dedup through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the vector of the bit counts of its
SEGMENTS segments.  The Manhattan distance of two vectors is a lower bound of
the Hamming distance of the fingerprints, so fingerprints that differ in
RADIUS = 2 bits lie within Manhattan distance 2 and some cell of the integer
grid lies within 1 of both.  Each distinct fingerprint is dealt to the cells
within 1 of its own, cells are compared inside, and a pair counts only when
the exact distance is checked.  A crowded cell is verified through the exact
midpoints of its pairs instead of pair by pair, so no cell costs a square; a
large one is dealt by these midpoints.

Defined results: a null or wordless text has fingerprint zero; equal
fingerprints form one class whose links are those of its smallest doc_id;
repeated rows give repeated rows; a null doc_id keeps its fingerprint, has a
null doc_id in the result and counts as smaller than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.llm import textunits as tu
from papyr.llm.common import NULL_ID, Tables, dealt_in_blocks, id_of, join_hot, pairs_in_cells, read, runs_by_key, slices, small_batches, width
from papyr.llm.components import connected_components, forest

SEGMENTS = 16
#: Views by which documents meet that are less alike than the grid can see, and their shingles.
VIEWS, VIEW_SIZE = 8, 3
#: Jaccard similarity, as a fraction, from which sets of shingles are similar.
SIMILARITY = (4, 5)
#: Words of 64 bits of the wide fingerprint that spares most unlike pairs the comparison of their sets.
WIDE = 16
#: Differing bits, of 64 * WIDE, up to which sets are compared: those with a similarity of 0.8 differ in 155 +- 11.
NEAR_BITS = 230
#: Sets of fewer shingles are always compared.
SMALL_SET = 32
#: Members of a view above which it is dealt out in blocks.
BUCKET = 4_000
#: Members of a cell up to which its pairs are compared directly.
CROWD = 48
#: Members of a cell above which it is dealt by midpoints.
LARGE = 20_000


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `shingle` words of the text, A-Z lowered."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    return np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64)


_SALTS = tu.mix(np.arange(WIDE, dtype=np.uint64) + np.uint64(911))


def fingerprint_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """Words of a SimHash; bit i is set if it is set in over half the hashes.

    The first word takes the hashes as they are, each other one a mix of its own.
    """
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255 * 16):
        part = hashes[at : at + 255 * 16]
        h = np.empty((len(part), words), np.uint64)
        h[:, 0] = part
        if words > 1:
            h[:, 1:] = tu.mix(part[:, None] ^ _SALTS[None, 1:words])
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        for row in range(0, len(part), 255):  # 255 ones fit a byte
            total += bits[row : row + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash; zero for no hashes."""
    return int(fingerprint_words(hashes, 1)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint, as a signed long, of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            fps = [fingerprint(shingle_hashes(x or b"", shingle)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"]
            )

    return docs.select(id_of().alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, fp long")


def cells(fps: np.ndarray, segments: int) -> np.ndarray:
    """Array (1 + 2 * segments, n) of keys of the grid cells within Manhattan distance 1 of each fingerprint's."""
    size = 64 // segments
    mask = np.uint64((1 << size) - 1)
    base = np.zeros(len(fps), np.uint64)
    values = tu.mix(np.arange(segments, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    for k in range(segments):
        base += np.bitwise_count((fps >> np.uint64(k * size)) & mask).astype(np.uint64) * values[k]
    moves = np.concatenate(([np.uint64(0)], values, -values))
    return tu.mix(base[None, :] + moves[:, None])


def _deal(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                fps = part.column("fp").to_numpy()
                keys = cells(fps.view(np.uint64), segments)
                m = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(fps, m)), pa.array(np.tile(part.column("rep").to_numpy(), m))],
                    names=["cell", "fp", "rep"],
                )

    return run


def _crowded(fps: np.ndarray, reps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs within 2 bits: they are those that share a word within 1 bit of both."""
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    a, b = [], []
    near = (fps[None, :] ^ flips[:, None]).ravel()
    who = np.tile(reps, len(flips))
    o = np.lexsort((who, near))
    near, who = near[o], who[o]
    same = near[1:] == near[:-1]
    a.append(who[1:][same]), b.append(who[:-1][same])
    return np.concatenate(a), np.concatenate(b)


def _verify(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_by_key(batches, "cell", 100_000):
            cell, fps, reps = (t.column(c).to_numpy() for c in ("cell", "fp", "rep"))
            fps = fps.view(np.uint64)
            head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            size = np.diff(np.concatenate((head, [len(cell)])))
            a, b = [], []
            crowd = np.repeat(size > CROWD, size)
            c, f, r = cell[~crowd], fps[~crowd], reps[~crowd]
            for step in range(1, int(min(CROWD, size.max()))):
                near = np.flatnonzero((c[step:] == c[:-step]))
                if not len(near):
                    break
                near = near[np.bitwise_count(f[near] ^ f[near + step]) <= radius]
                a.append(r[near]), b.append(r[near + step])
            for s, n in zip(head[size > CROWD], size[size > CROWD], strict=True):
                x, y = _crowded(fps[s : s + n], reps[s : s + n], radius)
                a.append(x), b.append(y)
            if a:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def _counts(segments: int):
    """mapInArrow function: (cell, n) of all cells of some fingerprints of a task; what they hold in all is summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                cell, n = np.unique(cells(batch.column("fp").slice(at, 50_000).to_numpy().view(np.uint64), segments), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(n)], names=["cell", "n"])

    return run


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, rep) -> (mid, rep) for the 65 words within one bit of each fingerprint."""
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            mid = part.column("fp").to_numpy().view(np.uint64)[None, :] ^ flips[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(mid.ravel().view(np.int64)), pa.array(np.tile(part.column("rep").to_numpy(), len(flips)))], names=["mid", "rep"])


def links(classes: DataFrame, segments: int = SEGMENTS, radius: int = 2) -> DataFrame:
    """Spanning links (a, b) of the classes (fp, rep) whose fingerprints differ in at most 2 bits.

    Cells of over LARGE fingerprints, told by a count, do not meet in one task:
    their fingerprints are dealt by their midpoints, of which none has over 65.
    """
    if radius != 2:
        raise ValueError("the grid's reach is made for 2 bits")
    n = width(classes.sparkSession)
    dealt = classes.mapInArrow(_deal(segments), "cell long, fp long, rep long")
    counts = classes.mapInArrow(_counts(segments), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    hot = counts.where(F.col("n") > LARGE).select("cell")
    crowd = None
    if not hot.isEmpty():
        crowd = dealt.join(hot, "cell", "left_semi").select("fp", "rep").distinct().mapInArrow(_midpoints, "mid long, rep long")
        dealt = dealt.join(hot, "cell", "left_anti")
    found = dealt.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_verify(radius), "a long, b long")
    if crowd is None:
        return found
    near = crowd.groupBy("mid").agg(F.min("rep").alias("b"), F.collect_list("rep").alias("reps"))
    return found.union(near.select(F.explode("reps").alias("a"), "b").where("a <> b").distinct())


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`(doc_id, text, ...)."""
    tables = Tables(spark)
    rows = tables.settle(fingerprints(docs, shingle))
    classes = tables.settle(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    joined = connected_components(links(classes.select("fp", "rep")), tables)
    of_class = tables.settle(
        classes.join(joined, F.col("rep") == F.col("node"), "left").select("fp", "copies", F.coalesce("component", "rep").alias("component"))
    )
    shown = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return join_hot(rows, of_class, "fp", "copies", rows.count()).select(
        shown("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        shown("component").alias("component_id"),
    )


def view_keys(hashes: np.ndarray, views: int) -> np.ndarray:
    """SimHash features by view: a hash of the VIEW_SIZE shingles that are smallest under the view's own hash."""
    own = np.unique(hashes)
    out = np.empty(views, np.uint64)
    for v in range(views):
        m = tu.mix(own ^ tu.mix(np.array([v + 1], np.uint64)))
        m = np.sort(np.partition(m, VIEW_SIZE - 1)[:VIEW_SIZE] if len(m) > VIEW_SIZE else m)
        key = np.array([v], np.uint64)
        for x in m:
            key = tu.fold(key, np.array([x], np.uint64))
        out[v] = key[0]
    return out


def set_key(own: np.ndarray) -> tuple[int, int]:
    """Two hashes, as signed longs, of a set of distinct shingle hashes."""
    parts = (tu.mix(own ^ _SALTS[0]).sum(dtype=np.uint64), tu.mix(own ^ _SALTS[1]).sum(dtype=np.uint64))
    return int(parts[0].view(np.int64)), int(parts[1].view(np.int64))


def sketches(docs: DataFrame, shingle: int, views: int) -> DataFrame:
    """(id, k1, k2, n, fp, wide, views): the key and size of the set of distinct shingles, its fingerprint, the wide one and the view keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            wide, keys, sets, sizes = [], [], [], []
            for x in batch.column("text").to_pylist():
                own = np.unique(shingle_hashes(x or b"", shingle))
                wide.append(fingerprint_words(own, WIDE).view(np.int64))
                keys.append(view_keys(own, views).view(np.int64))
                sets.append(set_key(own))
                sizes.append(len(own))
            longs, (k1, k2) = pa.list_(pa.int64()), zip(*sets, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int64()), pa.array([w[0] for w in wide], pa.int64()), pa.array(wide, longs), pa.array(keys, longs)],
                names=["id", "k1", "k2", "n", "fp", "wide", "views"],
            )

    plain = docs.select(id_of().alias("id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(run, "id long, k1 long, k2 long, n long, fp long, wide array<long>, views array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, k1, k2, own): the distinct shingle hashes, sorted, of every row of `docs` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 500_000):
            own = [np.unique(shingle_hashes(x or b"", shingle)) for x in batch.column("text").to_pylist()]
            k1, k2 = zip(*map(set_key, own), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))],
                names=["id", "k1", "k2", "own"],
            )

    return docs.mapInArrow(run, "id long, k1 long, k2 long, own array<long>")


def jaccard_at_least(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct values have a Jaccard similarity of SIMILARITY or more; two empty ones have."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * SIMILARITY[1] < len(b) * SIMILARITY[0]:
        return False
    if not len(a):
        return not len(b)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return both * SIMILARITY[1] >= (len(a) + len(b) - both) * SIMILARITY[0]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of (wide fingerprint, set size), along the last axis, may have the similarity."""
    differ = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.uint16)
    for k in range(WIDE):
        differ += np.bitwise_count(a[..., k] ^ b[..., k])
    few, many = np.minimum(a[..., WIDE], b[..., WIDE]), np.maximum(a[..., WIDE], b[..., WIDE])
    sizes = few * np.uint64(SIMILARITY[1]) >= many * np.uint64(SIMILARITY[0])
    return sizes & ((differ <= NEAR_BITS) | (few < SMALL_SET))


def _spanning(t: pa.Table, key: str, value: np.ndarray, same=None) -> pa.RecordBatch:
    """Spanning links of the near pairs of each (key, x, y), of those only for which same(row, row) where it is given.

    A pair that others have joined is not compared again, so a group of copies
    costs little more than its rows; large groups are worked through by blocks
    of rows, so no table of their pairs is made.
    """
    nodes, at = np.unique(t.column("rep").to_numpy(), return_inverse=True)
    root = np.arange(len(nodes))

    def join(p: np.ndarray, q: np.ndarray) -> None:
        nonlocal root
        while len(p):
            live = root[at[p]] != root[at[q]]
            p, q = p[live], q[live]
            step = 512 if same else len(p)
            a, b = p[:step], q[:step]
            if same:
                keep = np.fromiter((same(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
                a, b = a[keep], b[keep]
            low, high = forest(root[at[a]], root[at[b]])
            new = np.arange(len(nodes))
            new[low] = high
            root = new[root]
            p, q = p[step:], q[step:]

    k, block, x, y = (t.column(c).to_numpy() for c in (key, "block", "x", "y"))
    order = np.lexsort((block, y, x, k))
    change = np.any([c[order][1:] != c[order][:-1] for c in (k, x, y)], axis=0)
    head = np.flatnonzero(np.concatenate(([True], change)))
    count = np.diff(np.concatenate((head, [len(k)])))
    few = np.sort(order[np.repeat(count <= CROWD, count)])
    if len(few):
        where, p, q = pairs_in_cells(t.select([key, "block", "x", "y"]).take(few), key, value[few], _near)
        join(few[where][p], few[where][q])
    for s, n in zip(head[count > CROWD], count[count > CROWD], strict=True):
        rows = order[s : s + n]
        one = x[rows[0]] == y[rows[0]]
        left, right = (rows, rows) if one else (rows[block[rows] == x[rows[0]]], rows[block[rows] != x[rows[0]]])
        for i in range(0, len(left), 128):
            part = left[i : i + 128]
            other = right[i:] if one else right
            # most rows of a large group are soon of one tree: they are compared with the rows of others only
            trees, n_rows = np.unique(root[at[other]], return_counts=True)
            own = root[at[part]] == trees[n_rows.argmax()]
            for a, b in ((part[own], other[root[at[other]] != trees[n_rows.argmax()]]), (part[~own], other)):
                if len(a) and len(b):
                    p, q = np.nonzero((root[at[a]][:, None] != root[at[b]][None, :]) & _near(value[a][:, None], value[b][None, :]))
                    join(a[p], b[q])
    live = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[live]), pa.array(nodes[root[live]])], names=["a", "b"])


def _sized(t: pa.Table, sizes: np.ndarray) -> np.ndarray:
    wide = t.column("wide").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)
    return np.column_stack((wide, sizes.astype(np.uint64)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of the pairs of each cell that may be similar."""
    for t in runs_by_key(batches, "cell", 20_000):
        yield _spanning(t, "view", _sized(t, t.column("n").to_numpy()))


def _verify_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of the pairs of each cell whose sets are similar."""
    for t in runs_by_key(batches, "cell", 4_000):
        own = t.column("own").combine_chunks()
        values = own.flatten().to_numpy().view(np.uint64)  # sorted as such
        ends = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(own).to_numpy(), dtype=np.int64)))
        yield _spanning(t, "group", _sized(t, np.diff(ends)), lambda i, j: jaccard_at_least(values[ends[i] : ends[i + 1]], values[ends[j] : ends[j + 1]]))  # noqa: B023


def similar_documents(spark: SparkSession, docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(id, component): groups of documents whose sets of distinct word shingles have a Jaccard similarity of 0.8 or more.

    Equal sets form one class.  Texts that share four fifths of their shingles
    differ in about 9 of 64 bits, far more than the grid's 2.  So classes meet
    where the grid links them or where one of VIEWS views of their shingles is
    equal (each is, with probability 0.8 ** VIEW_SIZE).  What meets is linked
    only where the sets themselves are similar.
    """
    with small_batches(spark):
        return _similar_documents(spark, docs, shingle)


def _similar_documents(spark: SparkSession, docs: DataFrame, shingle: int) -> DataFrame:
    tables = Tables(spark)
    key = ["k1", "k2"]
    sorted_cells = lambda x: x.repartition(width(spark), "cell").sortWithinPartitions("cell")
    rows = tables.settle(sketches(docs, shingle, VIEWS))
    first_of = F.min_by(F.struct("n", "fp", "views", "wide"), "id").alias("own")
    classes = tables.settle(rows.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), first_of).select(*key, "rep", "copies", "own.*"))
    views = classes.select(F.explode("views").alias("view"), "rep")
    met = tables.settle(views.groupBy("view").count().where("count > 1").select("view"))
    seen = classes.select(F.explode("views").alias("view"), "rep", "n", "wide").join(met, "view", "left_semi")
    by_view = sorted_cells(dealt_in_blocks(seen, "view", "rep", BUCKET)).mapInArrow(_meet, "a long, b long")
    # all that may be similar and meets lies in one group, so each set is sent to its group only
    groups = tables.settle(connected_components(links(classes.select("fp", "rep")).union(by_view), tables).withColumnsRenamed({"node": "id", "component": "group"}))
    texts = docs.select(id_of().alias("id"), F.col("text").cast("binary").alias("text")).join(groups.select("id").distinct(), "id", "left_semi")
    sets = shingle_sets(texts, shingle).dropDuplicates(["id", *key])
    first = classes.select(F.col("rep").alias("id"), *key, "wide").join(groups, "id")
    member = first.join(sets, ["id", *key]).select("group", F.col("id").alias("rep"), "wide", "own")
    by_group = sorted_cells(dealt_in_blocks(tables.settle(member), "group", "rep", BUCKET)).mapInArrow(_verify_sets, "a long, b long")
    joined = connected_components(by_group, tables)
    of_class = tables.settle(
        classes.select(*key, "rep", "copies").join(joined, F.col("rep") == F.col("node"), "left").select(*key, "copies", F.coalesce("component", "rep").alias("component"))
    )
    return join_hot(rows.select("id", *key), of_class, key, "copies", rows.count()).select("id", "component")


def keep_representatives(spark: SparkSession, docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of their group of similar documents."""
    gone = similar_documents(spark, docs, shingle).where("id <> component").select(F.col("id").alias("_papyr_gone")).distinct()
    return docs.join(gone, id_of() == F.col("_papyr_gone"), "left_anti")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; see the module for nulls, empty texts and repeated rows."""
    return near_duplicates(spark, read(spark, sf_dir, "documents"))

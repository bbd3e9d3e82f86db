"""Exact Jaccard join of documents on their sets of word n-grams, and the groups that its links form.

1. Every text becomes a set of 64-bit shingle hashes. Documents with equal sets
   form one class and go on as one set.
2. Two sets of similarity t or more share one of the first
   ``n - ceil(t * n) + 1`` shingles of each in any common order. Order: rare shingles by
   hash, then those that a part of the corpus shows to be common, by frequency. The
   frequencies only steer the order; every order finds every link.
3. Rows (shingle, set) are dealt and sorted by shingle. A shingle of a few sets gives
   their pairs; one of many gives a chain of neighbours by size.
4. A pair's bitmap signatures (at least four bits for each element) bound the
   intersection from above; what may still reach t is checked on the sorted arrays.
5. For shingles of many sets, the sets that are not connected by then meet in tiles:
   sets of one shingle whose sizes lie in one band, or in the next, in blocks of
   bounded size. Bitmaps bound all pairs of a tile at once. First each set's likeliest
   partner of another group is checked exactly, round by round, which joins large groups
   at a row for each set; then every pair that is still apart.

No step gathers a group: chains and tiles stand in for pairs inside a group of copies,
and no link between different texts is lost, as every pair of sets that could link is
either checked or joined by other links.

Defined results: null and empty texts have no shingles and stay alone; a text with fewer
words than a shingle has one shingle of all its words; rows with equal doc_id are rows of
their own; a group is named by its smallest non-null doc_id (null if it has none);
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricepanel.llm import tables
from pricepanel.llm import textbytes as tb
from pricepanel.llm.components import merged
from pricepanel.session import stage

SHINGLE = 5
PERCENT = 80
#: A shingle of up to this many sets gives all their pairs, of more a chain of these steps.
DIRECT = 8
CHAIN = (1, 2, 4)
#: Rounds of likeliest partners end when fewer than one in so many of them links.
ENOUGH = 20
#: Sets per block of a tile.
BLOCK = 512
#: One in so many documents is read for common shingles, and at most so many shingles are sent to all tasks.
ORDER_SHARE = 64
ORDER_SHINGLES = 1 << 17
ORDER_COUNT = 3

_SIGNATURE = np.uint64(0x5851F42D4C957F2D)
_BITMAP = np.uint64(0x14057B7EF767814F)
_CLASS = ["n", "sig1", "sig2"]
_TEXT = ["_text1", "_text2"]


def document_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    hashes, first = tb.word_hashes(tb.ASCII_LOWER[data], offsets)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield np.unique(tb.shingle_hashes(hashes[a:b], size))


def signatures(found: np.ndarray) -> tuple[int, int]:
    """Two sums over the elements that tell equal sets."""
    with np.errstate(over="ignore"):
        return int(found.sum(dtype=np.uint64).view(np.int64)), int(tb.mix(found ^ _SIGNATURE).sum(dtype=np.uint64).view(np.int64))


def bitmap(found: np.ndarray) -> bytes:
    """A hashed bitmap of the next power of two from four bits for each element on."""
    width = max(64, 1 << int(4 * len(found) - 1).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(tb.mix(found + _BITMAP) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap as one of fewer words."""
    while len(bits) > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def most_common(na, nb, only_a, only_b):
    """An upper bound of the intersection from the numbers of bits that only one of two bitmaps has."""
    return np.minimum(na - only_a, nb - only_b)


def reaches(overlap, na, nb, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def prefix(found: np.ndarray, percent: int, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first elements in the common order: enough to meet any similar set."""
    need = len(found) - -(-percent * len(found) // 100) + 1
    if not len(common) or not len(found):
        return found[:need]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    known = common[at] == found
    rare = found[~known][:need]
    if len(rare) == need:
        return rare
    shared = found[known][np.argsort(ranks[at[known]])]
    return np.concatenate([rare, shared[: need - len(rare)]])


def common_shingles(docs: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found often in one of ``ORDER_SHARE`` documents, sorted, and their rank from rare to frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in tb.slices(batch, "text"):
                sets = [*document_sets(data, offsets, size), np.zeros(0, np.uint64)]
                found, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ORDER_SHARE)) == 0).select("text")
    counts = part.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= ORDER_COUNT).orderBy(F.desc("n"), "key").limit(ORDER_SHINGLES).collect()
    keys = np.array([r["key"] for r in top], dtype=np.int64).view(np.uint64)
    ranks = np.arange(len(keys))[::-1]
    order = np.argsort(keys)
    return keys[order], ranks[order]


def sketch(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: number, id, set size, two signatures, bitmap, and prefix of its set; then any further columns, all long."""
    common, ranks = common_shingles(docs, size)
    more = [c for c in docs.columns if c not in ("doc_id", "text")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                sets = list(document_sets(data, offsets, size))
                marks = [signatures(s) for s in sets]
                heads = [prefix(s, percent, common, ranks).view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, heads)])
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*heads, np.zeros(0, np.int64)])))
                yield pa.record_batch([
                    tables.row_numbers(task, before, len(sets)), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                    pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()), keys, *(part.column(c) for c in more),
                ], ["row_id", "doc_id", "n", "sig1", "sig2", "bits", "keys", *more])
                before += len(sets)

    kinds = ["row_id long, doc_id long, n long, sig1 long, sig2 long, bits binary, keys array<long>", *(f"{c} long" for c in more)]
    return docs.mapInArrow(rows, ", ".join(kinds))


def _pairs_of(key: np.ndarray, rid: np.ndarray, n: np.ndarray, steps, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one key that lie ``steps`` apart and whose sizes allow the similarity."""
    found = []
    for d in steps:
        same = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else np.zeros(0, np.int64)
        same = same[100 * n[same] >= percent * n[same + d]]
        found.append((rid[same], rid[same + d]))
    a, b = (np.concatenate(x) for x in zip(*found))
    return np.minimum(a, b), np.maximum(a, b)


def near_pairs(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """From (key, rid, n): candidate pairs (kind 0: a, b), and the rows of keys with many sets (kind 1: key a, rid b, n).

    Tasks read their rows in the order of key and size and hold one batch, or a few rows of a key that goes on.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64) for _ in range(3)]
        going = False  # the kept rows belong to a key with many sets, whose rows went out already

        def out(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a), pa.array(b), pa.array(n)], ["kind", "a", "b", "n"])

        def done(key, rid, n, old: int) -> Iterator[pa.RecordBatch]:
            """Pairs of whole keys; the first ``old`` rows went out before as rows of a large key."""
            change = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(change, append=len(key))
            size = np.repeat(size, size)
            large = size > DIRECT
            if old:
                large[key == key[0]] = True
            few = np.flatnonzero(~large & (size > 1))
            if len(few):
                a, b = _pairs_of(key[few], rid[few], n[few], range(1, DIRECT), percent)
                yield out(0, a, b, np.zeros(len(a), np.int64))
            many = np.flatnonzero(large)
            if len(many):
                a, b = _pairs_of(key[many], rid[many], n[many], CHAIN, percent)
                yield out(0, a, b, np.zeros(len(a), np.int64))
                new = many[many >= old]
                yield out(1, key[new], rid[new], n[new])

        for batch in batches:
            fresh = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            old = len(kept[0]) if going else 0
            key, rid, n = (np.concatenate(x) for x in zip(kept, fresh))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from done(key[:last], rid[:last], n[:last], old)
                old = 0
            key, rid, n = key[last:], rid[last:], n[last:]
            going = old > 0 or len(key) > DIRECT
            if going:
                # of a key that goes on, only the last rows are kept: the next ones chain to them
                yield from done(key, rid, n, old or len(key))
                if not old:
                    yield out(1, key, rid, n)
                keep = max(CHAIN)
                key, rid, n = key[-keep:], rid[-keep:], n[-keep:]
            kept = [key, rid, n]
        if len(kept[0]):
            yield from done(*kept, len(kept[0]) if going else 0)

    dealt = rows.repartition(F.col("key")).sortWithinPartitions("key", "n", "rid")
    return dealt.select("key", "rid", "n").mapInArrow(scan, "kind int, a long, b long, n long")


def bounded(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose bitmaps allow the similarity, with the bound of their intersection."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            only = np.zeros((2, len(na)), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("bits_a"), batch.column("bits_b"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                width = min(len(x), len(y))
                x, y = fold(x, width), fold(y, width)
                only[0, i], only[1, i] = np.bitwise_count(x & ~y).sum(), np.bitwise_count(y & ~x).sum()
            bound = most_common(na, nb, *only)
            good = np.flatnonzero(reaches(bound, na, nb, percent))
            yield pa.record_batch([batch.column("a").take(pa.array(good)), batch.column("b").take(pa.array(good)), pa.array(bound[good])], ["a", "b", "bound"])

    a = sets.select(F.col("row_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    b = sets.select(F.col("row_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(keep, "a long, b long, bound long")


def arrays_of(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Sorted shingle arrays (as bytes) of the wanted sets, made again from the texts: row_id, elements.

    Texts are found by doc_id and recognised by their set's signatures, since several rows may share an id.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                sets = list(document_sets(data, offsets, size))
                asked = zip(*(part.column(c).to_pylist() for c in _CLASS))
                good = [i for i, (s, c) in enumerate(zip(sets, asked)) if (len(s), *signatures(s)) == c]
                yield pa.record_batch([part.column("row_id").take(pa.array(good, pa.int64())), pa.array([sets[i].tobytes() for i in good], pa.binary())], ["row_id", "elements"])

    texts = docs.select(F.col("doc_id").alias("of_doc"), "text")
    found = texts.join(wanted, F.col("of_doc").eqNullSafe(F.col("doc_id"))).select("text", "row_id", *_CLASS)
    return found.mapInArrow(make, "row_id long, elements binary").dropDuplicates(["row_id"])


def verified(pairs: DataFrame, arrays: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets reach the similarity, by exact intersection of the sorted arrays."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    x = arrays.select(F.col("row_id").alias("a"), F.col("elements").alias("x"))
    y = arrays.select(F.col("row_id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(keep, "a long, b long")


def tile_pairs(rows: DataFrame, sets: DataFrame, percent: int = PERCENT, best: bool = False) -> DataFrame:
    """From (key, rid, n, root): pairs of one key, of different roots, that size and bitmaps allow.

    With ``best``, only the likeliest partner of each set in its tile.

    Sets of one key meet in tiles of their size band and the next, cut into blocks; a tile is a
    pair of blocks and holds two blocks at most.
    """
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    banded = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(1e-9)))
    # a set stands in its own band, and as a guest in the band below
    banded = banded.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") - F.col("guest"))
    sizes = banded.groupBy("key", "band").agg(F.count(F.lit(1)).alias("k"), F.min("guest").alias("own")).where("k > 1 and own = 0")
    blocked = banded.join(sizes, ["key", "band"]).withColumn("m", F.ceil(F.col("k") / BLOCK)).withColumn("i", F.pmod(F.xxhash64("rid"), F.col("m")))
    placed = blocked.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    tiles = placed.select("key", "band", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "rid", "n", "root", "guest")
    tiles = tiles.join(sets.select(F.col("row_id").alias("rid"), "bits"), "rid")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "band", "low", "high", "i", "rid", "n", "root", "guest")
        kept: list = [*(np.zeros(0, np.int64) for _ in names), []]

        def tile(lo: int, hi: int, cols, bits) -> pa.RecordBatch:
            _, _, low, high, block, rid, n, root, guest = (c[lo:hi] for c in cols)
            maps = [np.frombuffer(x, np.uint64) for x in bits[lo:hi]]
            width = min(len(x) for x in maps)
            maps = np.stack([fold(x, width) for x in maps])
            found = []
            for x in range(hi - lo):
                other = np.arange(0 if best else x + 1, hi - lo)
                other = other[(root[other] != root[x]) & (guest[other] + guest[x] < 2)]
                if low[x] != high[x]:
                    other = other[block[other] != block[x]]
                other = other[100 * np.minimum(n[other], n[x]) >= percent * np.maximum(n[other], n[x])]
                if not len(other):
                    continue
                bound = most_common(n[x], n[other], np.bitwise_count(maps[x] & ~maps[other]).sum(axis=1), np.bitwise_count(maps[other] & ~maps[x]).sum(axis=1))
                good = reaches(bound, n[x], n[other], percent)
                if best and good.any():
                    share = np.where(good, bound / (n[x] + n[other] - bound), -1.0)
                    other = other[share.argmax() :][:1]
                else:
                    other = other[good]
                found.append(np.stack([np.minimum(rid[x], rid[other]), np.maximum(rid[x], rid[other])]))
            a, b = np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1)
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in (*batches, None):
            cols, bits = kept[:-1], kept[-1]
            if batch is not None:
                fresh = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
                cols = [np.concatenate(x) for x in zip(cols, fresh)]
                bits = bits + batch.column("bits").to_pylist()
            if not len(cols[0]):
                continue
            edge = np.append(True, np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))
            edges = [*np.flatnonzero(edge).tolist(), len(bits)]
            whole = edges if batch is None else edges[:-1]
            for lo, hi in zip(whole[:-1], whole[1:]):
                if hi - lo > 1:
                    yield tile(lo, hi, cols, bits)
            kept = [*(c[whole[-1] :] for c in cols), bits[whole[-1] :]]

    by = ["key", "band", "low", "high"]
    dealt = tiles.repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(scan, "a long, b long")


def _linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The sketches of all documents, and the classes of equal sets with the root of each one's group."""
    rows = stage(sketch(docs, size, percent), "sets")
    light = rows.where("n > 0").select("row_id", "doc_id", *_CLASS)
    classes = stage(light.groupBy(*_CLASS).agg(F.min(F.struct("row_id", "doc_id")).alias("one"), F.min("doc_id").alias("least")), "classes")
    classes = classes.select(*_CLASS, F.col("one.row_id").alias("row_id"), F.col("one.doc_id").alias("doc_id"), "least")
    copies = light.join(classes.select(*_CLASS, F.col("row_id").alias("rep")), _CLASS).where("row_id <> rep").select("row_id")
    sets = rows.where("n > 0").join(copies, "row_id", "left_anti")

    near = sets.select(F.col("row_id").alias("rid"), "n", F.explode("keys").alias("key"))
    near = stage(near_pairs(near, percent), "near")
    info = rows.select("row_id", "n", "bits")
    pairs = near.where("kind = 0").select("a", "b").distinct()
    hopeful = stage(bounded(pairs, info, percent), "hopeful")
    arrays = stage(_arrays(docs, hopeful, classes, size), "arrays")
    # one likely partner for each set connects most groups; the rest is checked only across what is still apart
    first = hopeful.groupBy("b").agg(F.max_by("a", F.struct("bound", "a")).alias("a"))
    roots = merged(None, verified(first, arrays, percent))
    roots = merged(roots, verified(_apart(hopeful, roots).select("a", "b"), arrays, percent))

    crowded = near.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("rid"), "n")
    checked = hopeful.select("a", "b")
    while True:
        # each set of a crowded shingle meets its likeliest partner outside its group, until few of them link
        tiled = stage(tile_pairs(_mixed(crowded, roots), info, percent, best=True).distinct().join(checked, ["a", "b"], "left_anti"), "tiles")
        more = stage(verified(tiled, _arrays(docs, tiled, classes, size), percent), "checked")
        checked = checked.unionByName(tiled)
        found = more.count()
        if found:
            roots = merged(roots, more)
        if found * ENOUGH <= tiled.count():
            break
    # then what no partner decides: every pair of sets that are still apart
    tiled = stage(tile_pairs(_mixed(crowded, roots), info, percent).distinct().join(checked, ["a", "b"], "left_anti"), "tiles")
    roots = merged(roots, verified(tiled, _arrays(docs, tiled, classes, size), percent))

    return rows, classes.join(roots.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("root", F.coalesce("root", "row_id"))


def similar_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    rows, named = _linked(tables.texts(docs), size, percent)
    light = rows.where("n > 0").select("doc_id", *_CLASS)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = named.join(least, "root").select(*_CLASS, "component_id")
    linked = light.join(grouped, _CLASS).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _arrays(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    return arrays_of(docs, classes.join(nodes, "row_id", "left_semi").select("row_id", "doc_id", *_CLASS), size)


def _mixed(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of crowded shingles whose sets are not all connected, with the root of each set; a written table."""
    named = crowded.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    return stage(named.join(mixed, "key", "left_semi").select("key", "rid", "n", "root"), "crowded")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose two sets no chain of links connects yet."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The document of smallest id of each group, with all its columns.

    Each text is judged by its own group, also where rows share an id or have none. Of a group's texts under its
    smallest id, or of a group without any id, that of smallest hash stays. Rows without shingles all stay; rows
    of equal id and text count as one document.
    """
    rows, named = _linked(_marked(tables.texts(docs)))
    rows = rows.select("doc_id", "n", "sig1", "sig2", *_TEXT)
    # the choice is made for each class of equal sets first, then for each group
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *_TEXT)
    best = rows.where("n > 0").groupBy(*_CLASS).agg(F.min(order).alias("best"))
    best = best.join(named.select(*_CLASS, "root"), _CLASS).groupBy("root").agg(F.min("best").alias("best"))
    stays = best.select("best.doc_id", *(f"best.{c}" for c in _TEXT))
    again = rows.groupBy("doc_id", *_TEXT).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
    keys = [F.col(f"own.{c}").eqNullSafe(F.col(f"stays.{c}")) for c in ("doc_id", *_TEXT)]
    own = again.alias("own").join(stays.withColumn("chosen", F.lit(True)).alias("stays"), keys, "left").where("own.n = 0 or chosen")
    own = stage(own.select(F.col("own.doc_id").alias("_kept"), *(F.col(f"own.{c}").alias(f"_own{c}") for c in _TEXT), (F.col("k") > 1).alias("_again")), "kept")
    kept = _marked(docs).join(own, [F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")), *(F.col(c) == F.col(f"_own{c}") for c in _TEXT)])
    plain, odd = kept.where("not _again"), kept.where("_again")
    if not own.where("_again").isEmpty():
        plain = plain.unionByName(odd.dropDuplicates(["doc_id", "text"]))
    return plain.select(docs.columns)


def _marked(docs: DataFrame) -> DataFrame:
    """With two hashes of the text, which tell equal texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({_TEXT[0]: F.xxhash64(text), _TEXT[1]: F.xxhash64(F.lit(1), text)})


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(tables.table(spark, sf_dir, "documents"))

"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document's row of the incidence is the set of its distinct ``size``-word n-grams (A-Z lower-cased, words are what blanks
part; a text of fewer words is one n-gram; a text without words has no row and no links). Documents with equal sets share one
node, named by a 64-bit hash of the set, and copies are never paired.

Bounds that follow from the sizes keep the product sparse and lose nothing. In any fixed order of the n-grams, two sets with
Jaccard similarity t share one of their first n - ceil(t n) + 1 n-grams, so only these columns are multiplied. The order is by
hash, with frequent n-grams (``FREQUENT`` sets or more; the ``MOST`` most frequent at most, a bounded broadcast; counted over
all sets) last and the most frequent of them at the end: the order decides the work, never the result. Columns are dealt to blocks by hash. A block multiplies its
columns and adds up the overlap of each pair; the overlaps are added over the blocks, and a pair is dropped when its overlap
plus all that may follow cannot reach ceil(t / (1 + t) (n1 + n2)). The rest are intersected in full.

A column still longer than ``LONG`` (large groups of near copies) gives no pairs but a list of its sets. Each set is compared
with one leader of the column. When the components of all links found so far are known, sets of columns that hang together
form a cluster; where it has several components, the sets outside the largest are multiplied with all others in blocks of
``TILE`` by ``TILE`` sets, and a block returns only links that connect. Pairs left out lie inside one component already.
That is for components only: ``links`` and ``counted`` multiply every cluster in full and leave out nothing.

Null and empty texts: no n-grams, alone in their component. Equal rows are members of one node. A null id never is the
smallest; a component of null ids only has a null id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.llm import words as W
from formweave.llm.graph import components
from formweave.llm.tables import stored

SIZE, PERCENT = 5, 80
FREQUENT, MOST, LONG, TILE = 64, 1 << 20, 64, 512


def sets_of(w: W.Words, size: int) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each text."""
    h, at = w.windows(size)
    first, count = np.searchsorted(at, w.first), w.count()
    short = {}
    for k in range(1, size):
        if (count == k).any():
            g, start = w.windows(k)
            short[k] = dict(zip(start.tolist(), g, strict=True))
    for d, c in enumerate(count.tolist()):
        if c >= size:
            s = np.sort(h[first[d] : first[d + 1]])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            yield np.array([short[c][int(w.first[d])]] if c else [], np.uint64)


def node_of(s: np.ndarray) -> int:
    """The name of a set: order does not matter."""
    with np.errstate(over="ignore"):
        return int(W.mix(np.array([W.mix(s, 5).sum(dtype=np.uint64) + np.uint64(len(s))]), 6).view(np.int64)[0])


def first_count(n, percent: int):
    """How many n-grams of a set of n are multiplied: n - ceil(t n) + 1."""
    return n - (n * percent + 99) // 100 + 1


def _sets(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for a, _, w in W.words(batch.column(text), lower=True):
            yield batch, a, list(sets_of(w, size))


def members(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``doc_id``, ``th`` (hash of the text), ``node`` (null without n-grams), ``n_shingles`` per row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, sets in _sets(batches, 2, size):
            k = len(sets)
            yield pa.record_batch([batch.column(0).slice(a, k), batch.column(1).slice(a, k), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
                                  names=["doc_id", "th", "node", "n_shingles"])

    return rows.mapInArrow(run, f"doc_id {kind}, th long, node long, n_shingles long")


class _Blobs:
    """Columns of numbers, dealt to blocks and sent as one binary row per block."""

    def __init__(self, blocks: int, *kinds):
        self.bits, self.kinds, self.held, self.n = blocks.bit_length() - 1, kinds, [[] for _ in kinds], 0

    def add(self, *columns: np.ndarray) -> None:
        for h, c in zip(self.held, columns, strict=True):
            h.append(c)
        self.n += len(columns[0])

    def rows(self, group: bool = False) -> pa.RecordBatch:
        """The first column's upper bits are the block, its lower 32 bits are sent. group: equal numbers once, with their count."""
        cols = [np.concatenate(h) if h else np.empty(0, k) for h, k in zip(self.held, self.kinds, strict=True)]
        if group:
            v, c = np.unique(cols[0], return_counts=True)
            cols = [v, c.astype(np.uint32)]
        block = (cols[0] >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        at = np.searchsorted(block[order], np.arange((1 << self.bits) + 1))
        have = np.flatnonzero(np.diff(at))
        cols = [cols[0].astype(np.uint32), *cols[1:]]
        self.held, self.n = [[] for _ in self.kinds], 0
        return pa.record_batch([pa.array(have, pa.int32()), *[pa.array([c[order[at[b] : at[b + 1]]].tobytes() for b in have.tolist()], pa.binary()) for c in cols]],
                               names=["block", *[f"c{i}" for i in range(len(cols))]])


def _blocks(docs: DataFrame) -> int:
    return 1 << max(4, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


def frequent(docs: DataFrame, text: str, size: int, least: int = FREQUENT, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (block, lower bits) of the n-grams that ``least`` or more sets hold, and how many; at most ``most`` of them."""
    blocks = _blocks(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = _Blobs(blocks, np.uint64), set()
        for _, _, sets in _sets(batches, 0, size):
            for s in sets:
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    out.add(s)
            if out.n > 4 << 20:
                yield out.rows(group=True)
                seen.clear()
        yield out.rows(group=True)

    def add_up(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        v, c = _joined(table, "c0", np.uint32), _joined(table, "c1", np.uint32)
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        total = np.add.reduceat(c.astype(np.int64), at)
        keep = total >= least
        return pa.table({"key": (v[at][keep].astype(np.int64) | (block << 32)), "sets": total[keep]})

    sums = docs.select(text).mapInArrow(count, "block int, c0 binary, c1 binary").groupBy("block").applyInArrow(add_up, "key long, sets long")
    top = sums.orderBy(F.desc("sets"), "key").limit(most).toPandas().sort_values("key")
    return top["key"].to_numpy(np.int64), top["sets"].to_numpy(np.int64)


def product(docs: DataFrame, text: str, size: int, percent: int, late: tuple[np.ndarray, np.ndarray], long: int = LONG) -> DataFrame:
    """``a``, ``b``, ``na``, ``nb``, ``n`` (overlap within a block) per pair, and rows with ``b`` null: ``a`` is listed in the long column ``n``."""
    blocks = _blocks(docs)
    bits = blocks.bit_length() - 1
    known = docs.sparkSession.sparkContext.broadcast(late)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen, (late, sets_with) = _Blobs(blocks, np.uint64, np.int64, np.int32), set(), known.value
        for _, _, sets in _sets(batches, 0, size):
            for s in sets:
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                n = len(s)
                p = first_count(n, percent)
                take = s[:p]
                if len(late):
                    key = (s >> np.uint64(64 - bits)).astype(np.int64) << 32 | (s & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    at = np.minimum(np.searchsorted(late, key), len(late) - 1)
                    often = late[at] == key
                    if often[:p].any():
                        take = s[np.argsort(np.where(often, sets_with[at], 0), kind="stable")[:p]]
                out.add(take, np.full(len(take), node, np.int64), np.full(len(take), n, np.int32))
            if out.n > 2 << 20:
                yield out.rows()
                seen.clear()
        yield out.rows()

    def multiply(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        g, node, n = _joined(table, "c0", np.uint32), _joined(table, "c1", np.int64), _joined(table, "c2", np.int32)
        order = np.lexsort((node, n, g))
        g, node, n = g[order], node[order], n[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (node[1:] != node[:-1])])
        g, node, n = g[new], node[new], n[new]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        length = np.diff(np.append(start, len(g)))
        listed = np.repeat(length > long, length)
        column = np.repeat(start, length)
        hot = np.flatnonzero(listed)
        i = np.flatnonzero(~listed & np.repeat(length > 1, length))
        left, right = [], []
        for k in range(1, long):
            i = i[i + k < len(g)]
            i = i[column[i] == column[np.minimum(i + k, len(g) - 1)]]
            i = i[n[i].astype(np.int64) * 100 >= n[i + k].astype(np.int64) * percent]  # sorted by size: later ones are larger still
            if not len(i):
                break
            left.append(i)
            right.append(i + k)
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        swap = node[i] > node[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        order = np.lexsort((node[j], node[i]))
        i, j = i[order], j[order]
        at = np.flatnonzero(np.concatenate([[True], (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1])])) if len(i) else np.empty(0, np.int64)
        overlap = np.diff(np.append(at, len(i)))
        i, j = i[at], j[at]
        name = g[hot].astype(np.int64) | (block << 32)
        return pa.table({
            "a": np.concatenate([node[i], node[hot]]), "b": pa.concat_arrays([pa.array(node[j], pa.int64()), pa.nulls(len(hot), pa.int64())]),
            "na": np.concatenate([n[i], n[hot]]).astype(np.int64), "nb": np.concatenate([n[j], n[hot]]).astype(np.int64), "n": np.concatenate([overlap, name]).astype(np.int64),
        })

    return docs.select(text).mapInArrow(rows, "block int, c0 binary, c1 binary, c2 binary").groupBy("block").applyInArrow(multiply, "a long, b long, na long, nb long, n long")


def _grams(nodes: DataFrame, docs: DataFrame, who: DataFrame, text: str, size: int) -> DataFrame:
    """``node``, ``grams`` (the whole set, sorted) of the nodes asked for, one row each.

    A node is read from one row. Only where rows repeat as a whole, several are read and all but one dropped; otherwise
    no sum stands before the joins that follow, and Spark can split those where many pairs share a node.
    """
    one = who.where("node is not null").groupBy("node").agg(F.min(F.struct("th", "doc_id")).alias("k")).join(nodes, "node", "left_semi").select("k.th", F.col("k.doc_id").alias("_id")).distinct()
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    rows = rows.alias("r").join(one.alias("o"), (F.col("r.th") == F.col("o.th")) & F.col("r._id").eqNullSafe(F.col("o._id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets in _sets(batches, 0, size):
            yield pa.record_batch([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "grams"])

    grams = rows.mapInArrow(run, "node long, grams array<long>")
    single = who.groupBy("doc_id", "th").count().where("count > 1").isEmpty()
    return grams if single else grams.dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, who: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """Links among the pairs (a, b), by intersecting whole sets: ``a``, ``b``, ``overlap``."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    grams = _grams(need, docs, who, text, size)
    both = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ga", "gb")).cast("long").alias("overlap"), (F.size("ga") + F.size("gb")).alias("sum"))
    return both.where(F.col("overlap") * 100 >= percent * (F.col("sum") - F.col("overlap"))).select("a", "b", "overlap")


def _tiled(listed: DataFrame, labels: DataFrame, docs: DataFrame, who: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """Links between components among sets whose long columns hang together: ``a``, ``b``, ``overlap``."""
    leader = listed.groupBy("col").agg(F.min("a").alias("lead"))
    hang = listed.join(leader, "col").select("a", F.col("lead").alias("b")).distinct()
    clusters = components(hang).select(F.col("node"), F.col("label").alias("cluster"))
    own = clusters.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = own.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("all"), F.count("*").alias("k")).where("k > 1")
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = sizes.select("cluster", F.col("m.label").alias("main"), tiles(F.col("m.count")).alias("mains"), tiles(F.col("all") - F.col("m.count")).alias("rests"))
    own = own.join(sizes, "cluster").withColumn("rest", F.col("label") != F.col("main"))
    own = own.withColumn("tile", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pair = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    where = F.when(F.col("rest"), F.concat(F.transform(upto("mains"), lambda j: pair(F.col("tile"), j, 0)), F.transform(upto("rests"), lambda j: pair(F.least("tile", j), F.greatest("tile", j), 1))))
    own = stored(own.select("node", "cluster", "label", "rest", "tile", F.explode(where.otherwise(F.transform(upto("rests"), lambda i: pair(i, F.col("tile"), 0)))).alias("at")), "tiles")
    grams = _grams(own.select("node").distinct(), docs, who, text, size)

    def multiply(table: pa.Table) -> pa.Table:
        node, label, rest = (np.asarray(table.column(c)) for c in ("node", "label", "rest"))
        lists = table.column("grams").combine_chunks()
        row, gram = np.asarray(pc.list_parent_indices(lists)), np.asarray(lists.flatten())
        n = np.bincount(row, minlength=len(node))
        _, column, held = np.unique(gram, return_inverse=True, return_counts=True)
        shared = held > 1
        place = (np.cumsum(shared) - 1)[column]
        use = np.flatnonzero(shared[column])
        use = use[np.argsort(place[use], kind="stable")]
        both = np.zeros((int(rest.sum()), len(node)), np.float32)
        for c in range(0, int(shared.sum()), 4096):  # so many columns at a time
            part = use[np.searchsorted(place[use], c) : np.searchsorted(place[use], c + 4096)]
            matrix = np.zeros((len(node), 4096), np.float32)
            matrix[row[part], place[part] - c] = 1
            both += matrix[rest] @ matrix.T
        both = np.rint(both).astype(np.int64)
        i, j = np.nonzero(both * 100 >= percent * (n[rest][:, None] + n[None, :] - both))
        i = np.flatnonzero(rest)[i]
        up = {int(x): int(x) for x in np.unique(label)}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        out = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = top(int(label[x])), top(int(label[y]))
            if a != b:
                up[a] = b
                low, high = sorted((int(node[x]), int(node[y])))
                out.append((low, high, len(np.intersect1d(gram[row == x], gram[row == y]))))
        return pa.table([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], names=["a", "b", "overlap"])

    return own.join(grams, "node").select("node", "label", "rest", "grams", "cluster", F.col("at.i").alias("i"), F.col("at.j").alias("j"), F.col("at.kind").alias("kind")).groupBy("cluster", "i", "j", "kind").applyInArrow(
        multiply, "a long, b long, overlap long")


def _found(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, frequent_from: int, long: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows as ``doc_id``, ``text``; members; sets of long columns; verified links, all but some between sets of one long column)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    who = stored(members(docs, "doc_id", "text", size), "members")
    late = frequent(docs, "text", size, frequent_from)
    made = stored(product(docs, "text", size, percent, late, long), "product")
    listed = stored(made.where("b is null").select("a", F.col("na").alias("n"), F.col("n").alias("col")), "listed")
    hot = listed.select("a").distinct()
    summed = made.where("b is not null").groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n"))
    summed = summed.join(hot.select("a", F.lit(True).alias("ha")), "a", "left").join(hot.select(F.col("a").alias("b"), F.lit(True).alias("hb")), "b", "left")
    whole = lambda c: (F.col(c) * percent + 99) / 100
    reach = F.col("n") + F.greatest(F.floor(whole("na")), F.floor(whole("nb"))) - 1
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-9)
    pairs = summed.where((reach >= needed) | (F.col("ha") & F.col("hb"))).select("a", "b")
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    leaders = listed.groupBy("col").agg(F.min(F.struct(F.col("a").alias("lead"), "n")).alias("l")).select("col", "l.lead", F.col("l.n").alias("m"))
    star = listed.join(leaders, "col").where((F.col("a") != F.col("lead")) & fits(F.col("n"), F.col("m"))).select(F.least("a", "lead").alias("a"), F.greatest("a", "lead").alias("b"))
    pairs = stored(pairs.union(star).distinct(), "pairs")
    links = stored(_verified(pairs, docs, who, "text", size, percent), "links")
    return docs, who, listed, links


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, frequent_from: int = FREQUENT, long: int = LONG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, labels): the node of each row; links ``a``, ``b``, ``overlap`` between nodes that make up all
    components (every link but those between sets of one long column that are connected already); ``node``, ``label``."""
    docs, who, listed, links = _found(docs, doc_id, text, size, percent, frequent_from, long)
    labels = components(links)
    if not listed.isEmpty():
        links = stored(links.union(_tiled(listed, labels, docs, who, text, size, percent)).distinct(), "links")
        labels = components(links)
    return who, links, labels


def _whole(listed: DataFrame, docs: DataFrame, who: DataFrame, size: int, percent: int, count: bool) -> tuple[DataFrame, DataFrame]:
    """(clusters, links inside them): sets whose long columns hang together, all multiplied with all; links ``a``, ``b``, ``overlap``,
    or summed inside the tiles to ``node``, ``n`` (rows of the linked sets)."""
    leader = listed.groupBy("col").agg(F.min("a").alias("lead"))
    hang = listed.join(leader, "col").select("a", F.col("lead").alias("b"))
    # a cluster of one set has no pairs
    clusters = stored(components(hang.where("a <> b").distinct()).select("node", F.col("label").alias("cluster")), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = who.where("node is not null").groupBy("node").agg(F.count("*").alias("rows"))
    own = clusters.join(sizes, "cluster").join(rows, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least("tile", j).alias("i"), F.greatest("tile", j).alias("j")))
    own = stored(own.select("node", "rows", "cluster", "tile", F.explode(others).alias("at")), "tiles")

    def multiply(table: pa.Table) -> pa.Table:
        node, rows, tile, i, j = (np.asarray(table.column(c)) for c in ("node", "rows", "tile", "i", "j"))
        lists = table.column("grams").combine_chunks()
        row, gram = np.asarray(pc.list_parent_indices(lists)), np.asarray(lists.flatten())
        n = np.bincount(row, minlength=len(node))
        _, column, held = np.unique(gram, return_inverse=True, return_counts=True)
        shared = held > 1
        place = (np.cumsum(shared) - 1)[column]
        use = np.flatnonzero(shared[column])
        use = use[np.argsort(place[use], kind="stable")]
        up, down = np.flatnonzero(tile == i[0]), np.flatnonzero(tile == j[0])
        both = np.zeros((len(up), len(down)), np.float32)
        for c in range(0, int(shared.sum()), 4096):  # so many columns at a time
            part = use[np.searchsorted(place[use], c) : np.searchsorted(place[use], c + 4096)]
            matrix = np.zeros((len(node), 4096), np.float32)
            matrix[row[part], place[part] - c] = 1
            both += matrix[up] @ matrix[down].T
        both = np.rint(both).astype(np.int64)
        x, y = np.nonzero(both * 100 >= percent * (n[up][:, None] + n[down][None, :] - both))
        overlap, x, y = both[x, y], up[x], down[y]
        once = x < y if i[0] == j[0] else np.ones(len(x), bool)
        overlap, x, y = overlap[once], x[once], y[once]
        if count:
            total = np.zeros(len(node), np.int64)
            np.add.at(total, x, rows[y])
            np.add.at(total, y, rows[x])
            k = np.flatnonzero(total)
            return pa.table({"node": node[k], "n": total[k]})
        return pa.table({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y]), "overlap": overlap})

    grams = _grams(own.select("node").distinct(), docs, who, "text", size)
    tiled = own.join(grams, "node").select("node", "rows", "tile", "grams", "cluster", F.col("at.i").alias("i"), F.col("at.j").alias("j"))
    return clusters, tiled.groupBy("cluster", "i", "j").applyInArrow(multiply, "node long, n long" if count else "a long, b long, overlap long")


def _apart(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links that do not lie inside one cluster."""
    of = lambda c: clusters.select(F.col("node").alias(c), F.col("cluster").alias(f"c{c}"))
    return links.join(of("a"), "a", "left").join(of("b"), "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b", "overlap")


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, frequent_from: int = FREQUENT, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(members, links): the node of each row; every link between nodes once, ``a`` < ``b``, ``overlap``. Rows of one node are equal sets."""
    docs, who, listed, found = _found(docs, doc_id, text, size, percent, frequent_from, long)
    if listed.isEmpty():
        return who, found
    clusters, inside = _whole(listed, docs, who, size, percent, False)
    return who, _apart(found, clusters).union(inside)


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, frequent_from: int = FREQUENT, long: int = LONG) -> DataFrame:
    """Per row: ``doc_id``, ``th``, ``n_links``: with how many other rows the join links it. Links inside clusters are summed in their tiles, not listed."""
    docs, who, listed, found = _found(docs, doc_id, text, size, percent, frequent_from, long)
    rows = who.where("node is not null").groupBy("node").agg(F.count("*").alias("rows"))
    parts = rows.select("node", (F.col("rows") - 1).alias("n"))
    if not listed.isEmpty():
        clusters, inside = _whole(listed, docs, who, size, percent, True)
        found, parts = _apart(found, clusters), parts.union(inside)
    for x, y in (("a", "b"), ("b", "a")):
        parts = parts.union(found.join(rows.select(F.col("node").alias(y), "rows"), y).select(F.col(x).alias("node"), F.col("rows").alias("n")))
    # stored, so that the join stands apart from the sum and Spark can split a node with many rows
    total = stored(parts.groupBy("node").agg(F.sum("n").alias("n_links")), "counted")
    return who.join(total, "node", "left").select("doc_id", "th", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, **how) -> DataFrame:
    """Per row: ``doc_id``, ``th`` (hash of the text), ``n_shingles``, ``component_id`` (smallest id of the component)."""
    who, _, labels = join(docs, doc_id, text, size, percent, **how)
    who = who.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # stored, so that the join stands apart from the sum and Spark can split a component with many rows
    least = stored(who.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    return who.join(least, "label", "left").select("doc_id", "th", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest id (then text hash), columns unchanged; rows without n-grams all stay."""
    who, _, labels = join(docs, doc_id, text, size, percent)
    who = who.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = who.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("k")).select("k.doc_id", "k.th")
    bare = who.where("label is null").select("doc_id", "th").distinct()
    keys = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    on = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th"))
    again = who.where("label is not null").groupBy("doc_id", "th").count().where("count > 1")
    kept = docs.join(keys(first.union(bare)), on, "left_semi")
    if again.isEmpty():
        return kept
    again = stored(keys(again), "again")  # rows that are there more than once
    once = docs.join(again, on).join(keys(first).withColumnsRenamed({"__id": "__id2", "__th": "__th2"}), F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__th") == F.col("__th2")), "left_semi")
    return kept.join(again, on, "left_anti").union(once.dropDuplicates(["__id", "__th"]).select(*docs.columns))

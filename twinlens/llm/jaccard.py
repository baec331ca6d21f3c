"""N-gram Jaccard join over count vectors in an R-tree under hash nodes.

A document is its set of word shingles. Shingles are hashed into groups, and
the document's point is its count in each group.

Upper storey: sets of which one has m elements at most and whose Jaccard similarity
reaches t differ in d(m) elements at most. Of d(m) + 1 + s groups, s + 1 are the same
in both, empty ones among them. In an order that depends on a group's content
only, the last of these is beyond the first s groups of either document. So each
leaves out its first s, those with the fewest elements, and documents still meet
under nodes (size class, group, the group's content); no pair is lost. All nodes
that a document shares with others under the same smallest document are one leaf.

R-tree: the points of a large leaf are packed by size into blocks of BLOCK, each
with the box of its greatest counts in COARSE groups and its least and greatest size.
The sum of the coordinate minima of two boxes bounds the overlap of any two of
their points, so block pairs that cannot hold a link are left out. Inside a block or a
block pair, points are packed again, FANOUT to a box of finer groups; the same bound is
taken with a box, then with a point; every pair that survives is verified on whole
shingle sets, in the smallest of the leaves that its sides share. No task holds more
than two blocks.

Equal sets are one class throughout; links are found between classes, all of them:
as pairs, or counted by class with a spanning forest for the components. Where
only components are asked for (keep_one), pairs in one component already are not
verified: in a large leaf all others are compared with its smallest document
first, and only those that are not in its component then with the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import byte_chunks, drop_stored, free_name, mix, quoted, stored, words
from .components import connected_components

#: Documents of a leaf that one block holds.
BLOCK = 1024
#: Points under one box of a leaf, and groups of the points that pack blocks.
FANOUT, COARSE = 16, 16


def shingles(off: np.ndarray, data: np.ndarray, n_words: int):
    """(document, hash) of the distinct shingles of each text, sorted."""
    doc, _, _, h = words(off, data, lower=True)
    n = len(off) - 1
    if not len(doc):
        return doc, h
    count = np.bincount(doc, minlength=n)
    size = np.minimum(count, n_words)  # a short text is one shingle
    first = np.cumsum(count) - count
    starts = np.flatnonzero(np.arange(len(doc)) - first[doc] <= (count - size)[doc])
    k = size[doc[starts]]
    g = k.astype(np.uint64)
    for j in range(n_words):
        ok = j < k
        g[ok] = g[ok] * np.uint64(0x9E3779B97F4A7C15) + h[starts[ok] + j]
    d, g = doc[starts], mix(g)
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])]
    return d[new], g[new]


class Nodes:
    """The upper storey for a similarity of percent / 100, in size classes that grow by
    a quarter, so that a class's smallest sets fill its groups nearly as well."""

    def __init__(self, percent: int, first: int = 9):
        self.percent, self.first = percent, first

    def differ(self, m: int) -> int:
        """Elements in which two linked sets of m at most can differ."""
        return int(2 * m * (100 - self.percent) // (100 + self.percent))

    def groups(self, m: int) -> tuple[int, int]:
        """(groups, of these left out) of the size class up to m."""
        d = self.differ(m)
        spare = max(2, -(-2 * d // 5))
        return d + 1 + spare, spare

    def tops(self, largest: int) -> list[int]:
        """The greatest sizes of the classes, as far as sets of `largest` elements need."""
        tops = [self.first]
        while tops[-1] < largest:
            tops.append(tops[-1] * 5 // 4)
        return tops

    def keys(self, doc: np.ndarray, h: np.ndarray, n: np.ndarray):
        """(document, node key) for documents of n elements with (doc, h), sorted by
        document. Linked sets meet in the larger one's class, so a document is in
        all classes from its own to that of its largest partner."""
        first, partner = np.cumsum(n) - n, n * 100 // self.percent
        docs, keys, below = [], [], 0
        for m in self.tops(int(partner.max(initial=0))):
            own = np.flatnonzero((n > 0) & (n <= m) & (partner > below))
            below = m
            if not len(own) or not self.differ(m):
                continue  # without a difference only equal sets are linked
            groups, spare = self.groups(m)
            size = n[own]
            at = np.repeat(np.arange(len(own)), size)
            e = h[np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            cell = at * groups + ((e >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
            content = np.zeros(len(own) * groups, np.uint64)
            np.add.at(content, cell, mix(e + np.uint64(m)))
            group = np.tile(np.arange(groups, dtype=np.uint64), len(own))
            key = mix(content + mix(group * np.uint64(0x9E3779B97F4A7C15) + np.uint64(m)))
            count = np.minimum(np.bincount(cell, minlength=len(content)), 255).astype(np.uint64)
            rank = ((count << np.uint64(56)) | (key >> np.uint64(8))).reshape(-1, groups)
            keep = (rank >= np.partition(rank, spare, axis=1)[:, spare : spare + 1]).ravel()
            docs.append(np.repeat(own, groups)[keep])
            keys.append(key[keep])
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        docs, keys = np.concatenate(docs), np.concatenate(keys)
        order = np.argsort(docs, kind="stable")
        return docs[order], keys[order]


_DDL = "id long, n long, print_a long, print_b long, keys array<long>, point array<int>"


def _points(n_words: int, percent: int):
    nodes = Nodes(percent)

    def run(batches):
        for b in batches:
            for at, off, data in byte_chunks(b.column(1)):
                size = len(off) - 1
                doc, h = shingles(off, data, n_words)
                n = np.bincount(doc, minlength=size)
                prints = np.zeros((2, size), np.uint64)
                np.add.at(prints[0], doc, mix(h ^ np.uint64(0x5851F42D4C957F2D)))
                np.add.at(prints[1], doc, mix(h ^ np.uint64(0x14057B7EF767814F)))
                owner, keys = nodes.keys(doc, h, n)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=size)))).astype(np.int32)
                point = np.bincount(doc * COARSE + (h % np.uint64(COARSE)).astype(np.int64), minlength=size * COARSE).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, size), pa.array(n), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * COARSE), pa.array(point))],
                    names=["id", "n", "print_a", "print_b", "keys", "point"],
                )

    return run


def leaf_links(sets: list[np.ndarray], block: np.ndarray, across: bool, percent: int, early: list[set] | None = None) -> tuple[list, list]:
    """(links, forest) of sorted sets, as pairs of positions; across: only pairs in
    different blocks are looked at.

    `early` has the smaller leaves of each set; a pair that shares one of them is
    left to it, and links are all others. Without `early`, only pairs that join two
    components are verified, and links are no more than the spanning forest.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets])
    dims = 1 << int(np.clip(np.ceil(np.log2(max(n.mean(), 1))), 5, 9))
    point = np.zeros((m, dims), np.int32)
    np.add.at(point, (np.repeat(np.arange(m), n), (np.concatenate(sets) % np.uint64(dims)).astype(np.int64)), 1)
    order = np.lexsort((point[:, 1], point[:, 0], n))
    sets, point, n, block = [sets[i] for i in order], point[order], n[order], block[order]
    boxes = np.arange(0, m, FANOUT)
    box, box_n = np.maximum.reduceat(point, boxes, axis=0), np.maximum.reduceat(n, boxes)
    label, links, forest = np.arange(m), [], []  # label: the component of each
    if early is not None:
        early = [early[i] for i in order]
        elements, number = np.unique(np.concatenate(sets), return_inverse=True)
        number = np.split(number.astype(np.int32), np.cumsum(n)[:-1])
        mark = np.zeros(len(elements), np.uint8)
    for i in range(1, m):
        # partners before i, so no larger: the overlap needed grows with their size
        near = np.flatnonzero((box_n[: i // FANOUT + 1] * 100 >= percent * n[i]))
        near = near[np.minimum(box[near], point[i]).sum(1) * (100 + percent) >= percent * (n[i] + np.ceil(percent * n[i] / 100))]
        if not len(near):
            continue
        j = (near[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        j = j[j < i]
        j = j[n[j] * 100 >= percent * n[i]]
        if early is None:
            j = j[label[j] != label[i]]
        if across:
            j = j[block[j] != block[i]]
        if len(j):
            j = j[np.minimum(point[j], point[i]).sum(1) * (100 + percent) >= percent * (n[j] + n[i])]
        if early is None:
            for k in j[::-1]:
                if label[k] == label[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[k] - both):
                    label[label == label[k]] = label[i]
                    forest.append((int(order[i]), int(order[k])))
            continue
        if early[i]:
            j = j[[early[i].isdisjoint(early[k]) for k in j]] if len(j) else j
        if not len(j):
            continue
        mark[number[i]] = 1
        both = np.add.reduceat(mark[np.concatenate([number[k] for k in j])], np.cumsum(n[j]) - n[j], dtype=np.int64)
        mark[number[i]] = 0
        for k in j[100 * both >= percent * (n[i] + n[j] - both)]:
            links.append((int(order[i]), int(order[k])))
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                forest.append(links[-1])
    return (forest if early is None else links), forest


def _leaf(n_words: int, percent: int, want: str):
    """Rows (a, b, n) of one leaf, or of a pair of its blocks: links a < b with n null,
    all of them ("pairs") or a spanning forest; with "counts" also, with b null, the
    number n of a's links found here."""

    def run(table: pa.Table) -> pa.Table:
        ids, block, sets = table["id"].to_numpy(), table["block"].to_numpy(), []
        for _, off, data in byte_chunks(table["text"]):
            doc, h = shingles(off, data, n_words)
            sets += np.split(h, np.cumsum(np.bincount(doc, minlength=len(off) - 1))[:-1])
        early = None if want == "forest" else [set(x) for x in table["early"].to_pylist()]
        across = table["i"][0].as_py() != table["j"][0].as_py()
        # repeated rows of an id are one side of a link
        links, forest = (np.sort(ids[np.array(x, np.int64).reshape(-1, 2)], axis=1) for x in leaf_links(sets, block, across, percent, early))
        links, forest = (np.unique(x[x[:, 0] != x[:, 1]], axis=0) for x in (links, forest))
        side, n = np.unique(links, return_counts=True) if want == "counts" else (links[:0, 0], links[:0, 0])
        out = links if want == "pairs" else forest
        none = [pa.nulls(k, pa.int64()) for k in (len(out), len(side))]
        return pa.table({
            "a": np.concatenate((out[:, 0], side)),
            "b": pa.chunked_array([pa.array(out[:, 1]), none[1]]),
            "n": pa.chunked_array([none[0], pa.array(n, pa.int64())]),
        })

    return run


def _packed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (leaf, id, ...) of large leaves with n, point and block: in order of size,
    about BLOCK documents a block. Sizes are counted in cells that grow by a fiftieth; small
    cells share a block, those of more than BLOCK documents are split by hash."""
    points = classes.select(F.col("class_id").alias("id"), "n", "point")
    sized = members.join(points, "id").withColumn("cell", F.floor(F.log("n") * 50))
    upto = Window.partitionBy("leaf").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = sized.groupBy("leaf", "cell").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))
    own = F.when(F.col("here") > BLOCK, 1 + F.pmod(F.xxhash64("id"), F.ceil(F.col("here") / BLOCK))).otherwise(F.lit(0))
    block = F.floor(F.col("before") / BLOCK) * (1 << 32) + own
    return sized.join(cells, ["leaf", "cell"]).withColumn("block", block).drop("cell", "here", "before")


def _boxes(packed: DataFrame) -> DataFrame:
    box = F.array(*[F.max(F.get("point", F.lit(k))) for k in range(COARSE)])
    return packed.groupBy("leaf", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), box.alias("box"))


def _block_pairs(one: DataFrame, other: DataFrame, percent: int) -> DataFrame:
    """(leaf, i, j) of the boxes of both tables that can hold a link between them."""
    a = one.select("leaf", *[F.col(c).alias(f"a_{c}") for c in ("block", "least", "most", "box")])
    b = other.select("leaf", *[F.col(c).alias(f"b_{c}") for c in ("block", "least", "most", "box")])
    near = (F.col("a_most") * 100 >= F.col("b_least") * percent) & (F.col("b_most") * 100 >= F.col("a_least") * percent)
    common = F.aggregate(F.zip_with("a_box", "b_box", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    # 100 * overlap >= percent * union, the union being the sizes' sum without the overlap
    enough = common * (100 + percent) >= (F.col("a_least") + F.col("b_least")) * percent
    return a.join(b, "leaf").where(near & enough).select("leaf", F.col("a_block").alias("i"), F.col("b_block").alias("j"))


def _dealt(packed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each member once for each pair that its block is in."""
    sides = pairs.select("leaf", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return packed.drop("n", "point").join(sides, ["leaf", "block"])


def _meet(df: DataFrame, id_col: str, text_col: str, n_words: int, percent: int, want: str) -> tuple[DataFrame, DataFrame]:
    """(members, found): see jaccard_classes, and _leaf for the rows of found."""
    docs = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    points = stored(docs.mapInArrow(_points(n_words, percent), _DDL), "jaccard-points")
    same = ["n", "print_a", "print_b"]
    firsts = [F.min("id").alias("class_id"), F.first("keys").alias("keys"), F.first("point").alias("point")]
    classes = stored(points.where("n > 0 and id is not null").groupBy(*same).agg(*firsts), "jaccard-classes")
    members = points.select("id", *same).join(classes.select(*same, "class_id"), same, "left")
    members = stored(members.select("id", "n", F.coalesce("class_id", "id").alias("class_id")), "jaccard-members")
    drop_stored(points)
    node = classes.select(F.col("class_id").alias("id"), F.explode("keys").alias("node"))
    shared = stored(node.groupBy("node").agg(F.min("id").alias("leaf"), F.max("id").alias("last")).where("leaf < last").select("node", "leaf"), "jaccard-nodes")
    leaf = stored(node.join(shared, "node").select("leaf", "id").distinct(), "jaccard-leaves")
    drop_stored(shared)
    large = stored(leaf.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("leaf"), "jaccard-large")
    early = []
    rows = leaf
    if want != "forest":
        # a document has no more leaves than nodes, so its list takes no more room than its text
        smaller = Window.partitionBy("id").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
        rows, early = leaf.withColumn("early", F.collect_list("leaf").over(smaller)), ["early"]
    one = F.lit(0).cast("long")

    def verified(dealt: DataFrame) -> DataFrame:
        # texts go to their leaves: they take less room than sets of hashes; the leaf rows
        # grow with the corpus: a merge join, at any size
        dealt = dealt.select("leaf", "id", "block", *early, "i", "j")
        return docs.join(dealt.hint("merge"), "id").groupBy("leaf", "i", "j").applyInArrow(_leaf(n_words, percent, want), "a long, b long, n long")

    if large.isEmpty():
        found = stored(verified(rows.withColumns({"block": one, "i": one, "j": one})), "jaccard-links")
        drop_stored(classes, leaf, large)
        return members, found
    small = rows.join(large, "leaf", "left_anti").withColumns({"block": one, "i": one, "j": one})
    packed = stored(_packed(rows.join(large, "leaf"), classes), "jaccard-packed")
    boxes = _boxes(packed)
    if want != "forest":
        pairs = _block_pairs(boxes, boxes, percent).where("i <= j")
        found = stored(verified(small.unionByName(_dealt(packed, pairs).select(*small.columns))), "jaccard-links")
    else:
        # with the hub, the leaf's smallest document: block -1 of each block's pair
        blocks = packed.select("leaf", "block").distinct()
        hub = blocks.select("leaf", F.col("leaf").alias("id"), F.lit(-1).cast("long").alias("block"), F.col("block").alias("i"), F.lit(-1).cast("long").alias("j"))
        own = packed.where("id <> leaf").select("leaf", "id", "block", F.col("block").alias("i"), F.lit(-1).cast("long").alias("j"))
        first = stored(verified(small.select(*hub.columns).unionByName(own).unionByName(hub)), "jaccard-links")
        # then what these links, of all leaves, leave in another component, with all others
        labels = connected_components(first.select("a", "b"))
        at = packed.join(labels, "id", "left").withColumn("own", F.coalesce("component", "id")).drop("component")
        hubs = labels.select(F.col("id").alias("leaf"), F.col("component").alias("of_hub"))
        rest = at.join(hubs, "leaf", "left").where(F.col("own") != F.coalesce("of_hub", "leaf")).select("leaf", "id")
        rest = stored(_packed(rest, classes).withColumn("block", -2 - F.col("block")), "jaccard-rest")
        others = packed.join(rest.select("leaf", "id"), ["leaf", "id"], "left_anti")  # in one component
        of_rest = _boxes(rest)
        pairs = _block_pairs(of_rest, of_rest, percent).where("i >= j").unionByName(_block_pairs(of_rest, _boxes(others), percent))
        both = rest.unionByName(others.select(*rest.columns))
        second = stored(verified(_dealt(both, pairs)), "jaccard-links")
        found = first.unionByName(second)
        drop_stored(rest)
    drop_stored(classes, leaf, large, packed)
    return members, found


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has a row a document: id, n (shingles), class_id (the
    smallest id with the same set); links (a, b), a < b, has every pair of linked
    classes once. k texts that are all near each other have k * (k - 1) / 2 links;
    jaccard_components counts them without a row for each.

    Words are split at white space and A-Z lower-cased; a text of fewer words than a
    shingle is one shingle. Two sets are linked when 100 * overlap >= percent *
    union. Texts without words (null, empty, blank) have n 0 and no links, and
    each is its own class; a null id takes part as a member of its class only.
    """
    members, found = _meet(df, id_col, text_col, n_words, percent, "pairs")
    return members, found.select("a", "b")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """A row a document: id_col, n_shingles, class_id, n_links (other classes that its
    class is linked with) and component_id (the smallest id reachable by links,
    itself included); see jaccard_classes. Without count_links there is no n_links,
    and pairs in one component already are not verified."""
    members, found = _meet(df, id_col, text_col, n_words, percent, "counts" if count_links else "forest")
    labels = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "_class")
    out, n_links = members.join(labels, members["class_id"] == labels["_class"], "left"), []
    if count_links:
        counts = found.where("b is null").groupBy(F.col("a").alias("_linked")).agg(F.sum("n").alias("_n_links"))
        out, n_links = out.join(counts, out["class_id"] == counts["_linked"], "left"), [F.coalesce("_n_links", F.lit(0)).alias("n_links")]
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", *n_links, F.coalesce("component", "class_id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df with the smallest id of each component; rows with a null id and
    texts without words stay, as do repeated rows of an id that stays. Columns of any
    name pass through; an empty table gives an empty one."""
    gone = jaccard_components(df, id_col, text_col, n_words, percent, count_links=False).where(F.col(quoted(id_col)) != F.col("component_id"))
    gone_id = free_name(df, "_gone")
    gone = gone.select(F.col(quoted(id_col)).alias(gone_id)).distinct()
    return df.join(gone, F.col(quoted(id_col)) == F.col(gone_id), "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shingles, links and component of every document, whole texts, three words and a
    similarity of 0.9. Nulls, short texts, ties, repeated rows and empty tables as in
    jaccard_classes(); other columns are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, n_words=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links")

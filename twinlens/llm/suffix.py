"""Removal of byte strings repeated anywhere in the corpus, by sparse suffix arrays.

Every string of `match` bytes is owned by the leftmost seed (a short string in it)
of least hash, which its own bytes decide; so equal strings have equal owners,
and the consecutive strings of one owner form a segment. A batch's suffix array holds one
entry a segment, sorted by owner and by a fingerprint of the segment's bytes instead of
by the bytes, which brings equal beginnings together at a tenth of the volume.

Batches come in order of their documents, and grow with the corpus. The array of a batch
is merge-scanned with those of the existing levels, where every earlier document is: an
entry that is not the first of its run, or that a level has, is repeated whole. The
others form a new array, stored as sorted buckets, so that no later batch shuffles or
sorts it again; equal-sized arrays merge geometrically. At the end, owners of several
different segments (text around a repeat differs) have their strings compared, an owner's
together in one bucket or, where an owner has more than HOT segments, each string
where its hash sends it. Hot entries are collapsed inside each chunk of text
before any shuffle, so a passage in every document sends one entry a chunk.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ._common import _CHUNK, _UNBASE, byte_chunks, drop_stored, free_name, mix, powers, prefix_hash, quoted, run_buckets, sorted_run, span_hash, stored

MATCH, SEED = 100, 32
#: Batches of a corpus. Each reads the levels once, so their number stays and their size grows.
BATCHES = 8
#: Segments whose strings one bucket compares, and of one owner at most.
BUCKET, HOT = 20_000, 10_000
_ENTRY = pa.schema([("owner", pa.int64()), ("print", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("again", pa.bool_())])
_ENTRY_DDL = "owner long, print long, doc long, start int, n int, again boolean"


def _starts(off: np.ndarray, match: int) -> np.ndarray:
    """The places in a chunk where `match` bytes of one text start."""
    size = np.maximum(off[1:] - off[:-1] - match + 1, 0)
    first = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(off[:-1] - first, size)


def segments(off: np.ndarray, data: np.ndarray, match: int = MATCH, seed: int = SEED):
    """(owner, fingerprint, start, strings) of the segments in a chunk."""
    c, n, width = prefix_hash(data), len(data) - seed + 1, match - seed + 1
    hashes = mix((c[seed:] - c[:n]) * powers(int(_UNBASE), n))
    least, length = hashes, 1
    while 2 * length <= width:
        least, length = np.minimum(least[:-length], least[length:]), 2 * length
    if rest := width - length:
        least = np.minimum(least[:-rest], least[rest:])
    at = _starts(off, match)
    owner = least[at]
    # a segment ends where its leftmost least seed is left behind or undercut
    left = hashes[at[:-1]] == owner[:-1]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1) | left])
    count = np.diff(np.r_[new, len(at)])
    start = at[new]
    return owner[new], span_hash(c, start, start + count + match - 1), start, count


def _later(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows have an earlier (doc, start) with equal keys."""
    order = np.lexsort((start, doc, *keys))
    d, s, ks = doc[order], start[order], [k[order] for k in keys]
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in ks], axis=0)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    out = np.empty(len(doc), bool)
    out[order] = (d != d[head]) | (s != s[head])
    return out


def _rows(owner, print_, doc, start, n, again) -> pa.RecordBatch:
    # what is known to be repeated needs no company: its keys spread it evenly
    spread = mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64))
    owner, print_ = np.where(again, spread, owner), np.where(again, ~spread, print_)
    return pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), pa.array(print_.view(np.int64)), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)], schema=_ENTRY)


def _entries(match: int):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, off, data in byte_chunks(b.column(1), _CHUNK):
                if (off[1:] - off[:-1]).max() < match:
                    continue
                # a long text goes in pieces that share match - 1 bytes, so none of its strings is cut
                long = len(off) == 2 and len(data) > 2 * _CHUNK
                for a in range(0, len(data) - match + 1, _CHUNK) if long else (0,):
                    piece, ends = (data[a : a + _CHUNK + match - 1], np.array([0, min(_CHUNK + match - 1, len(data) - a)])) if long else (data, off)
                    owner, fp, start, n = segments(ends, piece, match, min(SEED, match))
                    row = np.searchsorted(ends, start, "right") - 1
                    doc, start = ids[at + row], start - ends[row] + a
                    yield _rows(owner, fp, doc, start, n, _later([fp, owner], doc, start))

    return run


class SuffixFamily:
    """Levels of sparse suffix arrays: sorted runs (owner, print, doc, start, n), all of
    whose segments differ. Two runs of a level are merged into one of the next, so a
    level's runs are twice as large as those of the level before."""

    def __init__(self):
        self.levels: list[list[DataFrame]] = []
        self.merges = 0

    def arrays(self) -> list[DataFrame]:
        return [x for level in self.levels for x in level]

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Both runs as one: a merge of their sorted buckets, without a shuffle. No segment
        is in both."""
        self.merges += 1
        rest = ("doc", "start", "n")
        b = b.select("owner", "print", *[F.col(c).alias(f"{c}_b") for c in rest])
        rows = a.join(b.hint("merge"), ["owner", "print"], "full")
        return sorted_run(rows.select("owner", "print", *[F.coalesce(c, f"{c}_b").alias(c) for c in rest]), "suffix-level", "owner", ["owner", "print"])

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == 2:
            two, self.levels[level] = self.levels[level], []
            self._push(self._merged(*two), level + 1)
            drop_stored(*two)

    def add(self, entries: DataFrame) -> DataFrame:
        """Adds a batch whose documents all come after those before; returns its
        repeated segments (doc, start, n), stored.

        The batch is sorted once and merge-scanned with the runs there are, which lie
        sorted in the same buckets; its first entries that no run has are its array."""
        scan = Window.partitionBy("owner", "print").orderBy("doc", "start")
        batch = entries.repartition(run_buckets(entries.sparkSession), "owner").withColumns({"rank": F.rank().over(scan), "row": F.row_number().over(scan)})
        repeated = F.col("again") | (F.col("rank") > 1)
        for i, x in enumerate(self.arrays()):  # a segment is once in a run, so no row is multiplied
            batch = batch.join(x.select("owner", "print", F.lit(True).alias(f"in_{i}")).hint("merge"), ["owner", "print"], "left")
            repeated = repeated | F.col(f"in_{i}").isNotNull()
        batch = batch.withColumn("repeated", repeated).where("repeated or row = 1").select(*_ENTRY.names[:5], "repeated")
        seen = sorted_run(batch, "suffix-batch", "owner", ["owner", "print"], "repeated")
        fresh = seen.where("not repeated").select(*_ENTRY.names[:5])
        fresh.stored_at = f"{seen.stored_at}/repeated=false"
        self._push(fresh, 0)
        again = seen.where("repeated").select("doc", "start", "n")
        again.stored_at, again.stored_as = seen.stored_at, seen.stored_as
        return again

    def split_owners(self) -> DataFrame:
        """The segments (owner, doc, start, n, hot) of owners that have several, stored;
        hot: more than HOT. Merges what levels are left and drops the runs."""
        index, *rest = self.arrays()
        for x in rest:
            index, before = self._merged(index, x), index
            drop_stored(before, x)
        self.levels = []
        several = index.groupBy("owner").agg(F.min("print").alias("a"), F.max("print").alias("b"), (F.count("*") > HOT).alias("hot")).where("a <> b")
        out = stored(index.join(several.hint("merge"), "owner").select("owner", "doc", "start", "n", "hot"), "suffix-unsure")
        drop_stored(index)
        return out


def _cut_out(b: pa.RecordBatch, match: int):
    """The listed segments of a batch of texts as (document, start, strings, owner, ends,
    bytes on end), about a chunk of bytes at a time."""
    ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
    start, n, owner = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    first = np.concatenate(([0], np.cumsum(sizes)))
    for at, off, data in byte_chunks(b.column(1)):
        part = np.arange(first[at], first[at + len(off) - 1])
        row = np.repeat(np.arange(len(off) - 1), sizes[at : at + len(off) - 1])
        reach = np.cumsum(n[part] + match - 1)
        for to in np.split(np.arange(len(part)), np.flatnonzero(np.diff(reach // _CHUNK)) + 1):
            if len(to):
                i, r = part[to], row[to]
                item, k = _spread(n[i] + match - 1)
                ends = np.concatenate(([0], np.cumsum(n[i] + match - 1)))
                yield ids[at + r], start[i], n[i], owner[i], ends, data[(off[r] + start[i])[item] + k]


def _spread(n: np.ndarray):
    """(item, 0, 1, ... n - 1 of it) for items of n strings each."""
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _windows(match: int):
    """One row a string of the listed segments; its hash is the owner."""

    def run(batches):
        for b in batches:
            for doc, start, n, _, ends, data in _cut_out(b, match):
                item, k = _spread(n)
                h = span_hash(prefix_hash(data), ends[item] + k, ends[item] + k + match)
                doc, place = doc[item], start[item] + k
                yield _rows(h, h, doc, place, np.ones(len(h)), _later([h], doc, place))

    return run


_PIECE = pa.schema([("owner", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())])


def _pieces(match: int):
    """The listed segments with their bytes."""

    def run(batches):
        for b in batches:
            for doc, start, n, owner, ends, data in _cut_out(b, match):
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), raw], schema=_PIECE)

    return run


def _compare(match: int):
    """Repeated strings, as runs, among segments whose owners are all here."""

    def run(t: pa.Table) -> pa.Table:
        owner, doc, start, n = (t[c].to_numpy().astype(np.int64) for c in ("owner", "doc", "start", "n"))
        order = np.lexsort((start, doc, owner))
        owner, doc, start, n = owner[order], doc[order], start[order], n[order]
        found = []
        for _, off, data in [next(byte_chunks(t["bytes"].combine_chunks().take(pa.array(order)), 1 << 62))]:
            item, k = _spread(n)
            h = span_hash(prefix_hash(data), off[item] + k, off[item] + k + match)
            # items are in order of owner and place, and a stable sort keeps equal strings so;
            # equal strings have equal owners, so hashes that collide are told apart by these
            by = np.argsort(h, kind="stable")
            x, s = h[by], item[by]
            new = np.r_[True, (x[1:] != x[:-1]) | (owner[s[1:]] != owner[s[:-1]])]
            head = s[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            again = np.zeros(len(h), bool)
            again[by] = (head != s) & ((doc[head] != doc[s]) | (start[head] != start[s]))
            at = np.flatnonzero(again)
            if len(at):
                cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (item[at[1:]] != item[at[:-1]])])
                i = at[cut]
                found = [doc[item[i]], start[item[i]] + k[i], np.diff(np.r_[cut, len(at)])]
        d, a, m = found or [np.zeros(0, np.int64)] * 3
        return pa.table({"doc": d, "start": a.astype(np.int32), "n": m.astype(np.int32)})

    return run


def _batches(df: DataFrame, n: int) -> list[DataFrame]:
    cuts = sorted(set(df.agg(F.percentile_approx("doc", [i / n for i in range(1, n)])).first()[0] or [])) if n > 1 else []
    if not cuts:
        return [df]
    doc = F.col("doc")
    return [df.where(w) for w in [doc <= cuts[0], *[(doc > a) & (doc <= b) for a, b in zip(cuts, cuts[1:])], doc > cuts[-1]]]


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, n_batches: int = BATCHES) -> DataFrame:
    """id_col and spans (start, end) of the UTF-8 bytes covered by a string of `match`
    bytes that starts earlier too: in a smaller id, or in the same text before.

    Documents without such bytes have no row. Strings never cross documents and
    are judged on the input. Ids are unique but for repeated rows, which are one
    document; rows with a null id or text have no spans and are no source. An empty
    table gives an empty one; other columns are ignored.
    """
    docs = df.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.col(quoted(text_col)).alias("text")).where("doc is not null and text is not null")
    family, whole = SuffixFamily(), []
    for batch in _batches(docs, n_batches):
        whole.append(family.add(batch.mapInArrow(_entries(match), _ENTRY_DDL)))
    unsure = family.split_owners()

    def texts(segments: DataFrame) -> DataFrame:
        listed = segments.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "owner")).alias("segments"))
        return docs.join(listed.hint("merge"), "doc").select("doc", "text", "segments")

    # owners' segments meet in buckets; those of hot owners string by string
    n_buckets = max(48, -(-unsure.where("not hot").count() // BUCKET))
    pieces = texts(unsure.where("not hot")).mapInArrow(_pieces(match), "owner long, doc long, start int, n int, bytes binary")
    again = [pieces.groupBy(F.pmod(F.xxhash64("owner"), F.lit(n_buckets)).alias("bucket")).applyInArrow(_compare(match), "doc long, start int, n int")]
    if not unsure.where("hot").isEmpty():
        strings = texts(unsure.where("hot")).mapInArrow(_windows(match), _ENTRY_DDL)
        scan = Window.partitionBy("owner").orderBy("doc", "start")
        again.append(strings.withColumn("again", F.col("again") | (F.rank().over(scan) > 1)).where("again").select("doc", "start", "n"))
    found = reduce(DataFrame.unionByName, [*whole, *again])
    covered = F.collect_list(F.struct(F.col("start"), (F.col("start") + F.col("n") + (match - 1)).alias("end")))
    spans = found.groupBy("doc").agg(covered.alias("covered")).mapInArrow(_union, "doc long, spans array<struct<start:int,end:int>>")
    out = stored(spans, "suffix-spans")
    drop_stored(unsure, *whole)
    return out.withColumnRenamed("doc", id_col)


def _union(batches):
    """Overlapping or touching intervals as maximal ones, in order."""
    for b in batches:
        lists = b.column("covered")
        sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
        start, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        row = np.repeat(np.arange(len(lists)), sizes)
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        # rows lie apart on one line, so one running maximum serves all
        far = (end.max() + 2) if len(end) else 1
        reach = np.maximum.accumulate(row * far + end)
        new = np.r_[True, (row * far + start)[1:] > reach[:-1]] if len(row) else np.zeros(0, bool)
        last = np.r_[new[1:], True] if len(row) else new
        spans = pa.StructArray.from_arrays([pa.array(start[new].astype(np.int32)), pa.array((reach - row * far)[last].astype(np.int32))], names=["start", "end"])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(lists))))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["doc", "spans"])


def _cut(batches):
    for b in batches:
        kept = []
        for text, spans in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            text, at, parts = text or b"", 0, []
            for s in spans or ():
                parts.append(text[at : s["start"]])
                at = s["end"]
            parts.append(text[at:])
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 2)), pa.array(kept, pa.binary())], names=[*b.schema.names[:-2], "_kept"])


def remove_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without text_col, with _kept: the bytes outside the spans (binary, as a cut
    may fall inside a character), and _spans (null where nothing goes). Null texts are
    empty; a null id has no spans; repeated rows are cut alike. Other columns pass
    through, whatever their names, but for own columns _kept and _spans, which are
    replaced."""
    rest = [c for c in df.columns if c not in (text_col, "_kept", "_spans")]
    id_, found = free_name(df, "_id"), free_name(df, "_found")
    marked = df.join(spans.select(F.col(quoted(id_col)).alias(id_), F.col("spans").alias(found)), F.col(quoted(id_col)) == F.col(id_), "left")
    text, cuts = free_name(df, "_text"), free_name(df, "_cuts")
    marked = marked.select(*map(quoted, rest), F.col(found).alias("_spans"), F.col(quoted(text_col)).cast("binary").alias(text), F.col(found).alias(cuts))
    return marked.mapInArrow(_cut, StructType([*marked.schema.fields[:-2], StructField("_kept", BinaryType())]))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document and the digest of what stays, whole texts as
    UTF-8 bytes. Null and empty texts lose nothing; ties cannot be (ids order the
    documents); repeated rows are one document; an empty table gives no rows; other
    columns are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_bytes = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    cut = remove_spans(n_bytes, repeated_spans(docs))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("_kept")).alias("n_removed"), F.coalesce(F.size("_spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))

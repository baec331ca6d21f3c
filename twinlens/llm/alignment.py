"""Which tokens of two tokenizers stand for the same bytes, and how often.

Texts are cut into units that neither tokenizer's tokens cross: before a space after
anything but white space. A worker encodes each distinct unit once, by both, and keeps
its tokens' links; documents are sums over their units.

Counts of id pairs are dense: ids of one side are dealt in stripes (id modulo the
number of stripes), and a task adds the pairs of a stripe up in a block of one row an
id, of which row maxima give the best partners. Chunks of documents send each distinct
pair once, with the number of its documents, and get count and verdict back the same
way; then a chunk's answers meet its stored links in one task.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import byte_chunks, drop_stored, hash_spans, quoted, stored
from .pieces import default_model

#: Bytes of text handled at once; units that a worker remembers before it starts anew.
CHUNK, REMEMBERED = 1 << 22, 1 << 19
#: A stripe's ids times the other side's ids is the size of a block.
STRIPES = 256
#: Chunks whose pairs of a stripe are counted by one task before sums are taken.
SALTED = 512

DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def default_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1
    characters stand for themselves, other bytes for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


@dataclass
class Tokenizers:
    """Two tokenizers by the contents of their files; loaded once a worker."""

    bpe: str
    model: bytes
    _loaded: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"bpe": self.bpe, "model": self.model, "_loaded": None}

    def load(self):
        if self._loaded is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import sentencepiece
            from tokenizers import Tokenizer

            a, b = Tokenizer.from_str(self.bpe), sentencepiece.SentencePieceProcessor(model_proto=self.model)
            a.encode_special_tokens = True
            letters = _byte_letters()
            size_a = {i: bytes(letters[c] for c in t) for t, i in json.loads(self.bpe)["model"]["vocab"].items()}
            pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
            size_b = {i: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces) if not (b.is_control(i) or b.is_unknown(i))}
            self._loaded = (a, b, size_a, size_b)
        return self._loaded

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; units begin with a space, which the second adds itself."""
        a, b, _, _ = self.load()
        return [e.ids for e in a.encode_batch(units, add_special_tokens=False)], b.encode([u[1:] for u in units], num_threads=1)


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of units in texts that each begin with a space of their own: before a space
    after what is surely no white space, but for a text's last space, which would be a unit
    without anything else. Beyond ASCII, blocks with white space count as such."""
    space = data == 32
    before = np.concatenate(([32], data[:-1]))
    solid = (before > 32) & (before < 127)
    if (data >= 128).any():
        two = np.concatenate(([32, 32], data[:-2]))[: len(data)]
        three = np.concatenate(([32, 32, 32], data[:-3]))[: len(data)]
        blank = (two == 0xC2) & ((before == 0x85) | (before == 0xA0))
        blank |= ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80)) | ((three == 0xE1) & ((two == 0x9A) | (two == 0xA0)))
        solid |= (before >= 128) & ~blank
    new = space & solid
    new[offsets[1:][offsets[1:] > 0] - 1] = False
    new[offsets[:-1]] = True
    return np.flatnonzero(new)


class Units:
    """What a worker knows of units: numbers of tokens, groups and links, linked pairs."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.key, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sums, self.good = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.text = np.zeros(0, np.int64), []

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each unit; new ones are encoded."""
        if len(self.key) > REMEMBERED:
            self.forget()
        h, where, inverse = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.key, h), max(len(self.key) - 1, 0))
        new = np.flatnonzero(self.key[at] != h) if len(self.key) else np.arange(len(h))
        if len(new):
            raw = data.tobytes()
            self._learn([raw[start[i] : end[i]] for i in where[new]])
            put = np.searchsorted(self.key, h[new])
            self.place = np.insert(self.place, put, len(self.key) + np.arange(len(new)))
            self.key = np.insert(self.key, put, h[new])
        return self.place[np.searchsorted(self.key, h)][inverse]

    def _learn(self, units: list[bytes]) -> None:
        _, _, bytes_a, bytes_b = self.tokenizers.load()
        sums, good, size, pairs = [], [], [], []
        for unit, a, b in zip(units, *self.tokenizers.encode([u.decode() for u in units])):
            said_a, said_b = [bytes_a.get(i, b"") for i in a], [bytes_b.get(i, b"") for i in b]
            if b"".join(said_a) != unit or b"".join(said_b) != unit:
                sums.append((0, 0, 0, 0)), good.append(False), size.append(0), self.text.append(b"")
                continue
            groups, left, right, found, i, j, end_a, end_b = [], [], [], [], 0, 0, len(said_a[0]), len(said_b[0])
            while True:
                found.append(a[i] << 32 | b[j])
                if end_a == end_b:
                    groups.append(f"{','.join(map(str, [*left, a[i]]))}|{','.join(map(str, [*right, b[j]]))}")
                    left, right, i, j = [], [], i + 1, j + 1
                    if i == len(a):
                        break
                    end_a, end_b = end_a + len(said_a[i]), end_b + len(said_b[j])
                elif end_a < end_b:
                    left.append(a[i])
                    i += 1
                    end_a += len(said_a[i])
                else:
                    right.append(b[j])
                    j += 1
                    end_b += len(said_b[j])
            sums.append((len(a), len(b), len(groups), len(found))), good.append(True), size.append(len(found))
            pairs += found
            self.text.append(";".join(groups).encode())
        size = np.array(size, np.int64)
        self.first = np.r_[self.first, len(self.pairs) + np.cumsum(size) - size]
        self.size, self.pairs = np.r_[self.size, size], np.r_[self.pairs, np.array(pairs, np.int64)]
        self.sums, self.good = np.r_[self.sums, np.array(sums, np.int64)], np.r_[self.good, good]

    def links(self, doc: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, occurrences), each pair of a document once."""
        both, times = np.unique(doc * np.int64(len(self.size)) + unit, return_counts=True)
        doc, unit = np.divmod(both, len(self.size))
        n = self.size[unit]
        take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[unit], n)
        return _added(np.repeat(doc, n), self.pairs[take], np.repeat(times, n))


def _added(doc, pair, times):
    by = np.lexsort((pair, doc))
    doc, pair, times = doc[by], pair[by], times[by]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])))[: len(doc)])
    return doc[new], pair[new], np.add.reduceat(times, new) if len(new) else times


def _spaced(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space put in front of each."""
    at = off[:-1]
    return off + np.arange(len(off)), np.insert(data, at, 32)


def _pieces(off: np.ndarray, data: np.ndarray, limit: int):
    """A text, in pieces of about `limit` bytes that begin where units do."""
    if len(data) <= 2 * limit:
        yield data
        return
    at = 0
    while at < len(data):
        to, step = len(data), limit
        while at + step < len(data):
            start = cut(data[at : at + 2 * step], np.array([0, 0]))
            start = start[start >= step]
            if len(start):
                to = at + int(start[0])
                break
            step *= 2
        yield data[at:to]
        at = to


def _counted(off: np.ndarray, data: np.ndarray, units: Units):
    """(sums, digests of groups, document, pair, occurrences) of the texts of a chunk."""
    n_docs = len(off) - 1
    off, data = _spaced(off, data)
    if n_docs == 1:  # perhaps long: memory does not follow its length
        sums, good, digest, links, some = np.zeros((1, 4), np.int64), True, hashlib.sha256(), (np.zeros(0, np.int64),) * 3, False
        for piece in _pieces(off, data, CHUNK) if len(data) > 1 else ():
            start = cut(piece, np.array([0, len(piece)]))
            unit = units.find(piece, start, np.r_[start[1:], len(piece)])
            good &= bool(units.good[unit].all())
            if not good:
                break
            sums[0] += units.sums[unit].sum(0)
            digest.update(b";" * some + b";".join([units.text[u] for u in unit]))
            links, some = _added(*map(np.concatenate, zip(links, units.links(np.zeros(len(unit), np.int64), unit)))), True
        if not (good and some):
            return np.zeros((1, 4), np.int64), [""], *(np.zeros(0, np.int64),) * 3
        return sums, [digest.hexdigest()], *links
    start = cut(data, off)
    end, doc = np.r_[start[1:], len(data)], np.searchsorted(off, start, "right") - 1
    keep = (np.diff(off) > 1)[doc]
    start, end, doc = start[keep], end[keep], doc[keep]
    unit = units.find(data, start, end)
    good = np.bincount(doc, minlength=n_docs) > 0
    good[doc[~units.good[unit]]] = False
    keep = good[doc]
    doc, unit = doc[keep], unit[keep]
    sums = np.zeros((n_docs, 4), np.int64)
    np.add.at(sums, doc, units.sums[unit])
    ends = np.searchsorted(doc, np.arange(n_docs + 1))
    said = [units.text[u] for u in unit]
    digests = [hashlib.sha256(b";".join(said[x:y])).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]
    return sums, digests, *units.links(doc, unit)


_packer = pa.Codec("zstd", 1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of the smallest widths, compressed."""
    out = []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max(initial=0)))
        out.append(np.array([len(x), kind.itemsize], "<i8").tobytes() + x.astype(kind).tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + _packer.compress(raw, asbytes=True)


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw, out, at = _packer.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), [], 0
    while at < len(raw):
        n, size = np.frombuffer(raw, "<i8", 2, at)
        out.append(np.frombuffer(raw, f"<u{size}", n, at + 16).astype(np.int64))
        at += 16 + int(n * size)
    return out


def _linked(batches, units: Units):
    """A row a chunk: its documents, its links and its pairs with their documents."""
    task, k = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    for b in batches:
        for at, off, data in byte_chunks(b.column(1), CHUNK):
            sums, digests, doc, pair, times = _counted(off, data, units)
            pairs, which, docs = np.unique(pair, return_inverse=True, return_counts=True)
            head = pa.RecordBatch.from_arrays([b.column(0).slice(at, len(off) - 1), *map(pa.array, sums.T), pa.array(digests, pa.string())], names=["doc_id", *_SUMS, "sha"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(head)
            per_doc = np.bincount(doc, minlength=len(off) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | k]), pa.array([sink.getvalue().to_pybytes()]), pa.array([_pack(per_doc, which.ravel(), times)]), pa.array([_pack(pairs, docs)])], names=["chunk", "head", "links", "pairs"]
            )
            k += 1


def _asked(batches, stripes: int, salts: int):
    """A row for each chunk and stripe: its pairs and their numbers of documents."""
    for b in batches:
        for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            pairs, docs = _unpack(raw)
            stripe = (pairs >> 32) % stripes
            by = np.argsort(stripe, kind="stable")
            which, first = np.unique(stripe[by], return_index=True)
            parts = np.split(by, first[1:])
            salt = (chunk ^ chunk >> 32) % salts
            if len(which):
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array([salt] * len(which), pa.int32()), pa.array([chunk] * len(which), pa.int64()), pa.array([_pack(pairs[p], docs[p]) for p in parts])], names=["stripe", "salt", "chunk", "pairs"])


class StripeBlock:
    """Counts of the pairs of a stripe's ids: a dense row for each id."""

    def __init__(self, stripes: int, ids: tuple[int, int]):
        self.stripes, self.width = stripes, ids[1]
        self.block, self.touched = np.zeros((-(-ids[0] // stripes), ids[1]), np.int64), []

    def add(self, pairs: np.ndarray, n: np.ndarray) -> None:
        np.add.at(self.block, self._at(pairs), n)
        self.touched.append(np.unique(pairs >> 32))

    def _at(self, pairs: np.ndarray):
        return (pairs >> 32) // self.stripes, pairs & 0xFFFFFFFF

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, counts, whether no pair of the first id counts more), sorted."""
        ids = np.unique(np.concatenate(self.touched)) if self.touched else np.zeros(0, np.int64)
        rows = self.block[ids // self.stripes]
        best = rows.max(1, initial=0)
        i, j = np.nonzero(rows)
        return ids[i] << 32 | j, rows[i, j], (rows[i, j] == best[i]).astype(np.int64)

    def clear(self) -> None:
        for ids in self.touched:
            self.block[ids // self.stripes] = 0
        self.touched = []


def _summed(batches, stripes: int, ids: tuple[int, int]):
    """Rows (stripe, pairs) in order of stripes; a row a stripe and task."""
    block, now = StripeBlock(stripes, ids), None

    def done():
        out = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_pack(*block.counted())])], names=["stripe", "pairs"])
        block.clear()
        return out

    for b in batches:
        for stripe, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if stripe != now and now is not None:
                yield done()
            now = stripe
            block.add(*_unpack(raw)[:2])
    if now is not None:
        yield done()


def _answered(batches):
    """Rows (stripe, salt, chunk, pairs): a stripe's counts (chunk null) come before its
    questions; a row (chunk, pairs, counts, best) a question."""
    known = None
    for b in batches:
        chunks, answers = [], []
        for chunk, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            if chunk is None:
                known = _unpack(raw)
                continue
            pairs = _unpack(raw)[0]
            at = np.searchsorted(known[0], pairs)
            chunks.append(chunk), answers.append(_pack(pairs, known[1][at], known[2][at]))
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(answers)], names=["chunk", "answer"])


def _scored(batches):
    """Rows (chunk, answer, head, links): a chunk's answers come before its documents."""
    now, answers = None, []
    for b in batches:
        for chunk, answer, head, links in zip(*(b.column(k).to_pylist() for k in range(4))):
            if chunk != now:
                now, answers = chunk, []
            if answer is not None:
                answers.append(_unpack(answer))
                continue
            per_doc, which, times = _unpack(links)
            docs = pa.ipc.open_stream(head).read_next_batch()
            sums = np.zeros((2, docs.num_rows + 1), np.int64)
            if len(which):
                pairs, counts, best = map(np.concatenate, zip(*answers))
                by = np.argsort(pairs)
                doc = np.repeat(np.arange(docs.num_rows), per_doc)
                np.add.at(sums[0], doc, times * best[by][which])
                np.add.at(sums[1], doc, times * counts[by][which])
            yield pa.RecordBatch.from_arrays([*docs.columns[:5], *(pa.array(x[:-1]) for x in sums), docs.columns[5]], names=[x.split()[0] for x in DIGEST.split(", ")])


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bpe_path: str | None = None, model_path: str | None = None, stripes: int = STRIPES) -> DataFrame:
    """Per document: tokens of both tokenizers (a byte-level BPE over a space and the text,
    and a SentencePiece model, which adds the space), groups between common ends, links
    (pairs of tokens that share bytes), links to the partner that the most documents
    have with the first id (ties count), the sum of the links' numbers of documents, and a
    digest of the groups.

    Null and empty texts, and texts that either tokenizer's bytes do not give back, have
    zeros and an empty digest, and their pairs count nowhere. Each row is a document of its
    own, repeated ones and those with a null id too; other columns are not read; an empty
    table gives an empty one. Units are told apart by 64-bit hashes.
    """
    spark = df.sparkSession
    with open(bpe_path or default_bpe(), encoding="utf-8") as f:
        bpe = f.read()
    with open(model_path or default_model(), "rb") as f:
        tokenizers = Tokenizers(bpe, f.read())
    _, b, bytes_a, _ = tokenizers.load()
    ids = (max(bytes_a) + 1, b.get_piece_size())
    sent = spark.sparkContext.broadcast(tokenizers)
    texts = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    chunks = stored(texts.mapInArrow(lambda batches: _linked(batches, Units(sent.value)), "chunk long, head binary, links binary, pairs binary"), "aligned-chunks")
    salts = max(1, -(-chunks.count() // SALTED))

    asked = chunks.select("chunk", "pairs").mapInArrow(lambda batches: _asked(batches, stripes, salts), "stripe int, salt int, chunk long, pairs binary")
    asked = stored(asked, "aligned-pairs")
    add = lambda batches: _summed(batches, stripes, ids)
    parts = asked.repartition("stripe", "salt").sortWithinPartitions("stripe").select("stripe", "pairs").mapInArrow(add, "stripe int, pairs binary")
    counts = stored(parts.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(add, "stripe int, pairs binary"), "aligned-counts")

    every = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("chunk"), "pairs")
    answers = every.union(asked).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.asc_nulls_first("chunk"))
    answers = answers.mapInArrow(_answered, "chunk long, answer binary").select("chunk", "answer", F.lit(None).cast("binary").alias("head"), F.lit(None).cast("binary").alias("links"))
    documents = chunks.select("chunk", F.lit(None).cast("binary").alias("answer"), "head", "links")
    out = answers.union(documents).repartition("chunk").sortWithinPartitions("chunk", F.col("links").isNotNull())
    out = stored(out.mapInArrow(_scored, DIGEST), "aligned")
    drop_stored(chunks, asked, counts)
    return out


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """align() of every row and whole text of documents."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))

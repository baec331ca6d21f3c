"""SentencePiece encoding and decoding with a model file's own pieces.

Encoding is a batched Viterbi over the distinct words of a chunk of texts: words of
equal length advance together, one character a step; hashes of the substrings
that end there probe the sorted hashes of the pieces, and an argmax over the
candidates stores each word's backpointer.

What is maximal depends on the model. In a unigram model it is the sum of piece
scores. In a BPE model the merges, not a sum, decide; there the best path to a
place is the one whose last piece fits the piece before it: a sequence of pieces
is what merging gives if and only if each two neighbours are what merging gives
for their concatenation. Neighbours are merged once and remembered, so the same
pass is exact for both kinds.

Words end where no piece can cross: before a run of spaces, and around characters
that no piece has, which become byte pieces.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ._common import _BASE, _UNBASE, byte_chunks, free_name, mix, powers, quoted, span_hash

SPACE = 0x2581
_NORMAL, _BYTE = 1, 6
UNIGRAM, BPE = 1, 2
#: Distinct words that a worker remembers before it starts anew, and slots for pairs.
REMEMBERED, PAIRS = 1 << 19, 1 << 20
PAD = "\U0010ffff"  # in no piece
_SIEVE = 1 << 20
#: Bytes of text encoded at once.
CHUNK = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def _prefixes(cps: np.ndarray) -> np.ndarray:
    """Hash prefixes along the last axis of code points."""
    out = np.zeros((*cps.shape[:-1], cps.shape[-1] + 1), np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * powers(int(_BASE), cps.shape[-1]), axis=-1, out=out[..., 1:])
    return out


def _spans(c: np.ndarray, start, length) -> np.ndarray:
    """Hashes of the spans of each row (or of columns) of hash prefixes."""
    if np.ndim(start) == 0:
        raw = (c[:, start + length] - c[:, start]) * powers(int(_UNBASE), c.shape[1])[start]
        n = np.array([length], np.uint64)
    else:
        r = np.arange(len(c))
        raw = (c[r, start + length] - c[r, start]) * powers(int(_UNBASE), c.shape[1])[start]
        n = length.astype(np.uint64)
    return mix(raw + n * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class PieceModel:
    kind: int
    keys: np.ndarray  # sorted hashes of the normal pieces
    ids: np.ndarray
    scores: np.ndarray
    lengths: np.ndarray  # those that pieces have, longest first
    known: np.ndarray  # sorted code points that pieces have
    byte_ids: np.ndarray
    surface: list[bytes]  # what each id decodes to
    dummy_prefix: bool
    whole: np.ndarray = field(default=None)  # pieces that merging their characters gives
    _pairs: tuple = field(default=None)
    _sieve: np.ndarray = field(default=None)
    _text: list[str] = field(default=None)
    _words: tuple = field(default=None)

    @classmethod
    def load(cls, path: str, kind: int | None = None) -> PieceModel:
        """Reads a model file; kind: UNIGRAM or BPE instead of what the file says."""
        with open(path, "rb") as f:
            return cls.parse(f.read(), kind)

    @classmethod
    def parse(cls, data: bytes, kind: int | None = None) -> PieceModel:
        pieces, trained, prefix = [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                p = {1: b"", 2: b"\0\0\0\0", 3: _NORMAL} | dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0], p[3]))
            elif number == 2:
                trained = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = {3: 1, 4: 1, 5: 1, 2: b""} | dict(_fields(value))
                prefix = bool(norm[3])
                if norm[2] or norm[4] or not norm[5]:
                    raise ValueError("only models without a character map and with all white space kept are supported")
        kind = kind or trained
        byte_ids = [i for i, p in enumerate(pieces) if p[2] == _BYTE]
        if kind not in (UNIGRAM, BPE) or len(byte_ids) != 256 or any(p[2] in (4, 5) for p in pieces):
            raise ValueError("only unigram and BPE models with byte pieces and without user-defined pieces are supported")
        surface = [(b"" if t != _NORMAL else s.replace("▁", " ").encode()) for s, _, t in pieces]
        for b, i in enumerate(byte_ids):
            surface[i] = bytes([b])
        normal = [i for i, p in enumerate(pieces) if p[2] == _NORMAL]
        text = [pieces[i][0] for i in normal]
        singles = {ord(t) for t in text if len(t) == 1}
        if any("▁" in t.lstrip("▁") or not set(map(ord, t)) <= singles for t in text):
            raise ValueError("pieces with inner spaces or with characters that are no pieces are not supported")
        size = np.array([len(t) for t in text])
        cps = np.frombuffer("".join(text).encode("utf-32-le"), "<u4")
        ends = np.cumsum(size)
        h = span_hash(_prefixes(cps), ends - size, ends)
        by = np.argsort(h)
        m = cls(kind, h[by], np.array(normal, np.int32)[by], np.array([pieces[i][1] for i in normal], np.float32)[by], np.unique(size)[::-1], np.array(sorted(singles), np.uint32), np.array(byte_ids, np.int32), surface, prefix)
        if kind == BPE:
            m.whole = np.zeros(len(by), bool)
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            for n in np.unique(size):
                which = np.flatnonzero(size == n)
                grid = np.stack([cps[ends[i] - n : ends[i]] for i in which])
                m.whole[place[which]] = m._merge(grid)[1] == 1
            m._text = [text[i] for i in by]
        m._forget()
        return m

    def _forget(self) -> None:
        self._words = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, or -1."""
        if self._sieve is None:
            self._sieve = np.zeros(_SIEVE, bool)
            self._sieve[self.keys % np.uint64(_SIEVE)] = True
        out = np.full(h.shape, -1)
        likely = np.nonzero(self._sieve[h % np.uint64(_SIEVE)])
        x = h[likely]
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        out[likely] = np.where(self.keys[at] == x, at, -1)
        return out

    def _merge(self, grid: np.ndarray):
        """(ends of symbols, symbols) of rows of code points after all merges, each the
        best-scored of its row, the leftmost of equals."""
        rows, n = grid.shape
        c = _prefixes(grid)
        start, end = np.tile(np.arange(n), (rows, 1)), np.tile(np.arange(1, n + 1), (rows, 1))
        count = np.full(rows, n)
        live = np.arange(rows)

        def value(r, s, e):
            at = self.find(_spans(c[r], s, e - s))
            return np.where(at >= 0, self.scores[at], -np.inf)

        pair = np.full((rows, max(n - 1, 1)), -np.inf)
        for j in range(n - 1):
            pair[:, j] = value(live, start[:, j], end[:, j + 1])
        while len(live):
            j = pair[live].argmax(1)
            go = pair[live, j] > -np.inf
            live, j = live[go], j[go]
            if not len(live):
                break
            end[live, j] = end[live, j + 1]
            for a, gone in ((start, j + 1), (end, j + 1), (pair, j)):
                cols = np.arange(a.shape[1])
                take = np.minimum(cols + (cols >= gone[:, None]), a.shape[1] - 1)
                a[live] = np.take_along_axis(a[live], take, 1)
            count[live] -= 1
            pair[live, np.minimum(count[live] - 1, pair.shape[1] - 1)] = -np.inf
            for at, ok in ((j - 1, j > 0), (j, j < count[live] - 1)):
                r, k = live[ok], at[ok]
                pair[r, k] = value(r, start[r, k], end[r, k + 1])
        return end, count

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging gives the pieces a and b for their concatenation. Answers
        are kept in a table with one slot a hash; a newer pair takes its place."""
        if self._pairs is None:
            self._pairs = (np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool))
        kept, fits = self._pairs
        key = a * len(self.keys) + b
        slot = (mix(key.astype(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
        out, new = fits[slot], kept[slot] != key
        if new.any():
            need, back = np.unique(key[new], return_inverse=True)
            first = [self._text[i] for i in need // len(self.keys)]
            both = [x + self._text[i] for x, i in zip(first, need % len(self.keys))]
            width = max(map(len, both))
            grid = np.frombuffer("".join(x.ljust(width, PAD) for x in both).encode("utf-32-le"), "<u4").reshape(-1, width)
            end, _ = self._merge(grid)
            ok = (end[:, 0] == np.array([len(x) for x in first])) & (end[:, 1] == np.array([len(x) for x in both]))
            out[new] = ok[back]
            at = slot[new]
            kept[at], fits[at] = key[new], ok[back]
        return out

    def segment(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows on end, pieces a row) for rows of known code points."""
        rows, n = grid.shape
        c, unbase = np.ascontiguousarray(_prefixes(grid).T), powers(int(_UNBASE), n + 1)
        back, last = np.zeros((n + 1, rows), np.int64), np.full((n + 1, rows), -1, np.int64)
        best = np.zeros((n + 1, rows))
        for e in range(1, n + 1):
            lengths = self.lengths[self.lengths <= e]  # longest first: the first of equals wins
            spans = (c[e] - c[e - lengths]) * unbase[e - lengths][:, None]
            found = self.find(mix(spans + lengths.astype(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)))
            if self.kind == UNIGRAM:
                value = np.where(found >= 0, best[e - lengths] + self.scores[found], -np.inf)
            else:
                ok = (found >= 0) & self.whole[found]
                before = last[e - lengths]
                ask = np.nonzero(ok & (before >= 0))
                if len(ask[0]):
                    ok[ask] = self._fit(before[ask], found[ask])
                value = np.where(ok, 0.0, -np.inf)
            pick = value.argmax(0)
            r = np.arange(rows)
            best[e], back[e], last[e] = value[pick, r], lengths[pick], found[pick, r]
        at, r, steps = np.full(rows, n), np.arange(rows), []
        while (at > 0).any():
            steps.append(np.where(at > 0, last[at, r], -1))
            at = at - back[at, r] * (at > 0)
        path = np.stack(steps[::-1], 1)  # right-aligned
        return self.ids[path[path >= 0]], (path >= 0).sum(1)

    def encode(self, texts: list[str], starts: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, ids a text); not starts: the texts go on from others."""
        lead = "▁" if self.dummy_prefix and starts else ""
        texts = [lead + t.replace(" ", "▁") if t else "" for t in texts]
        size = np.array([len(t) for t in texts], np.int64)
        cps = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        if not len(cps):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at = np.minimum(np.searchsorted(self.known, cps), len(self.known) - 1)
        odd, space = self.known[at] != cps, cps == SPACE
        new = np.zeros(len(cps), bool)
        new[(np.cumsum(size) - size)[size > 0]] = True
        new[1:] |= odd[1:] | odd[:-1] | (space[1:] & ~space[:-1])
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(cps)]
        h = span_hash(_prefixes(cps), start, end)
        uniq, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        self._learn(uniq, start[where], end[where], cps, odd)
        known, first, count, ids = self._words
        word = np.searchsorted(known, uniq)[inverse]
        n = count[word]
        take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[word], n)
        per_text = np.add.reduceat(np.r_[n, 0], np.minimum(np.searchsorted(start, np.cumsum(size) - size), len(n)))
        return ids[take], np.where(size > 0, per_text, 0)

    def _learn(self, h, start, end, cps, odd) -> None:
        if len(self._words[0]) > REMEMBERED:
            self._forget()
        known, first, count, ids = self._words
        at = np.searchsorted(known, h)
        fresh = np.ones(len(h), bool)
        if len(known):
            fresh = known[np.minimum(at, len(known) - 1)] != h
        h, start, end = h[fresh], start[fresh], end[fresh]
        if not len(h):
            return
        size, strange = end - start, odd[start]
        hs, ns, out = [], [], []
        for n in np.unique(size[~strange]):
            which = np.flatnonzero((size == n) & ~strange)
            for part in np.array_split(which, -(-len(which) * int(n) // (1 << 18))):
                found, many = self.segment(cps[start[part][:, None] + np.arange(n)])
                hs.append(h[part]), ns.append(many), out.append(found)
        for i in np.flatnonzero(strange):
            b = self.byte_ids[list(chr(cps[start[i]]).encode("utf-8", "replace"))]
            hs.append(h[i : i + 1]), ns.append(np.array([len(b)])), out.append(b)
        h, n, out = np.concatenate(hs), np.concatenate(ns), np.concatenate(out)
        starts, by = len(ids) + np.cumsum(n) - n, np.argsort(h)
        at = np.searchsorted(known, h[by])
        self._words = (np.insert(known, at, h[by]), np.insert(first, at, starts[by]), np.insert(count, at, n[by]), np.r_[ids, out].astype(np.int32, copy=False))

    def tables(self):
        size = np.array([len(s) for s in self.surface])
        return np.frombuffer(b"".join(self.surface), np.uint8), np.cumsum(size) - size, size

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text, without the space put in front."""
        data, first, size = self.tables()
        n = size[ids]
        raw = data[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[ids], n)].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(count)))]
        skip = int(self.dummy_prefix)
        return [raw[a + skip * (b > a) : b] for a, b in zip(ends, ends[1:])]


def _parts(raw: bytes, limit: int):
    """A long text in parts of `limit` bytes or some more, cut where words end for good:
    before a space after anything but a space (U+2581 is one too)."""
    at = 0
    while len(raw) - at > 2 * limit:
        cut = raw.find(b" ", at + limit)
        while cut > 0 and (raw[cut - 1] == 32 or raw[cut - 3 : cut] == b"\xe2\x96\x81"):
            cut = raw.find(b" ", cut + 1)
        if cut < 0:
            break
        yield raw[at:cut].decode()
        at = cut
    yield raw[at:].decode()


def _encoded(b: pa.Array, model: PieceModel, limit: int = CHUNK):
    """(first row, texts, ids, ids a text) by chunks of whole texts; a text above two
    chunks is encoded in parts, so memory does not follow its length."""
    for at, off, data in byte_chunks(b, limit):
        raw = data.tobytes()
        if len(off) == 2 and len(raw) > 2 * limit:
            ids = np.concatenate([model.encode([x], starts=not i)[0] for i, x in enumerate(_parts(raw, limit))])
            yield at, [raw.decode()], ids, np.array([len(ids)])
            continue
        texts = [raw[x:y].decode() for x, y in zip(off, off[1:])]
        yield at, texts, *model.encode(texts)


def encode(df: DataFrame, model_path: str | None = None, text_col: str = "text", kind: int | None = None) -> DataFrame:
    """df without text_col, with ids (array of int).

    A null or empty text has no ids. The model file is read on the driver; its
    pieces are broadcast, which the vocabulary bounds. U+2581 in a text is a space,
    as in the file format. Repeated rows and other columns pass through, whatever their
    names, but for an own column ids, which is replaced; an empty table gives an empty one.
    """
    model = df.sparkSession.sparkContext.broadcast(PieceModel.load(model_path or default_model(), kind))
    rest = [c for c in df.columns if c not in (text_col, "ids")]

    def run(batches):
        for b in batches:
            text = b.column(b.num_columns - 1)
            for at, _, ids, n in _encoded(text, model.value):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(n)) for i in range(len(rest))), lists], names=[*b.schema.names[:-1], "ids"])

    own = df.select(*map(quoted, rest))
    rows = df.select(*map(quoted, rest), F.col(quoted(text_col)).alias(free_name(own, "_text")))
    return rows.mapInArrow(run, StructType([*own.schema, StructField("ids", ArrayType(IntegerType()))]))


def decode(df: DataFrame, model_path: str | None = None) -> DataFrame:
    """df with ids replaced by text; byte pieces that are no UTF-8 become U+FFFD. Null or
    empty ids give an empty text; an own column text is replaced, other columns and
    repeated rows pass through; an empty table gives an empty one."""
    model = df.sparkSession.sparkContext.broadcast(PieceModel.load(model_path or default_model()))
    rest = [c for c in df.columns if c not in ("ids", "text")]

    def run(batches):
        for b in batches:
            lists = b.column(b.num_columns - 1).fill_null([])
            n, ids = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            text = [t.decode("utf-8", "replace") for t in model.value.decode(ids, n)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array(text, pa.string())], names=[*b.schema.names[:-1], "text"])

    rows = df.select(*map(quoted, rest), "ids")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("text", StringType())]))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: pieces, a digest of the ids (32-bit,
    little-endian) and whether decoding gives the text back. Null and empty texts have no
    pieces; repeated rows are coded alike; an empty table gives no rows; other columns are
    not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = spark.sparkContext.broadcast(PieceModel.load(default_model()))

    def run(batches):
        for b in batches:
            for at, texts, ids, n in _encoded(b.column(1), model.value):
                ends, raw = np.concatenate(([0], np.cumsum(n))) * 4, ids.astype("<i4").tobytes()
                back = model.value.decode(ids, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(n)), pa.array(n), pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(ends, ends[1:])]), pa.array([t.encode() == x for t, x in zip(texts, back)])],
                    schema=_DIGEST,
                )

    return docs.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean")

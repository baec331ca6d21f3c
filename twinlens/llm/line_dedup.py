"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches from the largest ids down. A batch's long lines become
a sorted run: hash, documents holding it, and the largest of them. The run is
merge-joined with the runs already there, which are stored as sorted buckets, so
nothing of them is shuffled or sorted again; what no run has is new and keeps its
largest document as the line's keeper, what was there adds its count only. Two
runs of a level are compacted into one of the next, bucket by bucket. In the end all
levels are summed, and frequent lines go everywhere but in their keeper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WS_CHARS, drop_stored, free_name, quoted, sorted_run, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WS_CHARS)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(line: Column, min_chars: int) -> Column:
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))


def _salt(id_: Column, text: Column) -> Column:
    """Rows without id are told apart by their texts, so that they need not meet."""
    return F.when(id_.isNull(), F.xxhash64(text))


def _occurrences(df: DataFrame, id_col: str, min_chars: int) -> DataFrame:
    id_, text = F.col(quoted(id_col)), F.col("text")
    hashes = F.array_distinct(F.filter(F.transform(_lines(text), lambda x: _hash(x, min_chars)), lambda h: h.isNotNull()))
    return df.select(id_.alias("id"), _salt(id_, text).alias("salt"), F.explode(hashes).alias("line")).distinct()


class LineRuns:
    """A family of sorted runs (line, n_docs, keeper); two of a level make one of the next."""

    def __init__(self):
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _run(df: DataFrame) -> DataFrame:
        return sorted_run(df, "line-run", "line", ["line"])

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Both runs as one: a merge of their sorted buckets, without a shuffle."""
        b = b.select("line", F.col("n_docs").alias("n_b"), F.col("keeper").alias("keeper_b"))
        n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_b", F.lit(0))
        return self._run(a.join(b.hint("merge"), "line", "full").select("line", n.alias("n_docs"), F.greatest("keeper", "keeper_b").alias("keeper")))

    def add(self, occurrences: DataFrame) -> None:
        """Adds a batch of (id, line), all of whose ids are below those before; rows
        without id are one document, in the last batch."""
        n_docs = F.count("id") + F.max(F.col("id").isNull().cast("long"))
        run = self._run(occurrences.groupBy("line").agg(n_docs.alias("n_docs"), F.max("id").alias("keeper")))
        if old := self.runs():
            marked, fresh = run, F.lit(True)
            for i, r in enumerate(old):  # a line is once in a run, so no row is multiplied
                marked = marked.join(r.select("line", F.lit(True).alias(f"in_{i}")), "line", "left")
                fresh = fresh & F.col(f"in_{i}").isNull()
            new = self._run(marked.select("line", "n_docs", F.when(fresh, F.col("keeper")).alias("keeper")))
            drop_stored(run)
            run = new
        self._push(run, 0)

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == 2:
            two, self.levels[level] = self.levels[level], []
            self._push(self._merged(*two), level + 1)
            drop_stored(*two)

    def frequent(self, min_docs: int) -> DataFrame:
        """(line, keeper) of the lines in min_docs documents or more, stored; drops the runs."""
        all_, *rest = self.runs()
        for r in rest:
            all_, before = self._merged(all_, r), all_
            drop_stored(before, r)
        self.levels = []
        out = stored(all_.where(F.col("n_docs") >= min_docs).select("line", "keeper"), "line-frequent")
        drop_stored(all_)
        return out


def _batch_number(ids: DataFrame, n: int) -> Column:
    """0 for the range with the largest `id`s and so on; null ids count as the smallest."""
    c = F.col("id")
    cuts = ids.agg(F.percentile_approx(c, [i / n for i in range(1, n)])).first()[0] or [] if n > 1 else []
    cuts = sorted(set(cuts), reverse=True)
    out = F.lit(len(cuts))
    for k, cut in reversed(list(enumerate(cuts))):
        out = F.when(c > cut, F.lit(k)).otherwise(out)
    return out


def line_dedup(df: DataFrame, id_col: str = "doc_id", min_chars: int = 40, min_docs: int = 5, n_batches: int = 4) -> DataFrame:
    """df with its texts without repeated lines, and n_lines and n_dropped.

    Lines whose key has min_chars code points or more and occurs in min_docs
    documents or more go, but for those in the largest id holding the key. Null
    and empty texts are one empty line; a text that loses nothing is unchanged
    (null stays null), one that loses all lines is empty. Rows of one id are one
    document for counting, and null ids together are one below all others.
    Columns other than text pass through, whatever their names, but for own columns
    n_lines and n_dropped, which are replaced. An empty table gives an empty one.
    """
    id_ = F.col(quoted(id_col))
    batch = _batch_number(df.select(id_.alias("id")), n_batches)
    found = stored(_occurrences(df, id_col, min_chars).withColumn("batch", batch), "line-occurrences", "batch")
    index = LineRuns()
    for k in range(n_batches):
        rows = found.where(F.col("batch") == k)
        if not index.runs() or not rows.isEmpty():
            index.add(rows)
    frequent = index.frequent(min_docs)
    drop_id, salt, drop, lines_, kept_ = (free_name(df, x) for x in ("_id", "_salt", "_drop", "_lines", "_kept"))
    drops = (
        found.join(frequent, "line")
        .where(F.col("keeper").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("keeper"))))
        .groupBy(F.col("id").alias(drop_id), F.col("salt").alias(salt)).agg(F.collect_set("line").alias(drop))
    )
    text = F.col("text")
    lines = _lines(text)
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(drop, _hash(x, min_chars)), F.lit(False)))
    same = id_.eqNullSafe(F.col(drop_id)) & _salt(id_, text).eqNullSafe(F.col(salt))
    out = df.join(drops, same, "left").withColumns({lines_: F.size(lines).cast("long"), kept_: F.when(F.col(drop).isNotNull(), kept)})
    rest = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(
        *[F.coalesce(F.array_join(kept_, "\n"), text).alias(c) if c == "text" else F.col(quoted(c)) for c in rest],
        F.col(lines_).alias("n_lines"),
        F.coalesce(F.col(lines_) - F.size(kept_), F.lit(0)).alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what stays of every document, whole texts. Nulls,
    ties, repeated rows and empty tables as in line_dedup(); columns other than doc_id
    and text are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

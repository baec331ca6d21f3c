"""Quality rules by weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts
of all vote patterns in the corpus (3 to the number of rules at most, so they fit
the driver at any input size) estimates how often each rule casts each vote on
good and on bad documents, and a document is kept when the posterior probability
that it is good reaches a threshold, not when all rules pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import _IS_WS, byte_chunks, count_by_text, free_name, hash_spans, mix, prefix_hash, quoted, span_hash, stored, words

#: Common words of the four languages of the documents.
STOP_WORDS = (
    "the and of to in is that with for was on are by this "
    "der die und das ist nicht von zu mit den ein eine auf für "
    "le la les des et un une du que est dans pour qui par "
    "el los las de en y es una con por para del se al"
).split()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD_CHAR = ~_IS_WS & ((np.arange(256) & 0xC0) != 0x80)  # first bytes of characters in words
_LATIN = np.zeros(256, bool)
_LATIN[[*range(65, 91), *range(97, 123)]] = True
#: Whether a code point below 0x10000 is a letter; those beyond count from 0x20000 (Han).
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_CHUNK = 1 << 19
_END = np.zeros(256, bool)
_END[list(b".!?:;\"'")] = True


def _hashes(of: list[str]) -> np.ndarray:
    sizes = np.array([len(w.encode()) for w in of])
    ends = np.cumsum(sizes)
    return np.sort(span_hash(prefix_hash(np.frombuffer("".join(of).encode(), np.uint8)), ends - sizes, ends))


_STOP = _hashes(STOP_WORDS)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letters", "n_ended_lines")
WINDOW = 8


def _distinct_surplus(doc: np.ndarray, h: np.ndarray):
    """For rows (doc, hash): which equal an earlier one, and which have any equal."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    same = np.zeros(len(d) + 1, bool)
    same[1:-1] = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    later, any_ = np.zeros(len(d), bool), np.zeros(len(d), bool)
    later[order], any_[order] = same[:-1], same[:-1] | same[1:]
    return later, any_


def _other_letters(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Letters beyond ASCII of each text, from the two to four bytes of a character."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return np.zeros(len(off) - 1, np.int64)
    b = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in range(4)]
    two, three = ((b[0] & 0x1F) << 6) | b[1], ((b[0] & 0xF) << 12) | (b[1] << 6) | b[2]
    four = ((b[0] & 7) << 18) | (b[1] << 12) | (b[2] << 6) | b[3]
    first = data[lead]
    point = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    letter = np.where(point < 0x10000, _LETTER[point & 0xFFFF], point >= 0x20000)
    return np.bincount(np.searchsorted(off, lead[letter], "right") - 1, minlength=len(off) - 1)


def text_features(texts: pa.Array) -> dict[str, np.ndarray]:
    """FEATURES of each text, whole; a null text is empty."""
    out = {k: np.zeros(len(texts), np.int64) for k in FEATURES}
    for at, off, data in byte_chunks(texts, _CHUNK):
        n = len(off) - 1
        if not len(data):
            continue
        to = slice(at, at + n)
        doc, start, end, h = words(off, data)
        out["n_words"][to] = np.bincount(doc, minlength=n)
        out["word_chars"][to] = count_by_text(off, data, _WORD_CHAR)
        out["n_symbols"][to] = count_by_text(off, data, _SYMBOL)
        out["n_letters"][to] = count_by_text(off, data, _LATIN) + _other_letters(off, data)
        low = words(off, data, lower=True)[3]
        out["n_stop_words"][to] = np.bincount(doc, _STOP[np.minimum(np.searchsorted(_STOP, low), len(_STOP) - 1)] == low, n).astype(np.int64)
        # lines: between line feeds and text ends, those with a word only
        feeds = np.flatnonzero(data == 10)
        ls = np.sort(np.concatenate((off[:-1], feeds + 1)))
        le = np.sort(np.concatenate((feeds, off[1:])))
        ld = np.minimum(np.searchsorted(off, ls, "right") - 1, n - 1)
        wordy = np.searchsorted(start, le) > np.searchsorted(start, ls)
        ls, le, ld = ls[wordy], le[wordy], ld[wordy]
        out["n_lines"][to] = np.bincount(ld, minlength=n)
        later, _ = _distinct_surplus(ld, hash_spans(data, ls, le))
        out["n_dup_lines"][to] = np.bincount(ld, later, n).astype(np.int64)
        last = end[np.searchsorted(start, le) - 1] - 1
        out["n_ended_lines"][to] = np.bincount(ld, _END[data[last]], n).astype(np.int64)
        if len(doc) >= WINDOW:
            m = len(doc) - WINDOW + 1
            g = np.zeros(m, np.uint64)
            for j in range(WINDOW):
                g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
            whole = doc[:m] == doc[WINDOW - 1 :]
            at_w = np.flatnonzero(whole)
            _, twice = _distinct_surplus(doc[at_w], mix(g[at_w]))
            step = np.zeros(len(doc) + 1, np.int64)
            step[at_w[twice]] += 1  # a window starts once at a word
            step[at_w[twice] + WINDOW] -= 1
            out["n_repeat_words"][to] = np.bincount(doc, np.cumsum(step[:-1]) > 0, n).astype(np.int64)
    return out


@F.arrow_udf(StructType([StructField(k, LongType()) for k in FEATURES]))
def _features(text: pa.Array) -> pa.Array:
    f = text_features(text)
    return pa.StructArray.from_arrays([pa.array(f[k]) for k in FEATURES], names=list(FEATURES))


#: Declared as not deterministic, so that the optimiser evaluates it once where it stands
#: and does not copy it into filters and projections.
features = _features.asNondeterministic()


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(f: Column) -> list[Column]:
    """The rules: each 1 (good), -1 (bad) or 0 (abstains) from text features."""
    n = F.greatest(f["n_words"], F.lit(1))
    lines = F.greatest(f["n_lines"], F.lit(1))
    chars = F.greatest(f["word_chars"], F.lit(1))
    mean = f["word_chars"] / n
    return [
        _vote((mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 14)),
        _vote(f["n_symbols"] * 100 <= n, f["n_symbols"] * 10 > n),
        _vote(f["n_dup_lines"] == 0, f["n_dup_lines"] * 10 > lines * 3),
        _vote(f["n_repeat_words"] * 100 <= n * 2, f["n_repeat_words"] * 10 > n * 2),
        _vote(f["n_stop_words"] * 20 >= n, (f["n_stop_words"] * 50 < n)),
        _vote(f["n_letters"] * 100 >= chars * 80, f["n_letters"] * 100 < chars * 60),
        _vote(f["n_ended_lines"] * 10 >= lines * 7, f["n_ended_lines"] * 10 < lines * 2),
    ]


N_RULES = 7


@dataclass
class LabelModel:
    """P(good) of each vote pattern, from EM over pattern counts."""

    prior: float
    tables: np.ndarray  # rule, class (bad, good), vote + 1

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> LabelModel:
        """patterns: rows of votes; counts: documents that have each. Starts from
        rules that are right four times in five when they vote."""
        rules = patterns.shape[1]
        tables = np.tile(np.array([[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]]), (rules, 1, 1))
        m = cls(0.5, tables)
        total = counts.sum()
        for _ in range(steps if total else 0):
            p = m.posterior(patterns)
            w = np.stack((counts * (1 - p), counts * p))
            prior = float(np.clip(w[1].sum() / total, 0.05, 0.95))
            new = np.empty_like(tables)
            for r in range(rules):
                for v in (-1, 0, 1):
                    new[r, :, v + 1] = w[:, patterns[:, r] == v].sum(1) + 1
            new /= new.sum(2, keepdims=True)
            done = abs(new - m.tables).max() < 1e-9
            m = cls(prior, new)
            if done:
                break
        return m

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(np.array([1 - self.prior, self.prior]))[:, None] + sum(
            np.log(self.tables[r][:, patterns[:, r] + 1]) for r in range(patterns.shape[1])
        )
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _code(vs: list[Column]) -> Column:
    code = F.lit(0)
    for v in vs:
        code = code * 3 + v + 1
    return code


def _posteriors(spark: SparkSession, coded: DataFrame, rules: int) -> DataFrame:
    """pattern, posterior: one row a pattern, 3 ** rules at most."""
    found = coded.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    codes = np.array([r["pattern"] for r in found], np.int64)
    patterns = np.stack([codes // 3 ** (rules - 1 - r) % 3 - 1 for r in range(rules)], 1) if len(codes) else np.zeros((0, rules), np.int64)
    p = LabelModel.fit(patterns, np.array([r["n"] for r in found], float)).posterior(patterns)
    return spark.createDataFrame([(int(c), float(x)) for c, x in zip(codes, p)], "pattern int, posterior double")


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (f["n_repeat_words"] * 100 > f["n_words"] * 30)


def _with_posterior(rows: DataFrame, pattern: str, to: str) -> DataFrame:
    """rows with the posterior of their vote pattern, -1 (base failed) having none; fitted
    over all rows, joined as a table of 2,187 rows at most."""
    fit = rows.where(F.col(pattern) >= 0).select(F.col(pattern).alias("pattern"))
    p = _posteriors(rows.sparkSession, fit, N_RULES)
    p = F.broadcast(p.select(F.col("pattern").alias(f"{pattern}_"), F.col("posterior").alias(to)))
    return rows.join(p, F.col(pattern) == F.col(f"{pattern}_"), "left").drop(f"{pattern}_")


def _pattern(f: Column) -> Column:
    return F.when(base_failed(f), F.lit(-1)).otherwise(_code(votes(f))).cast("int")


def score(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df's columns but the text, with _f (features), _posterior and _kept; the
    rows are stored, without texts, so the texts are read once.

    A text fails at once below 20 words or with over 30 % repeated words (null and
    empty texts do); all others are kept from a posterior of 0.5, which a text that
    fails lacks (null). Repeated rows are scored alike; an empty table gives an empty
    one. Other columns pass through, whatever their names; own columns named _f,
    _posterior or _kept are replaced.
    """
    rest = [c for c in df.columns if c not in (text_col, "_f", "_posterior", "_kept")]
    pattern = free_name(df, "_pattern")
    rows = df.select(*map(quoted, rest), features(text_col).alias("_f")).withColumn(pattern, _pattern(F.col("_f")))
    rows = _with_posterior(stored(rows, "quality"), pattern, "_posterior")
    kept = (F.col(pattern) >= 0) & (F.coalesce("_posterior", F.lit(0.0)) >= 0.5)
    return rows.withColumn("_kept", kept).select(*map(quoted, rest), "_f", "_posterior", "_kept")


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df whose text is kept, as score() judges it. Features are taken in one
    pass, which stores the rows that pass the base rules with their vote pattern; the
    label model is fitted over the stored patterns, then each stored row is judged, so no
    text is shuffled or read twice. Columns of any name pass through; null and empty
    texts go; an empty table gives an empty one."""
    pattern, posterior = free_name(df, "_pattern"), free_name(df, "_posterior")
    f = free_name(df, "_f")
    rows = df.withColumn(f, features(text_col)).withColumn(pattern, _pattern(F.col(f))).drop(f)
    rows = _with_posterior(stored(rows.where(F.col(pattern) >= 0), "quality"), pattern, posterior)
    return rows.where(F.col(posterior) >= 0.5).select(*map(quoted, df.columns))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base_failed, kept and posterior of every document, whole texts. Null,
    empty and blank texts have zero counts and fail; repeated rows each have a row; an
    empty table gives no rows; other columns of documents are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    f = F.col("_f")
    return score(docs).select("doc_id", *[f[k].alias(k) for k in FEATURES[:5]], base_failed(f).alias("base_failed"), F.col("_kept").alias("kept"), F.col("_posterior").alias("posterior"))

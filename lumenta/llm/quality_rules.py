"""Quality rules: a learned decision list over plain text statistics.

Sequential covering on labelled statistics: grow a conjunction of thresholds that covers
poor documents and spares good ones, prune it on held-out rows, keep it if it stays
precise there, drop what it covers, and start again.  The list becomes one ordered Spark
conditional expression, so applying it needs no Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_WHITE, Bytes, doc_key, from_key, grams, lookup, mix, small_batches, table, text_slices

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: At most so many labelled documents are learned from, those of the smallest hashes.
TRAIN_ROWS = 20_000
#: A rule must be this precise on the rows held out for pruning, and cover so many there.
MIN_PRECISION, MIN_COVER = 0.9, 3
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 64

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_digits", "n_lines"]
SCHEMA = "doc long, " + ", ".join(f"{s} long" for s in STATS)

_SYMBOL, _MARK, _DIGIT = lookup(SYMBOLS), lookup(b"!?"), lookup(b"0123456789")
_UPPER, _LETTER = lookup(bytes(range(65, 91))), lookup(bytes([*range(65, 91), *range(97, 123)]))
_WORD_CHAR = NOT_WHITE.copy()
_WORD_CHAR[0x80:0xC0] = False  # later bytes of a code point


def _copies(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, occurs earlier) for each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def _totals(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[first])


def slice_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    text = Bytes(data, offsets)
    starts, ends, first = text.words(NOT_WHITE)
    out = {"n_words": np.diff(first)}
    for name, chars in (("word_chars", _WORD_CHAR), ("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _MARK), ("n_digits", _DIGIT)):
        out[name] = text.count(chars[data])
    doc_of = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    gram, at = grams(text.hash(starts, ends), first, 3)
    twice, _ = _copies(mix(gram + doc_of[at] * np.uint64(0x9E3779B97F4A7C15)))
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = _totals(covered, first)
    begin, end, line_first = text.lines()
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(NOT_WHITE[data], out=inside[1:])
    worded = inside[end] > inside[begin]
    line_doc = np.repeat(np.arange(len(line_first) - 1, dtype=np.uint64), np.diff(line_first))
    key = mix(text.hash(begin, end) + line_doc * np.uint64(0x9E3779B97F4A7C15))
    later = np.zeros(len(begin), bool)
    later[np.flatnonzero(worded)] = _copies(key[worded])[1]
    out["n_dup_lines"] = _totals(later, line_first)
    out["n_lines"] = _totals(worded, line_first)
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc").cast(pa.int64())
        for lo, hi, data, offsets in text_slices(batch, "_lm_text"):
            found = slice_statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(found[s]) for s in STATS)], names=["doc", *STATS])


def _statistics_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, _lm_text, good, _lm_o) to (doc, statistics, good, _lm_o)."""
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch, "_lm_text"):
            found = slice_statistics(data, offsets)
            doc, good, order = (batch.column(c).slice(lo, hi - lo) for c in ("doc", "good", "_lm_o"))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(found[s]) for s in STATS), good, order], names=["doc", *STATS, "good", "_lm_o"])


def _beside(column: str):
    """Each row's statistics beside its own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [slice_statistics(data, offsets) for _, _, data, offsets in text_slices(batch, column)]
            if parts:
                own = pa.StructArray.from_arrays([pa.array(np.concatenate([p[s] for p in parts])) for s in STATS], names=STATS)
                yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "_lm_stats"])

    return run


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, statistics of STATS) of each row's whole text; a null text counts as empty."""
    small_batches(docs.sparkSession)
    return docs.select(doc_key(id_col).alias("doc"), F.col(text_col).alias("_lm_text")).mapInArrow(_statistics, SCHEMA)


# ------------------------------------------------------------------- learning

#: Features of the rules: numerator and denominator among the statistics.
RATIOS = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def column(self, prefix: str = "") -> Column:
        top, below = RATIOS[self.feature]
        value = F.col(prefix + top).cast("double")
        if below:
            value = value / F.greatest(F.col(prefix + below), F.lit(1))
        return value > F.lit(self.value) if self.above else value <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def features(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: stats[a].astype(float) / (np.maximum(stats[b], 1) if b else 1) for k, (a, b) in RATIOS.items()}


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], poor: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(poor), bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int(poor[inside].sum()), int((~poor[inside]).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for name in RATIOS:
            values = x[name][inside]
            order = np.argsort(values, kind="stable")
            ranked, hit = values[order], np.cumsum(poor[inside][order])
            cuts = np.flatnonzero(ranked[1:] > ranked[:-1])
            if len(cuts) > CUTS:
                # every step of a long scale is too many; the even ranks and the purest ends remain
                cuts = np.unique(np.r_[cuts[np.linspace(0, len(cuts) - 1, CUTS).astype(int)], cuts[:8], cuts[-8:]])
            if not len(cuts):
                continue
            p_low, n_low = hit[cuts], cuts + 1 - hit[cuts]
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(p > 0, p * (np.log2((p + 1e-12) / (p + n + 1e-12)) - np.log2(p0 / (p0 + n0))), -1)
                k = int(np.argmax(score))
                if score[k] > gain:
                    best, gain = Condition(name, above, float((ranked[cuts[k]] + ranked[cuts[k] + 1]) / 2)), float(score[k])
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], poor: np.ndarray) -> tuple[float, int]:
    inside = _covers(rule, x)
    p, n = int(poor[inside].sum()), int((~poor[inside]).sum())
    return (p / (p + n) if p + n else 0.0), p


def learn(stats: dict[str, np.ndarray], poor: np.ndarray, held_out: np.ndarray) -> list[Rule]:
    """An ordered list of rules that reject; no rows or one class only give no rules."""
    x = features(stats)
    rules: list[Rule] = []
    left = np.ones(len(poor), bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & ~held_out, left & held_out
        if not poor[grow].any() or not (~poor[grow]).any():
            break
        xg, xp = ({k: v[m] for k, v in x.items()} for m in (grow, prune))
        rule = _grow(xg, poor[grow])
        if not rule:
            break
        # of the rule's openings, the one of the largest precision on held-out rows, then coverage, then brevity
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (*_worth(r, xp, poor[prune]), -len(r)))
        precision, cover = _worth(rule, xp, poor[prune])
        if precision < MIN_PRECISION or cover < MIN_COVER:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def rule_column(rules: list[Rule], prefix: str = "") -> Column:
    """The place of the first rule that fires, from 1; 0 where none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        holds = rule[0].column(prefix)
        for c in rule[1:]:
            holds = holds & c.column(prefix)
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def base_failed(prefix: str = "") -> Column:
    words, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", train_rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from labelled documents that pass the base checks.

    Rows of labels without an id or a quality are no labels; of an id labelled twice the
    lower quality counts, of one with several texts one text.  Where more than train_rows ids are labelled,
    the ids whose hash lies below a threshold are taken, so a task or the driver holds
    train_rows at most.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col(quality_col).alias("_lm_q")).filter("doc is not null and _lm_q is not null")
    marks = marks.groupBy("doc").agg((F.min("_lm_q") > 0).alias("good")).withColumn("_lm_o", F.xxhash64("doc"))
    share = min(1.0, 1.1 * train_rows / max(1, marks.count()))  # a little more, for the limit to cut
    chosen = marks.filter(F.shiftrightunsigned("_lm_o", 32) < int(share * (1 << 32))).orderBy(F.shiftrightunsigned("_lm_o", 32), "doc").limit(train_rows)
    texts = docs.select(doc_key(id_col).alias("doc"), F.col(text_col).alias("_lm_text")).join(F.broadcast(chosen), "doc")  # train_rows at most
    rows = texts.mapInArrow(_statistics_beside, f"{SCHEMA}, good boolean, _lm_o long").filter(~base_failed())
    got = rows.groupBy("doc").agg(F.min(F.struct("good", "_lm_o", *STATS)).alias("r")).select("r.*").toPandas()
    held_out = (got["_lm_o"].to_numpy(np.int64).view(np.uint64) >> np.uint64(40)) % np.uint64(3) == 0
    return learn({s: got[s].to_numpy(np.int64) for s in STATS}, ~got["good"].to_numpy(bool), held_out)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, statistics, base_failed, rule and kept.

    A null or empty text has no words and fails the base check; a text of any length is
    judged whole.  Without usable labels no rule is learned and the base check decides.  Rows
    that repeat an id keep a row each, judged by its own text; a null id stays null.  No rows
    give no rows.  Other columns of docs are not read, whatever their names.
    """
    rules = learn_from(docs, labels, id_col, text_col)
    out = statistics(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("rule", rule_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).withColumn("doc_id", from_key("doc")).select("doc_id", *STATS, "base_failed", "kept", "rule")


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the rules reject, with its own columns only.

    Each row is judged by its own text, so rows without an id, or that repeat one, neither
    save nor doom each other.  Other cases as in quality_rules.
    """
    rules = learn_from(docs, labels, id_col, text_col)
    kind = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
    rows = docs.mapInArrow(_beside(text_col), T.StructType([*docs.schema.fields, T.StructField("_lm_stats", kind)]))
    kept = rows.filter(~base_failed("_lm_stats.") & (rule_column(rules, "_lm_stats.") == 0))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )

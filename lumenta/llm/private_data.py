"""PII: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a column expression.  Spark gives the matches and the pieces between them
but no positions, so these are summed from lengths, in blocks to stay near linear.  The
patterns have no repeated groups, which would overflow the stack of Java's engine on long
runs: a joining dot, space or hyphen becomes one marker character first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

JOIN, PLAIN = "\x01", "\x02"  # the marker; a marker in the text itself becomes PLAIN
BLOCK = 256
CONTEXT_CHARS = 40
MIN_SCORE = 0.5
LOW = "_lm_low"  # the text in lower case, made once


def _marked(text: Column, joint: str) -> Column:
    return F.regexp_replace(F.translate(text, JOIN, PLAIN), joint, JOIN)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    turned = F.reverse(_digits(match))

    def add(total: Column, at: Column) -> Column:
        d = F.substring(turned, at, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(at % 2 == 0, double).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), add)
    return F.length(turned).between(16, 19) & (total % 10 == 0)


def _mod97(match: Column) -> Column:
    packed = F.regexp_replace(match, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))

    def add(rest: Column, at: Column) -> Column:
        c = F.substring(turned, at, F.lit(1))
        return F.when(c.rlike("[0-9]"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.length(packed).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1)


def _octets(match: Column) -> Column:
    return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


@dataclass(frozen=True)
class Kind:
    name: str
    base: bool
    cue: Callable[[Column], Column]  # false where no span can be; cheap
    pattern: str
    confirm: Callable[[Column], Column]
    score: float  # of a confirmed span, without context
    context: str  # words near it that raise the score
    joint: str | None = None
    weak: Callable[[Column], Column] | None = None  # spans that count only with context


#: Names that stand before a secret, and secrets that are known by their form.
SECRET_NAMES = "(?:auth[_-]?)?token|(?:client[_-]?)?secret|password|passwd|pwd|api[_-]?key|access[_-]?key"
SECRET_CUES = ("token", "secret", "passw", "pwd", "key", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "xox", "aiza", "eyj")
SECRET_FORMS = (
    r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
    r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
)


def _value(match: Column) -> Column:
    return F.regexp_replace(match, r"^[^:=]*(?::=|=>|[:=])[\x20]*", "")


#: In the order of the output.  Scores of base kinds stay at MIN_SCORE or above.
KINDS = (
    Kind(
        "email", True, lambda t: F.contains(t, F.lit("@")),
        r"(?:(?<![A-Za-z0-9._%+\x01-])|\G)[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++",
        lambda m: F.lit(True), 0.9, "mail|contact|write|reach", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])",
    ),
    Kind("ip", True, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.7, "ip|address|host|server|login"),
    Kind("card", True, lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"), r"[0-9][0-9\x01]{15,}+", _luhn, 0.8, "card|visa|master|payment|pay", r"(?<=[0-9])[ -](?=[0-9])"),
    Kind("phone", True, lambda t: F.contains(t, F.lit("+")), r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", False, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _mod97, 0.8, "iban|account|bank"),
    Kind(
        "secret", False, lambda t: reduce(lambda a, b: a | b, [F.contains(F.col(LOW), F.lit(x)) for x in SECRET_CUES]),
        rf"(?i)(?<![a-z0-9])(?:{SECRET_NAMES})[\"']?[\x20]{{0,2}}(?::=|=>|[:=])[\x20]{{0,2}}(?:\"[^\"\s]{{8,}}+\"|'[^'\s]{{8,}}+'|[A-Za-z0-9+/_=.~!@$%^&*-]{{8,}}+)|(?<![A-Za-z0-9])(?-i:{SECRET_FORMS})",
        lambda m: F.lit(True), 0.6, "auth|login|credential|secret|private", None,
        lambda m: m.rlike("(?i)^(?:" + SECRET_NAMES + ")") & ~m.rlike("[\"']$") & ~_value(m).rlike("[0-9]"),
    ),
    Kind("ssn", False, lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social security|tax id"),
)
CONTEXT_BONUS = 0.3


def _found(df: DataFrame, kind: Kind, text: str) -> DataFrame:
    """df with the kind's spans as array<struct<start, end, score>> in _lm_<kind>; steps of
    their own columns, so that Spark computes each once."""
    n = f"_lm_{kind.name}"
    df = df.withColumn(f"{n}_t", F.when(kind.cue(F.col(text)), _marked(F.col(text), kind.joint) if kind.joint else F.col(text)))
    df = df.withColumn(f"{n}_m", F.regexp_extract_all(f"{n}_t", F.lit(kind.pattern), F.lit(0)))
    df = df.withColumn(f"{n}_p", F.when(F.size(f"{n}_m") > 0, F.split(f"{n}_t", kind.pattern, -1)))
    df = df.withColumn(f"{n}_l", F.transform(f"{n}_m", lambda m, i: F.length(m) + F.length(F.get(F.col(f"{n}_p"), i))))

    def total(first: Column, count: Column, of: str) -> Column:
        return F.aggregate(F.slice(of, first, count), F.lit(0).cast("long"), lambda a, x: a + x)

    blocks = F.sequence(F.lit(0), (F.size(f"{n}_l") - 1).cast("int").__truediv__(BLOCK).cast("int"))
    df = df.withColumn(f"{n}_s", F.when(F.size(f"{n}_m") > 0, F.transform(blocks, lambda b: total(b * BLOCK + 1, F.lit(BLOCK), f"{n}_l"))))
    df = df.withColumn(f"{n}_b", F.transform(f"{n}_s", lambda _, b: total(F.lit(1), b, f"{n}_s")))

    def span(m: Column, i: Column) -> Column:
        block = (i / BLOCK).cast("int")
        piece = F.get(F.col(f"{n}_p"), i)
        start = F.get(F.col(f"{n}_b"), block) + total(block * BLOCK + 1, i - block * BLOCK, f"{n}_l") + F.length(piece)
        before, after = F.substring(piece, -CONTEXT_CHARS, CONTEXT_CHARS), F.substring(F.get(F.col(f"{n}_p"), i + 1), 1, CONTEXT_CHARS)
        near = F.lower(F.concat(before, F.lit(" "), after)).rlike(rf"\b(?:{kind.context})")
        alone = F.when(kind.weak(m), F.lit(kind.score - CONTEXT_BONUS)).otherwise(F.lit(kind.score)) if kind.weak else F.lit(kind.score)
        score = F.least(alone + F.when(near, CONTEXT_BONUS).otherwise(0.0), F.lit(1.0))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score"), kind.confirm(m).alias("ok"))

    spans = F.filter(F.transform(f"{n}_m", span), lambda s: s["ok"] & (s["score"] >= MIN_SCORE))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,score:double,ok:boolean>>")
    df = df.withColumn(n, F.coalesce(F.when(F.size(f"{n}_m") > 0, spans), empty))
    return df.drop(*[f"{n}_{x}" for x in "tmplsb"])


def _name(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))


def _of(*kinds: str) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end, score) by the
    order of KINDS, then start; positions are code points, end exclusive.

    A null or empty text has no spans; a text of any length is searched whole.  Context is
    the CONTEXT_CHARS on either side, up to the next span of the same kind; it decides for spans that
    are weak alone.  Rows that repeat an id keep a row each, a null id stays null, and no rows
    give no rows.  Other columns of docs are not read, whatever their names.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_lm_text"))
    df = df.withColumn(LOW, F.lower("_lm_text"))
    for kind in KINDS:
        df = _found(df, kind, "_lm_text")
    named = [F.transform(f"_lm_{k.name}", _name(k.name)) for k in KINDS]
    return df.select("doc_id", F.concat(*named).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = private_data(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]
    counts = [F.size(_of(k)).cast("long").alias(f"n_{k}") for k in base]
    top = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select(
        "doc_id", *counts, F.sha2(_joined(_of(*base)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), top.alias("top_score")
    )

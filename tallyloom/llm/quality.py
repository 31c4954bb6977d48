"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per failed
rule; policies are versioned masks over those bits, so a new policy or an ablation never reads a text
again.  Words are runs of characters outside ``[\\x20\\x09-\\x0D]``, of the whole text.

Defined results: a null or empty text has no words and all measurements 0; equal rows get equal ledger
rows; an empty table gives an empty ledger; columns of the input other than the id and the text are not
carried, so no name can clash.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import values

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_upper")

#: (name, failure condition over the measurements m); the position is the bit.  Shares are compared
#: as integer products.
RULES = (
    ("few_words", lambda m: m("n_words") < 50),
    ("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    ("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    ("repeated_lines", lambda m: 5 * m("n_dup_lines") > 2 * m("n_lines")),
    ("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
    ("shouting", lambda m: 10 * m("n_shouts") > 3 * m("n_words")),
    ("capitals", lambda m: 2 * m("n_upper") > m("word_chars")),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_windows"]
#: Versioned policies: a document is rejected if it fails a rule of the mask.
POLICIES = {1: BASE_MASK, 2: (1 << len(RULES)) - 1}
PRODUCTION = 2

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            marks = bytearray(n)
            for i, w in enumerate(windows):
                if count[w] > 1:
                    marks[i : i + 3] = b"\1\1\1"
            repeat = sum(marks)
    return (
        n,
        len(text) - sum(map(text.count, _SPACE)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        dup,
        repeat,
        lines,
        raw.count(b"!"),
        len(raw) - len(raw.translate(None, _CAPITALS)),
    )


def _measured(texts: pa.Array) -> pa.Array:
    rows = [measure(t) for (t,) in values(texts)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))], MEASURES)


def measurements(text: Column) -> Column:
    """Struct of ``MEASURES``; only the text travels to Python, in Arrow batches.

    Marked non-deterministic so that no optimizer rule evaluates it twice.
    """
    schema = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"
    return F.arrow_udf(_measured, schema).asNondeterministic()(text)


def fail_bits(m: Callable[[str], Column]) -> Column:
    """One bit per failed rule."""
    bits = [F.when(rule(m), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    return functools.reduce(Column.bitwiseOR, bits).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, measurements, fail_bits)``, one row per document, in one narrow pass."""
    measured = docs.select(F.col(id_col), measurements(F.col(text_col).cast("string")).alias("m"))
    return measured.select(id_col, "m.*", fail_bits(lambda name: F.col(f"m.{name}")).alias("fail_bits"))


def _fails(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policy(book: DataFrame, version: int = PRODUCTION) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` for a policy version; reads the bits only."""
    bits = F.col("fail_bits")
    return book.withColumn("base_failed", _fails(bits, BASE_MASK)).withColumn("kept", ~_fails(bits, POLICIES[version] | BASE_MASK))


def ablations(book: DataFrame, version: int = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, kept if it were left out, kept.

    The ledger shrinks to at most ``2 ** len(RULES)`` bit patterns by a map-side combined count; all
    ablations are bitwise sums over those, and only they are broadcast.
    """
    mask = POLICIES[version] | BASE_MASK
    rules = ", ".join(f"('{n}', {b}L)" for n, b in BIT.items() if b & mask)
    names = book.sparkSession.sql(f"SELECT * FROM VALUES {rules} AS r(rule, bit)")
    patterns = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    hit, bit, whole = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")), F.col("bit"), F.lit(mask).cast("long")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return names.join(F.broadcast(patterns), F.lit(True), "left").groupBy("rule", "bit").agg(
        total(hit.bitwiseAND(bit) != 0).alias("n_failed"),
        total(hit == bit).alias("n_failed_alone"),
        total(hit.bitwiseAND(whole.bitwiseXOR(bit)) == 0).alias("n_kept_without"),
        total(hit == 0).alias("n_kept"),
    )


def passing(docs: DataFrame, version: int = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns.

    The bits are computed beside the row, so repeated or null ids need no join.
    """
    name = "__measured"
    bits = fail_bits(lambda m: F.col(f"{name}.{m}"))
    measured = docs.withColumn(name, measurements(F.col(text_col).cast("string")))
    return measured.where(~_fails(bits, POLICIES[version] | BASE_MASK)).drop(name)

"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document; the ledger keeps the measurements and one failure bit for
each rule. A policy is a version and the set of rules that it enforces, so a new policy, or the question
what a rule costs, needs the ledger alone: policies apply by a mask, ablations by bitwise aggregation.

Rows: one for each input row, in place. A null text counts as empty: all measurements are 0, and the rule on
the number of words fails. A null id stays null; repeated rows stay repeated; other columns are not read; an
empty table gives an empty ledger. A rule fails on values beyond its bound, not on the bound itself.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import map_texts, slim, table, unslim

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER, LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))

#: name -> SQL over the measurements, true where the rule fails. The order gives the bits: append only.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "upper_case": "100 * n_upper > 40 * n_letters",
    "exclamations": "100 * n_exclamations > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_words")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclamations")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(name) for name in self.rules)


BASE_POLICY = Policy("base", BASE)
POLICY = Policy("1", tuple(RULES))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, covered = Counter(windows), bytearray(len(words))
    for k, window in enumerate(windows):
        if times[window] > 1:
            covered[k] = covered[k + 1] = covered[k + 2] = 1
    return sum(covered)


def measure(data: bytes) -> tuple[int, ...]:
    """MEASURES of a text's bytes. Words are runs of bytes other than the six ASCII white spaces, which is what bytes.split() gives."""
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip(SPACE)]
    upper = len(data) - len(data.translate(None, UPPER))
    return (
        len(words),
        len(data.translate(None, CONTINUATION + SPACE)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + len(data) - len(data.translate(None, LOWER)),
        data.count(b"!"),
    )


def ledger(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, measurements, failed: bit k is set where rule k fails, carried columns)."""
    schema = "id long," + ",".join(f"{name} long" for name in MEASURES)
    measured = map_texts(slim(df, id_col, text_col, carry), schema, lambda: measure)
    bits = " | ".join(f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END" for k, rule in enumerate(RULES.values()))
    return unslim(measured.withColumn("failed", F.expr(bits)), id_col, carry)


def keeps(policy: Policy):
    """A column over a ledger: whether the policy keeps the document."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """(version, rule, n_failed, n_only): how many documents each rule of a policy rejects, and how many only it rejects.

    The ledger is first counted by its masked bits, at most one row for each set of rules, so what is shuffled doesn't grow with the corpus.
    """
    sets = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    marks = [F.struct(F.lit(name).alias("rule"), F.lit(1 << list(RULES).index(name)).cast("long").alias("bit")) for name in policy.rules]
    each = sets.select("bits", "n", F.explode(F.array(*marks)).alias("mark")).select("bits", "n", "mark.*")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.lit(policy.version).alias("version"),
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def summary(book: DataFrame) -> DataFrame:
    """(any_failed, all_failed, n): the rules that some document fails, those that every document fails, and the number of documents."""
    return book.agg(F.expr("coalesce(bit_or(failed), 0L)").alias("any_failed"), F.expr("coalesce(bit_and(failed), 0L)").alias("all_failed"), F.count("*").alias("n"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~keeps(BASE_POLICY)).alias("base_failed"), keeps(POLICY).alias("kept"), "failed"
    )


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(DISTINCT line) AS n_distinct
      FROM (SELECT r, unnest(ls) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (coalesce(n_lines, 0) - coalesce(n_distinct, 0))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters,
             length(t) - length(regexp_replace(t, '!', '', 'g')) AS n_exclamations
      FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, __BITS__ AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & __BASE__) <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM f
""".replace("__BITS__", " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))).replace("__BASE__", str(BASE_POLICY.mask))

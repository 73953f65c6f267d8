"""Quality rules as a bitmask ledger; DataFrame and SQL functions only.

`ledger` measures every document and evaluates every rule once: one bit per failed rule in
`failed_mask`, the measurements beside it. Versioned policies are masks over these bits, so
`apply_policy` and `ablation` never look at a text again: a policy is one bitwise AND, an
ablation one pass of conditional counts over the masks. No shuffle but for the reports'
final sums.

Words are maximal runs of characters other than ASCII white space. Null text counts as
empty: no words, all measurements 0. Ties and repeated rows: each row is judged alone.
Input columns named like a result column are replaced; other columns are dropped unless
listed in `keep`. Very long texts are measured whole; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"  # fixed values: the characters of [#*$%&|<>]
BLANKS = " \t\n\x0b\f\r"

#: (name, SQL condition on the measurements that makes a document fail). The position is the bit and never changes.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines"),  # one repeated line of three says little
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("many_digits", "100 * n_digits > 30 * word_chars"),
    ("many_words", "n_words > 10000000"),
]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("v1", ("few_words", "repeated_words", "many_symbols", "duplicate_lines")),
        Policy("v2", ("few_words", "repeated_words", "many_symbols", "duplicate_lines", "short_words", "long_words", "many_digits")),
    )
}


def _without(c: Column, chars: str) -> Column:
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def measure(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and measurements: n_words, word_chars, n_symbols, n_digits, n_lines, n_dup_lines, n_repeat_words."""
    d = docs.select("doc_id", *[c for c in keep if c != "doc_id"], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    core = F.btrim("__t", F.lit(BLANKS))
    words = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+", -1))
    d = d.withColumn("__w", words).withColumn("__l", lines)
    d = d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    d = d.withColumn("n_words", F.size("__h").cast("long"))
    solid = _without(F.col("__t"), BLANKS)
    d = d.withColumns(
        {
            "word_chars": F.length(solid).cast("long"),
            "n_symbols": (F.length("__t") - F.length(_without(F.col("__t"), SYMBOLS))).cast("long"),
            "n_digits": (F.length("__t") - F.length(_without(F.col("__t"), "0123456789"))).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            # each 3-word window by the hashes of its words
            "__g": F.when(F.col("n_words") >= 3, F.expr("transform(slice(__h, 1, cast(n_words as int) - 2), (x, i) -> xxhash64(x, __h[i + 1], __h[i + 2]))")).otherwise(F.array().cast("array<long>")),
        }
    )
    d = d.drop("__w", "__l", "__t", "__h")
    # texts whose windows all differ need no sort
    d = d.withColumn("__s", F.expr("case when size(array_distinct(__g)) < size(__g) then array_sort(transform(__g, (x, i) -> struct(x as x, i as i))) else cast(array() as array<struct<x:bigint,i:int>>) end"))
    d = d.withColumn("__p", F.expr("sort_array(transform(filter(__s, (v, k) -> (k > 0 and __s[greatest(k - 1, 0)].x = v.x) or (k < size(__s) - 1 and __s[least(k + 1, size(__s) - 1)].x = v.x)), v -> v.i))"))
    # windows at ascending positions cover min(3, distance to the next) words each, the last 3
    d = d.withColumn("n_repeat_words", F.expr("case when size(__p) = 0 then 0L else aggregate(zip_with(slice(__p, 1, size(__p) - 1), slice(__p, 2, size(__p)), (a, b) -> least(b - a, 3)), 3L, (s, x) -> s + x) end"))
    return d.select("doc_id", *[c for c in keep if c != "doc_id"], "n_words", "word_chars", "n_symbols", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and failed_mask (long): bit k is set if rule k of RULES fails."""
    mask = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, keep).withColumn("failed_mask", mask)


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """Adds kept (boolean) under a policy, and policy_version."""
    return book.withColumn("kept", F.col("failed_mask").bitwiseAND(F.lit(policy.mask).cast("long")) == 0).withColumn("policy_version", F.lit(policy.version))


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that fail only it (so that dropping the rule would keep them), and all failed."""
    hit = F.col("failed_mask").bitwiseAND(F.lit(policy.mask).cast("long"))
    names = [n for n, _ in RULES]
    bits = {r: 1 << names.index(r) for r in policy.rules}
    sums = book.agg(
        F.count("*").alias("n"),
        F.count_if(hit != 0).alias("failed"),
        *[F.count_if(hit.bitwiseAND(F.lit(b).cast("long")) != 0).alias(f"f_{r}") for r, b in bits.items()],
        *[F.count_if(hit == b).alias(f"o_{r}") for r, b in bits.items()],
    )
    rows = ", ".join(f"'{r}', f_{r}, o_{r}" for r in bits)
    return sums.selectExpr("n as n_docs", "failed as n_failed", f"stack({len(bits)}, {rows}) as (rule, n_failed_rule, n_failed_only)")

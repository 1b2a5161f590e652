"""Quality rules: a ledger of measurements and failure bits, policies over it, ablations by bitwise aggregation.

Every rule is evaluated once per document and leaves one bit in ``failed``; the measurements stay beside it.  A policy is
a mask of rules, so a new version or an ablation reads the ledger and never the texts again.  DataFrame functions only.

Null and empty texts measure 0 everywhere and fail ``few_words``.  Null ids are kept, repeated rows are judged one by one,
extra columns are ignored by ``ledger`` and kept by ``apply_policy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
LINE_WITH_WORD = r"[^\x20\x09-\x0D]"

#: Rule name -> condition over the measurements; the bit is the place in this list.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "few_letters": "100 * n_letters < 50 * word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Policy version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {"v1": BASE, "v2": (*BASE, "symbols"), "v3": tuple(RULES)}


def mask_of(rules: tuple[str, ...]) -> int:
    """Bit mask of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _repeat_words(words: str, n: str) -> Column:
    """Words that lie in a 3-word window found at least twice.

    Windows are sorted by 33 bits of hash with their place in the low 31 bits; only those with an equal neighbour are
    compared as strings, so the count is exact.  n log n for any length.
    """
    gram = f"concat_ws(' ', {words}[i], {words}[i + 1], {words}[i + 2])"
    packed = (f"sort_array(transform(sequence(0, {n} - 3), i -> (xxhash64({words}[i], {words}[i + 1], {words}[i + 2])"
              " & -2147483648L) | i))")
    twins = ("filter({v}, (x, j) -> (j > 0 AND {k} = {p}) OR (j + 1 < size({v}) AND {k} = {q}))")
    like = twins.format(v="s", k="shiftright(x, 31)", p="shiftright(s[j - 1], 31)", q="shiftright(s[j + 1], 31)")
    same = twins.format(v="e", k="x.g", p="e[j - 1].g", q="e[j + 1].g")
    places = f"transform(array({packed}), s -> transform({like}, x -> cast(x & 2147483647L AS int)))[0]"
    exact = (f"transform(array(sort_array(transform(c, i -> struct({gram} AS g, i AS i)))), e -> "
             f"sort_array(transform({same}, x -> x.i)))[0]")
    covered = ("aggregate(transform(r, (x, j) -> if(j + 1 < size(r), least(3, r[j + 1] - x), 3)), 0L, (a, x) -> a + x)")
    return F.expr(f"CASE WHEN {n} < 4 THEN 0L ELSE transform(array({places}), c -> CASE WHEN size(c) = 0 THEN 0L ELSE "
                  f"transform(array({exact}), r -> {covered})[0] END)[0] END")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` as the struct ``__row``, and the measurements of ``text``."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    split = (docs.select(row.alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
             .withColumn("__w", F.array_remove(F.split("__t", WORD_GAP), ""))
             .withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(LINE_WITH_WORD)))
             .withColumn("__n", F.size("__w")))
    measures = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _repeat_words("__w", "__n").alias("n_repeat_words"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"\p{L}+", ""))).cast("long").alias("n_letters"),
    )
    # a generator between measuring and judging: a filter on the verdict is not pushed down into copies of the measures
    return split.select("__row", F.inline(F.array(measures)))


def _failed() -> Column:
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, measurements and the mask ``failed`` of all rules it fails."""
    m = measured(docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")), "__text")
    return m.select(F.col("__row.__id").alias(id_col), *(c for c in m.columns if c != "__row")).withColumn("failed", _failed())


def with_policy(rows: DataFrame, version: str = "v3") -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under a policy version."""
    base, mask = mask_of(BASE), mask_of(POLICIES[version])
    return rows.withColumns({
        "base_failed": F.col("failed").bitwiseAND(F.lit(base)) != 0,
        "kept": F.col("failed").bitwiseAND(F.lit(base | mask)) == 0,
    })


def apply_policy(docs: DataFrame, version: str = "v3", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, columns unchanged."""
    return with_policy(measured(docs, text).withColumn("failed", _failed()), version).filter("kept").select("__row.*")


def ablation(rows: DataFrame, version: str = "v3") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it.

    One pass over the ledger: counts by distinct mask first (at most 2 ** rules rows), then bitwise tests on those.
    """
    mask = mask_of(POLICIES[version])
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
                      for r in POLICIES[version]])
    per = counts.withColumn("r", F.explode(rules)).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return per.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & rest, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_or("bits").alias("seen_bits"))

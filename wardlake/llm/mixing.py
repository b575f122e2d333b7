"""Mixing of sources to target weights: hash-random order inside every source, cut at the source's exact budget.

Targets: the sources, by code point with null last, take the weights in turn; together they share ``percent`` of all
words. A source stops at ``epochs`` times its words and the excess is shared anew by weight. The end of that resharing
is a common level: sorted by the level at which they are full, the sources full below the common level get their cap,
the others level times weight. Running sums over the sorted sources find it in one pass, in whole numbers.

Documents: every row gets a key from a hash of its id and the seed; the rows are range-sorted by (source, key), so a hot
source spreads over many tasks, and prefix sums of the word counts over the partitions tell where each document lies in
its source. The budget is the target without its fraction. Whole epochs are taken first, the rest is cut from the front
of the sorted source, inside a document if need be. So every source's taken words are its budget exactly.

All of it is DataFrame work. Only per-source rows are joined to documents: those of the largest sources by a broadcast
of at most ``HOT_SHARE`` rows, the others by a shuffle.

Defined results: a null text has no words; rows without a source form the last source; rows without doc_id are mixed
like others; equal rows count each, and which of them is cut is left open, as they can't be told apart; documents
without words and sources without words take nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.joins import HOT_SHARE, hot_join
from wardlake.scale import sorted_running
from wardlake.session import materialize

WEIGHTS = (5, 2, 1)
# All sources together share this many hundredths of their words.
PERCENT = 150
# A source is repeated at most this often.
EPOCHS = 2
SEED = "mix-1"

WORD = r"[^\x20\x09-\x0D]+"
# Wide enough for words x weights x hundredths at any table size.
WIDE = "decimal(38,0)"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``target``: its share in words, a double."""
    every = F.array(*[F.lit(int(w)) for w in weights])
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = sorted_running(sources, [], by_name, {"__rank": F.lit(1).cast("bigint")}, "mix-sources").drop("__part")
    weighed = ranked.withColumn("__weight", F.element_at(every, F.pmod(F.col("__rank") - 1, F.lit(len(weights))).cast("int") + 1))
    cap, weight = (F.col("source_size") * epochs).cast("decimal(19,0)"), F.col("__weight").cast("decimal(10,0)")
    full_at = (cap * (F.lit(math.lcm(*weights)) / F.col("__weight")).cast("decimal(10,0)")).cast(WIDE)
    level = [full_at, F.col("__rank")]
    sums = {"__caps": cap.cast(WIDE), "__weights": weight.cast(WIDE)}
    filled = sorted_running(weighed.withColumn("__full_at", full_at), [], level, sums, "mix-levels").drop("__part")
    all_weights, total = (int(x or 0) for x in filled.agg(F.max("__weights"), F.sum("source_size")).first())
    left_weight = (F.lit(all_weights) - F.col("__weights") + weight).cast("decimal(17,0)")
    left_words = (F.lit(total * percent) - (F.col("__caps") - cap) * F.lit(100)).cast("decimal(26,0)")
    full = (cap * left_weight).cast("decimal(35,0)") * F.lit(100) < left_words * weight
    marked = materialize(filled.withColumn("__full", full), "mix-full")
    full_caps, open_weight = marked.agg(F.sum(F.when(F.col("__full"), cap)), F.sum(F.when(~F.col("__full"), weight))).first()
    words = float(total * percent - int(full_caps or 0) * 100)
    share = F.col("__weight").cast("double") * F.lit(words) / F.lit(float(open_weight or 1) * 100.0)
    target = F.when(F.col("__full"), cap.cast("double")).otherwise(share)
    return marked.select(*sources.columns, target.alias("target"))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _clipped(words: Column, most: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(words, most))


def _planned(docs: DataFrame, carried: Sequence[str], weights: Sequence[int], percent: int, epochs: int, seed: str) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    rows = materialize(
        docs.select(
            doc_id.alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            _source_key(F.col("source").cast("string")).alias("__source"),
            n_words(F.col("text")).alias("size"),
            F.conv(F.substring(drawn, 1, 15), 16, 10).cast("bigint").alias("__key"),
            F.monotonically_increasing_id().alias("__row"),
            *carried,
        ),
        "mix-rows",
    )
    by_source = materialize(
        rows.groupBy("__source", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows")), "mix-sizes"
    )
    n_rows = by_source.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    aimed = targets(by_source, weights, percent, epochs)
    order = [F.col(c) for c in ("__key", "doc_id", "size", "__row")]
    laid = sorted_running(rows, ["__source"], order, {"__upto": F.col("size")}, "mix-sorted").drop("__part")
    hot = F.col("__rows") * HOT_SHARE >= F.lit(n_rows)
    placed = hot_join(laid, aimed, ["__source"], hot, ["source_size", "target"])
    budget = F.floor("target")
    nothing = F.col("source_size") == 0
    turns = F.when(nothing, 0).otherwise(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))))
    turns = turns.cast("bigint")
    rest = _clipped(budget - turns * F.col("source_size") - (F.col("__upto") - F.col("size")), F.col("size"))
    return placed.withColumn("taken", (turns * F.col("size") + rest).cast("bigint"))


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED
) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    return _planned(docs, [], weights, percent, epochs, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixture(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED
) -> DataFrame:
    """The mix itself: a row (doc_id, source, epoch from 1, text, words) for every time a document is taken.

    A document at the cut keeps its first ``words`` words with the space before each of them.
    """
    plan = _planned(docs, ["text"], weights, percent, epochs, seed).select("doc_id", "source", "text", "size", "taken")
    turns = plan.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    words = _clipped(F.col("taken") - (F.col("epoch") - 1) * F.col("size"), F.col("size"))
    head = F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), 0), 1, F.col("words").cast("int"))
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(head, ""))
    return turns.withColumn("words", words).where("words > 0").select("doc_id", "source", "epoch", text.alias("text"), "words")


MIXED_SQL = rf"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
           ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
    FROM documents
), sizes AS (
    SELECT source, sum(size)::HUGEINT AS s FROM d GROUP BY source
), weighed AS (
    SELECT source, s, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS w FROM sizes
), levels AS (
    SELECT *, coalesce(sum(2 * s) OVER before, 0)::HUGEINT AS caps, sum(w) OVER onward::HUGEINT AS open_w, sum(s) OVER ()::HUGEINT AS total
    FROM weighed
    WINDOW before AS (ORDER BY 2 * s * 10 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           onward AS (ORDER BY 2 * s * 10 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), marked AS (
    SELECT *, 200 * s * open_w < (150 * total - 100 * caps) * w AS is_full FROM levels
), aimed AS (
    SELECT source, s, CASE WHEN is_full THEN (2 * s)::DOUBLE
        ELSE w::DOUBLE * (150 * total - 100 * coalesce(sum(2 * s) FILTER (is_full) OVER (), 0))::DOUBLE
             / ((sum(w) FILTER (NOT is_full) OVER ())::DOUBLE * 100.0) END AS target
    FROM marked
), placed AS (
    SELECT d.*, s::BIGINT AS source_size, target, floor(target)::BIGINT AS budget,
           sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
    FROM d JOIN aimed ON d.source IS NOT DISTINCT FROM aimed.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - (upto - size))) END::BIGINT AS taken
FROM placed
"""

"""Filter interaction audit: what every order of applying a set of filters removes at every step.

A document fails a set of filters, its mask. Documents are counted by part and mask; all orders are
then walked at once on the lattice of filter subsets. A state is the set of filters already applied, an
edge applies one more. Forward counts say how many orders reach a state, backward counts how many leave
it for the full set. What an edge removes is the same in every order that uses it, so Shapley sums are
edge removals weighted by forward times backward counts, and the steps of an order are read off the same
edges.

The text is read once. Texts meet only by digest (SHA-256): rows are counted by id and digest, then by
digest, mask and labels, before anything is joined on the digest, so a text that a third of all rows
hold is a handful of rows.

A null text is empty, a null part is the empty string. A row without an id is no duplicate of another
row and makes none; rows that share the smallest id of a text are all kept by the duplicate filter. A
document with several label rows counts as good (toxic) if one of them says so. Without any document the
audit is empty. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
MAX_FILTERS = 6  # the table of orders is broadcast: n! * n rows, 4,320 for six filters


# The filters that look at one text: few words, repeated words, capitals, symbols. They read the measures
# below, which stand in columns of their own, so that a text is split once.
TEXT_FAILURES = {
    "A": f"n_words < {MIN_WORDS}",
    "B": f"100 * n_distinct < {MIN_DISTINCT_PERCENT} * n_words",
    "C": f"100 * (n_chars - n_others) > {MAX_UPPER_PERCENT} * n_chars",
    "D": "symbols",
}


def measured(rows: DataFrame) -> DataFrame:
    """Adds what the text filters look at to rows with a column ``body``."""
    worded = rows.withColumn("words", F.array_remove(F.split("body", SPACE), ""))
    return worded.withColumns({
        "n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words")), "n_chars": F.length("body"),
        "n_others": F.length(F.regexp_replace("body", "[A-Z]+", "")), "symbols": F.col("body").rlike(SYMBOLS),
    })


def _bits(failures: list[Column]) -> Column:
    """One integer, bit i set where the i-th filter fails."""
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0)).cast("int")


def counted_masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters A to E that they fail."""
    rows = measured(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )).select(
        "doc_id", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"),
        _bits([F.expr(f) for f in TEXT_FAILURES.values()]).alias("mask"),
    ).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without an id find no label; their digest as key spreads them over the join.
    key = F.coalesce(F.col("doc_id").cast("string"), F.hex("digest"))
    texts = (
        rows.withColumn("key", key).join(marked, "key", "left")
        .groupBy("digest", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"),
                 F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
             F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_no_id"))
    )
    texts = cut_lineage(texts)  # one row per text, mask and labels; read twice
    firsts = texts.groupBy("digest").agg(F.min("first").alias("smallest"))
    kept = F.col("n_no_id") + F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    duplicate = 1 << len(TEXT_FAILURES)
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), kept.alias("n")),
        F.struct((F.col("mask") + duplicate).alias("mask"), (F.col("n") - kept).alias("n"))))
    return (
        texts.join(firsts, "digest").select("part", "good", "toxic", split.alias("of")).where("of.n > 0")
        .groupBy("part", F.col("of.mask").alias("mask"))
        .agg(F.sum("of.n").alias("n"),
             F.sum(F.when(F.col("good"), F.col("of.n")).otherwise(0)).alias("good"),
             F.sum(F.when(F.col("toxic"), F.col("of.n")).otherwise(0)).alias("toxic"))
    )


def path_counts(n_filters: int) -> tuple[list[int], list[int]]:
    """How many orders reach each state from the empty set, and leave it for the full set."""
    full = 1 << n_filters
    forward, backward = [0] * full, [0] * full
    forward[0] = backward[full - 1] = 1
    for state in range(1, full):
        forward[state] = sum(forward[state ^ 1 << f] for f in range(n_filters) if state >> f & 1)
    for state in range(full - 2, -1, -1):
        backward[state] = sum(backward[state | 1 << f] for f in range(n_filters) if not state >> f & 1)
    return forward, backward


def edge_flows(counts: DataFrame, n_filters: int) -> DataFrame:
    """Per part, state and next filter: what the edge removes and what it leaves; zeros included."""
    forward, backward = path_counts(n_filters)
    bit = F.expr("shiftleft(1, filter)")
    edges = (
        counts.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))))
        .withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n_filters - 1))))
        .withColumn("bit", bit).where("state & bit = 0")
    )
    fails, seen = F.expr("mask & bit != 0"), F.expr("mask & state != 0")

    def total(condition: Column, column: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0)).cast("long")

    flows = edges.groupBy("part", "state", "filter", "bit").agg(
        total(F.expr("mask & (state | bit) = 0")).alias("kept"),
        total(fails & ~seen).alias("removed"),
        total(fails & seen).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~seen, "good").alias("good_lost"),
        total(fails & ~seen, "toxic").alias("toxic_lost"),
    )
    reach = F.element_at(F.lit(forward), F.col("state") + 1)
    leave = F.element_at(F.lit(backward), F.expr("state | bit") + 1)
    weighted = F.sum((reach * leave).cast("long") * F.col("removed")).over(Window.partitionBy("part", "filter"))
    return flows.withColumn("shapley", weighted.cast("long"))


def audit(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from documents counted by mask.

    ``filters`` names the bits of ``mask`` from the lowest, at most ``MAX_FILTERS`` of them.
    """
    if not 0 < len(filters) <= MAX_FILTERS:
        raise ValueError(f"an audit takes 1 to {MAX_FILTERS} filters")
    steps = []
    for order in permutations(range(len(filters))):
        name = "".join(filters[f] for f in order)
        steps += [(name, i + 1, sum(1 << f for f in order[:i]), f) for i, f in enumerate(order)]
    assert len(steps) == math.factorial(len(filters)) * len(filters)
    walked = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    return edge_flows(counts, len(filters)).join(F.broadcast(walked), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
        "toxic_lost", "shapley")


# The same rows by walking every order on its own: documents counted by mask, then 120 x 5 prefixes.
AUDIT_SQL = r"""
WITH raw AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
), worded AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM raw
), marked AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masks AS (
  SELECT w.part, coalesce(m.good, false) AS good, coalesce(m.bad, false) AS bad,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * len(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY sha256(body)) THEN 16 ELSE 0 END AS mask
  FROM worded w LEFT JOIN marked m ON w.doc_id = m.doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM masks GROUP BY part, mask
), filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS state
  FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step)
), walked AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (state | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit != 0 AND mask & state = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit != 0 AND mask & state != 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit != 0 AND mask & state = 0), 0) AS good_lost,
    coalesce(sum(bad) FILTER (mask & bit != 0 AND mask & state = 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM walked
"""

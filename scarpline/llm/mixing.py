"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: the sources share the sum of all sizes by weight; no target exceeds ``MAX_REPEATS`` times
its source's size, and what a source cannot take is shared by weight among the others.

Quotas: Sainte-Laguë gives the mix, in equal blocks of one word, block after block to the highest
quotient target / (2 seats + 1), so a source of a few words gets its share like any other. The same seats
follow without a loop: rounding at a slightly too large divisor gives almost all of them, and only the few
next quotients compete for the rest. A source is dealt over shards of about ``SHARD_WORDS`` words or
``SHARD_ROWS`` rows, and its quota is apportioned to them the same way, so no task sees more than a shard
of the largest source.

Selection: the documents of a shard, in seeded order, are one stream of words in runs of ``BLOCK``. A quota
is some whole rounds through the stream and a rest; the rest falls on the runs that a seeded affine
permutation of their numbers puts first, on the last of them in part. Both are arithmetic on a document's
place in the stream: no row per run is made.

Size is the number of ``[^\\x20\\x09-\\x0D]+`` in the text; null text counts 0 words. The null source
is a source of its own. Empty documents take 0 words; an empty table gives an empty result. Rows that
repeat an id are documents of their own. Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.session import cut_lineage

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK = 64
SHARD_WORDS = 1 << 21
SHARD_ROWS = 1 << 13
SEED = 20261
# Strides of the block permutation; a prime stride visits every block unless it divides their number.
STRIDES = (1000003, 998244353)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sources: DataFrame) -> DataFrame:
    """Per source (one row each): weight, target. ``sources`` has source, source_size.

    Sources whose limit is lowest against their weight reach it first. In that order, source k is
    limited if the level that the rest would share were above its ratio.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight.cast("double")).withColumn(
        "limit", F.col("source_size").cast("double") * MAX_REPEATS)
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("level", level)
    # The level rises up to the first source that stays below its limit, and falls behind it.
    share = F.max("level").over(whole) * F.col("weight")
    return levelled.withColumn("target", F.least(F.col("limit"), share)).select(
        "source", "source_size", "weight", "target")


def apportion(units: DataFrame, claim: str, seats: str, most: str, group: list[str]) -> DataFrame:
    """Adds ``quota``: Sainte-Laguë seats of every unit in its group.

    ``claim`` is the unit's claim, ``seats`` the group's number of seats (the same on all its rows),
    ``most`` the largest number of seats the unit may get. With n units in the group, the divisor for
    ``seats - n/2`` gives between n too few and just enough seats, that for ``seats + n/2`` between
    enough and n too many: each unit competes only with the quotients between the two, at most two
    per unit on average. Ties go to the larger claim, then to the unit's name.
    """
    whole = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(whole), F.sum(claim).over(whole)

    def rounded(places: Column) -> Column:
        share = F.when(total > 0, F.col(claim) / total * places).otherwise(0.0)
        return F.least(F.floor(share + 0.5), F.col(most)).cast("long")

    half = n / F.lit(2.0)
    names = [c for c in units.columns if c not in (claim, seats, most)]
    based = units.withColumns({
        "__low": rounded(F.greatest(F.col(seats) - half, F.lit(0.0))),
        "__high": rounded(F.col(seats) + half) + 1,
    }).withColumn("__left", F.col(seats) - F.sum("__low").over(whole))
    rivals = based.withColumn(
        "__seat", F.explode(F.sequence(F.col("__low") + 1, F.greatest("__high", F.col("__low") + 1)))
    ).where(F.col("__seat") <= F.col(most))
    order = Window.partitionBy(*group).orderBy(
        (F.col(claim) / (2 * F.col("__seat") - 1)).desc(), F.col(claim).desc(), *names)
    won = rivals.withColumn("__rank", F.row_number().over(order)).where("__rank <= __left")
    extra = won.groupBy(*[F.col(c).alias(f"__won_{c}") for c in names]).agg(F.count(F.lit(1)).alias("__extra"))
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"__won_{name}"))
    return based.join(extra, same, "left").select(
        *units.columns,
        (F.col("__low") + F.coalesce("__extra", F.lit(0))).cast("long").alias("quota"))


def _stride(blocks: Column) -> Column:
    first, second = STRIDES
    return F.when(F.pmod(blocks, F.lit(first)) != 0, F.lit(first)).otherwise(F.lit(second)).cast("long")


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shard_words: int = SHARD_WORDS,
        shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and how the taken words lie.

    ``rounds`` whole copies, then :func:`chosen_words` of each run ``first_block .. last_block`` of the
    shard's stream, in which the document starts at word ``begin``.
    """
    text = F.col("text").cast("string")
    sized = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", text).alias("place"),
    ))
    # One row per source; shards of a source follow its size.
    counted = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = _targets(counted).join(
        counted.select(F.col("source").alias("__source"), "n_rows"), F.col("source").eqNullSafe(F.col("__source"))
    ).drop("__source")
    seated = sources.withColumns({
        "seats": F.sum("source_size").over(Window.partitionBy()), "most": F.col("source_size") * MAX_REPEATS,
        "__all": F.lit(0)})
    given = apportion(
        seated.select("source", "__all", "target", "seats", "most"), "target", "seats", "most", ["__all"])
    shards = F.greatest(F.floor(F.col("source_size") / F.lit(shard_words)), F.floor(F.col("n_rows") / F.lit(shard_rows)))
    plan = cut_lineage(given.select(F.col("source").alias("__source"), F.col("quota").alias("seats")).join(
        sources, F.col("__source").eqNullSafe(F.col("source"))).drop("__source").withColumn(
        "shards", (shards + 1).cast("long")).drop("n_rows"))

    facts = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    dealt = sized.join(facts, sized.source.eqNullSafe(F.col("__source"))).select(
        "doc_id", "source", "size", "place", F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), F.col("__seats").alias("seats"),
        F.pmod(F.col("place"), F.col("__shards")).alias("shard"))
    shards = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("words"), F.first("seats").alias("seats"))
    quotas = apportion(
        shards.withColumn("claim", F.col("words").cast("double")).withColumn("most", F.col("words") * MAX_REPEATS)
        .select("source", "shard", "claim", "seats", "most"), "claim", "seats", "most", ["source"])
    chosen = quotas.select(
        F.col("source").alias("__source"), F.col("shard").alias("__shard"), "quota",
        F.col("claim").cast("long").alias("words"), F.ceil(F.col("claim") / F.lit(block)).cast("long").alias("blocks"),
    ).withColumns({
        "rounds": F.when(F.col("words") > 0, F.expr("quota div words")).otherwise(0).cast("long"),
        "stride": _stride(F.col("blocks")),
        "shift": F.pmod(F.xxhash64(F.lit(seed), "__source", "__shard"), F.greatest("blocks", F.lit(1))),
    }).withColumn("rest", F.col("quota") - F.col("rounds") * F.col("words")).drop("quota")

    stream = Window.partitionBy("source", "shard").orderBy("place", "doc_id")
    placed = dealt.withColumn("begin", F.sum("size").over(stream) - F.col("size")).drop("seats")
    joined = placed.join(
        chosen, placed.source.eqNullSafe(F.col("__source")) & (placed.shard == F.col("__shard"))
    ).drop("__source", "__shard").withColumns({
        "first_block": F.floor(F.col("begin") / F.lit(block)).cast("long"),
        "last_block": F.floor((F.col("begin") + F.greatest("size", F.lit(1)) - 1) / F.lit(block)).cast("long"),
    })
    covered = F.aggregate(
        F.sequence("first_block", "last_block"), F.lit(0).cast("long"),
        lambda sum_, b: sum_ + F.greatest(
            F.least(F.col("begin") + F.col("size"), b * block + chosen_words(b, block, F.col))
            - F.greatest(F.col("begin"), b * block), F.lit(0)))
    taken = F.col("rounds") * F.col("size") + F.when(
        (F.col("rest") > 0) & (F.col("size") > 0), covered).otherwise(0)
    return joined.withColumn("taken", taken.cast("long"))


def chosen_words(run: Column, block: int, of) -> Column:
    """How many words at the head of this run of the shard are in the rest.

    The permutation's order is a row of runs of ``block`` words, all whole but the stream's last one;
    ``of`` gives the columns words, blocks, stride, shift and rest by name.
    """
    def place(number: Column) -> Column:
        return F.pmod(number * of("stride") + of("shift"), of("blocks"))

    gap = of("blocks") * block - of("words")  # what the stream's last run lacks
    before = place(run) * block - F.when(place(run) > place(of("blocks") - 1), gap).otherwise(0)
    size = F.least(F.lit(block), of("words") - run * block)
    return F.least(F.greatest(of("rest") - before, F.lit(0)), size)


def mixed_documents(docs: DataFrame, seed: int = SEED, block: int = BLOCK,
                    shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies of a document, then its chosen words.

    Chosen words of a partial copy keep the white space behind them, as in the text; documents that take
    nothing leave.
    """
    decided = mix(docs, seed, block, shard_words, shard_rows).where("taken > 0")
    key = ["__id", "__place"]
    none = F.lit(-(1 << 63))
    # Rows that repeat id and text share a key; each gets one of the key's decisions.
    facts = decided.select(
        F.coalesce("doc_id", none).alias("__id"), F.col("place").alias("__place"), F.struct(
            "size", "taken", "begin", "rounds", "rest", "stride", "shift", "blocks", "words").alias("__mix")
    ).groupBy(*key).agg(F.sort_array(F.collect_list("__mix")).alias("__mixes"))
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select("*", F.coalesce(doc_id, none).alias("__id"), F.xxhash64(F.lit(seed), doc_id, text).alias("__place"))
    same = Window.partitionBy(*key).orderBy(F.lit(1))
    met = keyed.withColumn("__row", F.row_number().over(same)).join(facts, key)
    one = met.withColumn("__mix", F.try_element_at("__mixes", F.col("__row"))).where("__mix is not null")
    m = F.col("__mix")

    def inside(_: Column, i: Column) -> Column:
        at = m["begin"] + i
        run = F.floor(at / F.lit(block)).cast("long")
        return at - run * block < chosen_words(run, block, lambda name: m[name])

    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(m["rounds"], F.lit(1).cast("long"))),
                        lambda _: text)
    copies = F.when(m["rounds"] > 0, whole).otherwise(F.array().cast("array<string>"))
    part = F.when(
        m["taken"] > m["rounds"] * m["size"],
        F.array(F.regexp_replace(F.array_join(F.filter(
            F.regexp_extract_all(text, F.lit(WORD + GAP), F.lit(0)), inside), ""), GAP + "$", ""))
    ).otherwise(F.array().cast("array<string>"))
    given = one.withColumn("text", F.explode(F.concat(copies, part)))
    return given.select(*docs.columns)

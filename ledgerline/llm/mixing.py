"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, word_count

#: Weights by rank of the source, repeating, and the slope of each one's schedule.
WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
#: Documents of one source are cut into 16**digits hash ranges for the running sums, so that a range has about this many documents at most.
RANGE = 100_000


def source_targets(stats: DataFrame, budget_share: float = 1.5, max_repeat: int = 2, weights=WEIGHTS, slopes=SLOPES) -> DataFrame:
    """(skey, source_size, target, slope) from ``stats`` (skey, source, words).

    Water filling in closed form: sources sorted by the level at which they
    reach ``max_repeat`` times their size; those below the common level are
    capped. One row for each source, so the global windows stay small.
    """
    n = len(weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(by_name) - 1) % n + 1
    ranked = stats.select("skey", "words", kind.alias("k")).select(
        "skey", "words",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("k")).alias("w"),
        F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), F.col("k")).alias("slope"),
        (F.col("words") * float(max_repeat)).alias("cap"),
    )
    every = W.partitionBy(F.lit(1))
    level = every.orderBy(F.col("cap") / F.col("w"), "skey")
    before = level.rowsBetween(W.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        ((F.sum("words").over(every) * float(budget_share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("lam"),
    )
    free = F.col("lam") < F.col("cap") / F.col("w")
    common = F.min_by(F.when(free, F.col("lam")), F.when(free, F.col("cap") / F.col("w"))).over(every)
    return filled.select("skey", F.col("words").alias("source_size"), F.least("cap", F.coalesce(common * F.col("w"), F.col("cap"))).alias("target"), "slope")


def _demand_inverse(u: Column, slope: Column) -> Column:
    """The time at which the integral of (1 - slope) + 2 * slope * t reaches ``u``."""
    flat = 1 - slope
    return 2 * u / (flat + F.sqrt(flat * flat + 4 * slope * u))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", *, carry: list[str] | None = None, budget_share: float = 1.5, max_repeat: int = 2, cut_last: bool = True) -> DataFrame:
    """Choose how many words of each document the mix takes and when in training they come.

    Returns the ``carry`` columns (the id alone by default) and ``__mix``, a
    struct: size, source_size, target, taken, copies (array of copy, words,
    position), first_position. Within a source, documents lie in hash order on
    a tape of ``max_repeat`` passes; the mix takes the first ``target`` words of
    that tape. With ``cut_last`` the copy that crosses the target is taken in
    part, so a source gives exactly its rounded target; without it, that copy
    is taken whole if its middle is before the target. A copy's position in
    [0, 1] is where its source's integrated schedule reaches the copy's middle.

    Null sources are one source, sorted last; null or empty texts have size 0
    and are never taken; rows without id lie on the tape by their text; equal
    rows are separate documents whose order among themselves does not matter;
    texts may be of any length; other columns than ``carry`` can't clash; an
    empty table gives an empty result. Sources are ranked in one task, a row each.
    """
    carry = [doc_id] if carry is None else carry
    name, body, origin = (F.col(f"`{c}`") for c in (doc_id, text, source))
    # rows without id lie by their text
    ident = F.coalesce(name.cast("string"), F.md5(F.coalesce(body, F.lit(""))))
    order = F.md5(ident)
    digits = min(8, max(3, math.ceil(math.log(max(1, docs.count() / RANGE), 16))))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"),
        F.coalesce(F.concat(F.lit("s"), origin), F.lit("n")).alias("skey"),
        origin.alias("source"),
        order.alias("ord"),
        ident.alias("ident"),
        F.conv(F.substring(order, 1, digits), 16, 10).cast("long").alias("b"),
        word_count(body).alias("size"),
    )
    ranges = materialize(sized.groupBy("skey", "source", "b").agg(F.sum("size").alias("words")), "mix-ranges")
    targets = source_targets(ranges.groupBy("skey", "source").agg(F.sum("words").alias("words")), budget_share, max_repeat)
    offsets = ranges.select(
        "skey", "b",
        F.coalesce(F.sum("words").over(W.partitionBy("skey").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    ).join(targets, "skey")
    within = W.partitionBy("skey", "b").orderBy("ord", "ident", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.join(offsets, ["skey", "b"]).select(
        "__row", "size", "source_size", "target", "slope",
        (F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("at"),
        F.round("target").cast("long").alias("goal"),
    )

    def words_of(p: Column) -> Column:
        left = F.col("goal") - (p * F.col("source_size") + F.col("at"))
        if cut_last:
            return F.greatest(F.lit(0).cast("long"), F.least("size", left))
        return F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))

    def copy(p: int) -> Column:
        words = words_of(F.lit(p))
        middle = (p * F.col("source_size") + F.col("at") + words / 2) / F.greatest("goal", F.lit(1))
        position = F.least(F.lit(1.0), _demand_inverse(F.least(F.lit(1.0), middle), F.col("slope")))
        return F.struct(F.lit(p).alias("copy"), words.alias("words"), position.alias("position"))

    made = placed.select("__row", "size", "source_size", "target", F.filter(F.array(*[copy(p) for p in range(max_repeat)]), lambda c: c["words"] > 0).alias("copies"))
    return made.select(
        "__row.*",
        F.struct(
            "size", "source_size", "target",
            F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
            "copies",
            F.array_min(F.transform("copies", lambda c: c["position"])).alias("first_position"),
        ).alias("__mix"),
    )


def by_position(mixed: DataFrame, *ties: str) -> DataFrame:
    """The mixed documents range-sorted by their first training position; documents not taken come last."""
    keys = [F.col("__mix.first_position").asc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]]
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken, range-sorted by its own position (column ``__copy``: copy, words, position)."""
    keep = [c for c in mixed.columns if c != "__mix"]
    rows = mixed.select(*keep, F.explode("__mix.copies").alias("__copy"))
    keys = [F.col("__copy.position"), F.col("__copy.copy")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by (source, leading hash bits); a cumulative sum over the histogram finds the bucket in which a source's
word budget ends; only that boundary bucket is refined by the next bits, level after level. The mix is then a filter on the
hash: nothing is sorted and reruns agree. One more document, the nearest in size to what the threshold leaves, fills the rest.
A source that should give more than all it has is taken whole, floor(target/size) times, and the rest of its budget by the
threshold. What is decided is one row a source, joined to the documents where they lie: texts are never shuffled for it.

Defined results: a null text has size 0; null sources form one source that comes last; rows with equal ids share a hash and
are taken together if their sizes agree (the same id in two sources is two documents); a null id is hashed like any value; an
empty table gives an empty result; sources without words get target 0. Other columns of the input are ignored by ``mix`` and
kept by ``mixed``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabshift.llm.common import discard, staged, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
BITS, HALF, LEVELS = 12, 6, 4


def _prefix(level: int) -> Column:
    """The hash's first ``level * BITS`` bits."""
    return F.shiftrightunsigned(F.col("h"), 64 - BITS * level)


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of (source, source_size) rows: ``share`` of all sizes dealt by weight, none above ``most`` times its size.

    The fixed point of resharing is one level L with target = min(most * size, L * weight): sources sorted by the level at
    which they fill up, the first that does not fill at the level of those left gives L. One row per source goes through
    the one window.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("fills", F.col("most") / F.col("weight"))
    by = Window.orderBy("fills", F.col("source").asc_nulls_last())
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", level)
    common = F.min(F.when(F.col("fills") >= F.col("level"), F.struct("fills", "level"))).over(everything)["level"]
    return leveled.withColumn("target", F.least(F.col("most"), F.coalesce(common, F.col("fills")) * F.col("weight"))).select("source", "source_size", "target")


def _pick(cells: DataFrame) -> DataFrame:
    """The cell of each source in which its rest is reached, and the rest within it: (source, at, rest). A source has 2^HALF cells at most."""
    w = Window.partitionBy("source").orderBy("at")
    reached = cells.withColumn("upto", F.sum("words").over(w)).filter(F.col("upto") >= F.col("rest"))
    first = reached.groupBy("source").agg(F.min(F.struct("at", "upto", "words", "rest")).alias("b"))
    return first.select("source", F.col("b.at").alias("at"), (F.col("b.rest") - F.col("b.upto") + F.col("b.words")).alias("rest"))


def _boundary(hist: DataFrame) -> DataFrame:
    """The boundary bucket of each source, found by halves of its bits so that no window sees more than 2^HALF rows of a source."""
    coarse = _pick(hist.groupBy("source", F.shiftright("at", HALF).alias("at")).agg(F.sum("words").alias("words"), F.max("rest").alias("rest")))
    b = coarse.select(F.col("source").alias("b_source"), F.col("at").alias("b_at"), F.col("rest").alias("b_rest"))
    inside = hist.join(b, hist["source"].eqNullSafe(b["b_source"]) & (F.shiftright(hist["at"], HALF) == b["b_at"]))
    return _pick(inside.select("source", "at", "words", F.col("b_rest").alias("rest")))


def _size(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def decisions(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row a source: (source, source_size, target, whole, rest, ends, filler_h, filler_size), from rows (source, size, h).

    A document is taken ``whole`` times, and once more if it is no larger than ``rest`` and its hash lies below ``ends`` (null: any
    hash), or if it is the filler.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = source_targets(totals, weights, share, most).withColumn("whole", F.least(whole, F.lit(int(most))))
    rest = F.when(F.col("whole") >= int(most), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    targets = staged(targets.withColumn("rest", rest), "mix-targets")

    def met(rows: DataFrame, by_source: DataFrame, *keys: Column) -> DataFrame:
        """Rows with their source's row; no source is one key."""
        named = by_source.withColumnRenamed("source", "s_source")
        on = rows["source"].eqNullSafe(named["s_source"])
        for k in keys:
            on = on & k
        return rows.join(named, on).drop("s_source")

    # a document larger than a source's rest can't be within it and must not stop the threshold
    within = met(sized.select("source", "size", "h"), targets.select("source", "rest").filter("rest > 0")).filter("size > 0 and size <= rest")
    hist = staged(within.groupBy("source", _prefix(1).alias("at")).agg(F.sum("size").alias("words"), F.max("rest").alias("rest")), "mix-hist")
    sums = hist.groupBy("source").agg(F.sum("words").alias("sum"))
    bound = staged(_boundary(hist), "mix-bound")
    cell = within.select("source", "size", "h")
    used = [hist]
    for level in range(2, LEVELS + 1):
        # only rows of a boundary bucket go on
        at = bound.withColumnsRenamed({"at": "b_at"})
        cell = staged(met(cell, at, _prefix(level - 1) == at["b_at"]).drop("b_at"), "mix-cell")
        finer = cell.groupBy("source", _prefix(level).alias("at")).agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
        used += [bound, cell]
        bound = staged(_boundary(finer), "mix-bound")
        cell = cell.drop("rest")
    # a last document fills what the threshold leaves: the one nearest to that rest, by one aggregate over the documents beyond
    ends = bound.select(F.col("source").alias("e_source"), F.col("at").alias("ends"), F.col("rest").alias("e_rest"))
    s = sums.select(F.col("source").alias("s_source"), "sum")
    decided = targets.join(ends, targets["source"].eqNullSafe(ends["e_source"]), "left").join(s, targets["source"].eqNullSafe(s["s_source"]), "left")
    left_over = F.when(F.col("ends").isNull(), F.col("rest") - F.coalesce("sum", F.lit(0))).otherwise(F.col("e_rest"))
    decided = staged(decided.select("source", "source_size", "target", "whole", "rest", "ends", left_over.alias("left_over")), "mix-ends")
    beyond = met(sized.select("source", "size", "h"), decided.filter("left_over > 0")).filter((F.col("size") > 0) & ~_below(F.col("size"), F.col("h")))
    nearest = beyond.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left_over")).alias("miss"), "h", "size")).alias("n"), F.max("left_over").alias("n_left"))
    nearest = nearest.filter(F.col("n.miss") <= F.col("n_left")).select(F.col("source").alias("n_source"), F.col("n.h").alias("filler_h"), F.col("n.size").alias("filler_size"))
    out = staged(decided.join(nearest, decided["source"].eqNullSafe(nearest["n_source"]), "left").drop("n_source", "left_over"), "mix-decided")
    discard(targets, bound, decided, *used)
    return out


def _below(size: Column, h: Column, rest: Column | None = None, ends: Column | None = None) -> Column:
    """Whether the threshold takes a document."""
    rest, ends = F.col("rest") if rest is None else rest, F.col("ends") if ends is None else ends
    return (size > 0) & (size <= rest) & (ends.isNull() | (F.shiftrightunsigned(h, 64 - BITS * LEVELS) < ends))


def _times(col: Callable[[str], Column]) -> Column:
    """How often a document is taken, from the columns of its source's decision and its own size and h."""
    filler = (col("h") == col("filler_h")) & (col("size") == col("filler_size"))
    extra = F.when(_below(col("size"), col("h"), col("rest"), col("ends")) | F.coalesce(filler, F.lit(False)), 1).otherwise(0)
    return col("whole") + extra


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_source: bool = False) -> DataFrame:
    """(id, size, source_size, target, taken) for every document: how many of its words the mix takes, repeats counted."""
    sized = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), F.xxhash64(F.col(id_col)).alias("h")), "mix-sized")
    by_source = decisions(sized, weights, share, most).withColumnRenamed("source", "s_source")
    rows = sized.join(by_source, F.col("source").eqNullSafe(F.col("s_source")))
    named = [F.col("source")] if with_source else []
    return rows.select(F.col("id").alias(id_col), *named, "size", "source_size", "target", (F.col("size") * _times(F.col)).alias("taken"))


def mixed(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; a document without words, of which nothing can be taken, stays once."""
    taken = {c.lower() for c in docs.columns}
    fresh = "_mix"
    while any(c.startswith(fresh) for c in taken):
        fresh += "_"
    col = lambda k: F.col(f"{fresh}_{k}")
    sized = staged(docs.select(F.col(source_col).alias("source"), _size(text_col).alias("size"), F.xxhash64(F.col(id_col)).alias("h")), "mix-sized")
    by_source = decisions(sized, weights, share, most)
    discard(sized)
    # the rows stay where they are: a source's one row is joined to them, by broadcast while the sources' table is small
    rows = docs.withColumns({f"{fresh}_size": _size(text_col), f"{fresh}_h": F.xxhash64(F.col(id_col))})
    rows = rows.join(by_source.withColumnsRenamed({c: f"{fresh}_{c}" for c in by_source.columns}), F.col(source_col).eqNullSafe(col("source")))
    times = F.when(col("size") > 0, _times(col)).otherwise(F.lit(1)).cast("int")
    copies = rows.withColumn(f"{fresh}_times", times).filter(col("times") > 0).withColumn(f"{fresh}_times", F.explode(F.sequence(F.lit(1), col("times"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])

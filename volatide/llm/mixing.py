r"""Mixing sources to target weights by Pareto order sampling.

Targets: every source gets its share by weight of `total_share` times all words; a target stops at `ceiling` times
its source's words and the excess is shared again by weight, until none is above (water filling, solved in closed
form over the table of sources).

Copies: with ratio = target / words of the source, every document first gets floor(ratio) certain whole copies. What
is left of the target, a fraction f of the source's words, is met by a fixed-size sample with unequal probabilities.
A document's affinity g is a number from 0 to 1: by default size / (size + HALF_WORDS), so longer documents are
likelier; any other column may be given. Its inclusion probability is

    p = f + f (1 - f) (g - mean of g over the source's words)

which is always between 0 and 1 and makes the expected words exactly those that are left. With a uniform number u from
a hash of its id, documents are ranked by Pareto's (u / (1-u)) / (p / (1-p)) and taken from the smallest until the
words left are met; the cut is put where the taken words come nearest to the target. So a document is taken at most
ceil(ratio) <= `ceiling` times. Affinities are rounded down to STEPS-ths, so that sums of them are exact.

Where the cut lies is found without gathering a source: ranks are counted in 256 equal bins per source (partial
sums first), the bin that holds the cut is split again into 256, and so on until it holds few documents; only these
are ordered. So a source with a third of all rows needs no large task.

Defined results: null text has size 0; sources order by code point with null as the last source of its own;
documents of size 0 and documents of sources without words take 0; a null id is replaced by a hash of the text; rows
that share id and size have equal ranks and are taken together or not at all, so that reruns agree; null affinities
count as 0; an empty table gives an empty table; `expand` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volatide.llm.common import WORD, checked_broadcast, cut

BINS = 256
HALF_WORDS = 100
STEPS = 1024
#: Documents around a cut that may be ordered in one task.
LAST_DOCS = 4096


def words(text: Column) -> Column:
    """Number of words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the id (of the text's, where the id is null)."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10)
    return (bits.cast("long").cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, ceiling: float) -> DataFrame:
    """From (source, source_size) to (source, source_size, target). Its windows hold one row a source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    base = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
    base = base.withColumn("cap", F.col("source_size") * float(ceiling))
    # Sources reach their caps in the order of cap / weight as the level rises.
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    goal = F.sum("source_size").over(everything) * float(total_share)
    left = goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    base = base.withColumn("level", level).withColumn("under", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    # The first level under its source's cap holds for that source and all after it.
    base = base.withColumn("level", F.first("under", ignorenulls=True).over(everything))
    return base.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


class Mix:
    """What was decided: a row a source of targets, and the place of its cut."""

    def __init__(self, plan: DataFrame, ends: DataFrame, seed: str, affinity: Column | None):
        self.plan, self.ends, self.seed, self.affinity = plan, ends, seed, affinity


def _measured(docs: DataFrame, seed: str, affinity: Column | None) -> DataFrame:
    """(row: all columns, src, size, u, g) of every row."""
    size = words(F.col("text"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("src"), size.alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), *([] if affinity is None else [affinity.cast("double").alias("a")]))
    if affinity is None:
        return whole.withColumn("g", F.expr(f"size * {STEPS} div (size + {HALF_WORDS})"))
    inside = F.when(F.col("a") >= 1, 1.0).when(F.col("a") > 0, F.col("a")).otherwise(0.0)
    return whole.withColumn("g", F.floor(inside * STEPS).cast("long")).drop("a")


def _ranked(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """With the source's plan and the Pareto rank in (0, 1), null where no sample is needed."""
    joined = measured.join(checked_broadcast(plan), F.col("src").eqNullSafe(F.col("p_source"))).drop("p_source")
    left = F.try_divide(F.col("p_need"), F.col("p_size"))
    p = left + left * (1 - left) * (F.col("g") / STEPS - F.col("p_mean"))
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    live = (F.col("size") > 0) & (F.col("p_need") > 0)
    return joined.withColumn("rank", F.when(live, odds / (1 + odds)))


def decide(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), total_share: float = 1.5, ceiling: float = 2.0, seed: str = "mix", affinity: Column | None = None
) -> Mix:
    measured = cut(_measured(docs, seed, affinity).select("src", "size", "u", "g"))
    mean = F.try_divide(F.sum(F.col("g") * F.col("size")).cast("double"), F.sum("size").cast("double")) / STEPS
    totals = cut(measured.groupBy("src").agg(F.sum("size").alias("source_size"), mean.alias("p_mean")))
    goals = targets(totals.select(F.col("src").alias("source"), "source_size"), weights, total_share, ceiling).withColumnRenamed("source", "p_source")
    plan = goals.join(totals.select("src", "p_mean"), F.col("p_source").eqNullSafe(F.col("src"))).drop("src")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select("p_source", F.col("source_size").alias("p_size"), F.col("target").alias("p_target"), "p_mean", F.floor(ratio).alias("p_whole"))
    plan = cut(plan.withColumn("p_need", F.greatest(F.lit(0.0), F.col("p_target") - F.col("p_whole") * F.col("p_size"))))

    # Narrow the interval that holds each source's cut: `low` is its beginning, `met` words lie before it.
    places = _ranked(measured, plan).where("rank is not null").select("src", "size", "rank")
    edges = plan.select("p_source", F.col("p_need").alias("need"), F.lit(0.0).alias("low"), F.lit(1.0).alias("width"), F.lit(0.0).alias("met"))
    while True:
        inside = places.join(checked_broadcast(edges), F.col("src").eqNullSafe(F.col("p_source"))).where("rank >= low and rank < low + width")
        slot = F.least(F.floor((F.col("rank") - F.col("low")) / F.col("width") * BINS), F.lit(BINS - 1))
        bins = inside.groupBy("p_source", "need", "low", "width", "met", slot.alias("slot")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        running = Window.partitionBy("p_source").orderBy("slot")
        bins = bins.withColumn("upto", F.col("met") + F.sum("words").over(running))
        held = bins.where("upto >= need").groupBy("p_source").agg(F.min_by(F.struct("need", "low", "width", "slot", "words", "upto", "docs"), "slot").alias("b"))
        edges = cut(
            held.select(
                "p_source",
                F.col("b.need").alias("need"),
                (F.col("b.low") + F.col("b.slot") * F.col("b.width") / BINS).alias("low"),
                (F.col("b.width") / BINS).alias("width"),
                (F.col("b.upto") - F.col("b.words")).alias("met"),
                F.col("b.docs").alias("docs"),
            )
        )
        most, widest = edges.agg(F.max("docs"), F.min("width")).first()
        edges = edges.drop("docs")
        if most is None or most <= LAST_DOCS or widest < 1e-14:
            break

    # Order the few documents of the interval. One that would end nearer to the target if left out is left out.
    near = places.join(checked_broadcast(edges), F.col("src").eqNullSafe(F.col("p_source"))).where("rank >= low and rank < low + width")
    # Equal ranks and sizes (repeated rows, however many) are one line here.
    near = near.groupBy("p_source", "need", "met", "rank", "size").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("p_source").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.col("met") + F.coalesce(F.sum("words").over(order), F.lit(0)))
    last = near.where(F.col("before") + F.col("words") / 2 <= F.col("need")).groupBy("p_source").agg(F.max(F.struct("rank", "size")).alias("last"))
    ends = edges.select("p_source", "low").join(last.withColumnRenamed("p_source", "l_source"), F.col("p_source").eqNullSafe(F.col("l_source")), "left")
    return Mix(plan, cut(ends.select(F.col("p_source").alias("e_source"), F.col("low").alias("e_low"), F.col("last").alias("e_last"))), seed, affinity)


def with_copies(docs: DataFrame, mix: Mix) -> DataFrame:
    """(row: all columns, size, p_size, p_target, copies) of every row; texts aren't shuffled while the plan is broadcast."""
    ranked = _ranked(_measured(docs, mix.seed, mix.affinity), mix.plan)
    joined = ranked.join(checked_broadcast(mix.ends), F.col("src").eqNullSafe(F.col("e_source")), "left")
    here = F.struct("rank", "size")
    # A source without an interval needs more words than its ranked documents have: all are taken.
    taken = F.col("e_low").isNull() | (F.col("rank") < F.col("e_low")) | F.coalesce(here <= F.col("e_last"), F.lit(False))
    copies = F.col("p_whole") + F.when(F.col("rank").isNotNull() & taken, 1).otherwise(0)
    return joined.select("row", "size", "p_size", "p_target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of all documents; copies * size = taken.

    An `affinity` is a column over doc_id, source and text.
    """
    done = with_copies(docs.select("doc_id", "source", "text"), decide(docs.select("doc_id", "source", "text"), **options))
    done = done.select("row.doc_id", "row.source", "size", F.col("p_size").alias("source_size"), F.col("p_target").alias("target"), "copies")
    return done.withColumn("taken", F.col("copies") * F.col("size"))


def expand(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    done = with_copies(docs, decide(docs, **options)).where("copies > 0")
    return done.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")

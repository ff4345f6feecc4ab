"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of the budget, at most CAP times the source's size; what the cap cuts
off is shared anew by weight.  A document is wanted target / source size times (times its own weight, if any);
the whole part is taken for certain, the rest is its inclusion probability p.  Documents are ranked by
(u / (1 - u)) / (p / (1 - p)) with u uniform by a hash of doc_id, and taken in that order while the words fit:
the sample has a fixed size in words.  The document that fills the remaining gap best completes it.

Ranks are never formed over a whole source: words are added up per bin of the rank first, and only the bin in
which the target is reached is ordered.

Null texts have size 0.  A null source is a source of its own, last in order.  Rows that repeat a doc_id share
u.  Rows equal in doc_id, source and text are one entry with a number: where the target is reached among them, as many
are taken as fit, and one of them may fill the gap; in `mixed` one of them stands for all there.  Empty tables give
empty results; extra columns are kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import staged

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
CAP = 3
SEED = "mix"
BIN_ROWS = 4096
#: What rows are ordered by; rows alike in it are one entry.
ENTRY = ("key", "doc_id", "size", "mark")


def uniform(seed: str) -> Column:
    """A number in (0, 1) from the first 13 hex digits of md5(seed:doc_id)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, share: float = 1.0, cycle: tuple = CYCLE, cap: int = CAP) -> DataFrame:
    """source, source_size, n, target of `sizes(source, size)`: one row per source.

    Shares are level * weight with the level at which they add up to the budget; sources over the cap lie
    at the cap.  Ordering the sources by size per weight finds the level from running sums.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    ratio = Window.orderBy(F.col("most") / F.col("weight"), "source")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = F.try_divide(
        share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    )
    # The first source that stays below its cap sets the level for itself and all after it.
    below = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    totals = totals.withColumn("level", level).withColumn("level", F.max(below).over(everything))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return totals.select("source", "source_size", "n", target.alias("target"))


def _plan(docs: DataFrame, weight, seed: str, share: float) -> tuple[DataFrame, DataFrame]:
    """Sized rows (all columns and _source, size, _wanted, _key) and the rule of each source."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    own = weight if weight is not None else F.lit(1.0)
    mark = F.xxhash64("text").alias("mark")
    rows = docs.select("doc_id", "source", size.alias("size"), mark, own.cast("double").alias("own"))
    rows = staged(rows.withColumn("u", uniform(seed)), "sizes")
    plan = targets(rows, share)
    scale = rows.groupBy("source").agg(F.sum(F.col("own") * F.col("size")).alias("scale"))
    plan = plan.join(scale, plan["source"].eqNullSafe(scale["source"])).select(plan["*"], "scale")
    plan = staged(plan, "targets")

    at = plan.withColumnRenamed("source", "_s")
    rows = rows.join(at, rows["source"].eqNullSafe(at["_s"])).drop("_s")
    rows = rows.withColumn("wanted", wanted()).withColumn("whole", F.floor("wanted")).withColumn("key", key())
    bins = F.greatest(F.lit(1), F.ceil(F.col("n") / BIN_ROWS))
    rows = rows.withColumn("bin", F.least(F.floor(F.col("key") * bins), bins - 1))
    rows = staged(rows.select("doc_id", "source", "size", "mark", "target", "whole", "key", "bin"), "keyed")

    sums = rows.groupBy("source", "bin").agg(
        F.sum(F.when(F.col("key") < 1, F.col("size")).otherwise(0)).alias("words"),
        F.sum(F.col("whole") * F.col("size")).alias("certain"),
        F.first("target").alias("target"),
    )
    source = Window.partitionBy("source")
    running = source.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("rest", F.col("target") - F.sum("certain").over(source))
    sums = sums.withColumn("after", F.sum("words").over(running)).withColumn("before", F.col("after") - F.col("words"))
    edge = sums.where("after > rest").groupBy("source").agg(
        F.min("bin").alias("edge"), F.min_by("before", "bin").alias("before"), F.first("rest").alias("rest")
    )
    e = edge.withColumnRenamed("source", "_s")
    near = rows.where("key < 1").join(e, rows["source"].eqNullSafe(e["_s"])).where("bin = edge")
    near = near.groupBy("source", *ENTRY).agg(
        F.count("*").alias("rows"), F.first("before").alias("before"), F.first("rest").alias("rest")
    )
    order = Window.partitionBy("source").orderBy(*ENTRY).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("total", F.col("before") + F.sum(F.col("rows") * F.col("size")).over(order))
    # The cut: the first entry of which not all rows fit; everything before it is taken, and those of its rows that fit.
    room = F.col("rest") - F.col("total") + F.col("rows") * F.col("size")
    near = near.withColumn("fit", F.floor(F.try_divide(room, F.col("size")))).withColumn("gap", room - F.col("fit") * F.col("size"))
    first = F.min_by(F.struct(F.struct(*ENTRY).alias("cut"), "fit", "gap"), F.struct(*ENTRY)).alias("c")
    cut = near.where("total > rest").groupBy("source").agg(first).select("source", "c.*")
    c = cut.withColumnRenamed("source", "_s")
    left = rows.where("key < 1 and size > 0").join(c, rows["source"].eqNullSafe(c["_s"])).where(
        (F.struct(*ENTRY) > F.col("cut")) & (F.col("size") <= F.col("gap"))
    )
    best = F.struct("size", (-F.col("key")).alias("late"), (-F.col("doc_id")).alias("id"))
    fill = left.groupBy("source").agg(F.max_by(F.struct(*ENTRY), best).alias("fill"))
    f = fill.withColumnRenamed("source", "_f")
    rule = plan.join(c, plan["source"].eqNullSafe(c["_s"]), "left").drop("_s")
    rule = rule.join(f, plan["source"].eqNullSafe(f["_f"]), "left").drop("_f", "gap")
    return rows, staged(rule, "rule")


def wanted() -> Column:
    """Copies of a document that its source's target asks for, at most CAP."""
    return F.least(F.lit(float(CAP)), F.coalesce(F.try_divide(F.col("target") * F.col("own"), F.col("scale")), F.lit(0.0)))


def key() -> Column:
    """Pareto rank mapped to (0, 1); 1 for documents that have no chance."""
    p = F.col("wanted") - F.floor("wanted")
    rank = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return F.when(p > 0, rank / (1 + rank)).otherwise(1.0)


def _special() -> Column:
    """Rows at the cut or like the one that fills the gap, of which only some are taken."""
    mine = F.struct(*ENTRY)
    return (F.col("key") < 1) & (F.coalesce(mine.eqNullSafe(F.col("cut")), F.lit(False)) | F.coalesce(mine.eqNullSafe(F.col("fill")), F.lit(False)))


def _copies() -> Column:
    """Copies of a row that is not special."""
    chosen = (F.col("key") < 1) & (F.col("cut").isNull() | (F.struct(*ENTRY) < F.col("cut")))
    return (F.col("whole") + F.when(chosen, 1).otherwise(0)).cast("long")


def _chosen() -> Column:
    """Rows of a special entry that are taken once more than the others."""
    return F.when(F.struct(*ENTRY).eqNullSafe(F.col("cut")), F.col("fit")).otherwise(1).cast("long")


def mix_sizes(docs: DataFrame, weight=None, seed: str = SEED, share: float = 1.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of `docs(doc_id, text, source)`.

    `weight`: a column of `docs` that scales the odds of a document within its source.
    """
    rows, rule = _plan(docs, weight, seed, share)
    r = rule.select(F.col("source").alias("_s"), "source_size", "cut", "fit", "fill")
    out = rows.join(r, rows["source"].eqNullSafe(r["_s"])).withColumn("special", _special())
    plain = out.where("not special").withColumn("copies", _copies())
    keys = ["doc_id", "source", "size", "source_size", "target", "whole", "key", "mark", "cut", "fit", "fill"]
    few = out.where("special").groupBy(*keys).agg(F.count("*").alias("rows"))
    few = few.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    few = few.withColumn("copies", (F.col("whole") + F.when(F.col("i") <= _chosen(), 1).otherwise(0)).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", "copies"]
    out = plain.select(*columns).unionByName(few.select(*columns))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weight=None, seed: str = SEED, share: float = 1.0) -> DataFrame:
    """`docs` as the mix has them: documents left out are gone, those taken k times stand k times."""
    _, rule = _plan(docs, weight, seed, share)
    own = weight if weight is not None else F.lit(1.0)
    r = rule.select(F.col("source").alias("_s"), "target", "scale", "cut", "fit", "fill")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "text", own.cast("double").alias("own"))
    rows = rows.join(r, rows["source"].eqNullSafe(r["_s"]))

    def keyed(some: DataFrame) -> DataFrame:
        size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
        # A zero that the optimiser takes for a random number: what filters below ask about is worked out once for
        # each row, not again for every mention.
        once = F.rand(0) * 0
        some = some.withColumns({"u": uniform(seed) + once, "size": size, "mark": F.xxhash64("text")}).drop("text")
        some = some.withColumn("wanted", wanted() + once).withColumn("whole", F.floor("wanted")).withColumn("key", key() + once)
        return some.withColumn("special", _special())

    plain = keyed(rows).where("not special").select("_row", _copies().alias("copies"))
    # Special rows have the doc_id of the cut or of the filler; the others need not be looked at again.
    near = rows.where("(cut is not null and doc_id <=> cut.doc_id) or (fill is not null and doc_id <=> fill.doc_id)")
    one = F.min_by("_row", F.xxhash64("_row")).alias("_row")
    few = keyed(near).where("special").groupBy("source", *ENTRY, "whole", "cut", "fit").agg(one, F.count("*").alias("rows"))
    few = few.select("_row", (F.col("whole") * F.col("rows") + _chosen()).cast("long").alias("copies"))
    rows = plain.unionByName(few).where("copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")

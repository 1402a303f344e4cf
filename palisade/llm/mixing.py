"""Mixing sources to target weights by Pareto order sampling.

Each source's target is a number of words. Documents are expected in it so many times as their weight says: short ones
more often than long ones, so that few long documents do not fill a mix. The whole part of that number is taken as
certain copies; what is left of the target is a sample of fixed size (in words) with unequal probabilities: documents are
ranked by random odds divided by inclusion odds, the odds of the fraction, and taken in that order until it is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
#: Weight of a document whose size has b binary digits: WEIGHT div b, a whole number, so that sums are exact.
WEIGHT = 1024


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """sizes (source, source_size): one row a source -> plus target.

    Sources by code point, null last, weigh 1, 2, .., cycle, repeating. All words are shared by weight; a target
    stops at cap times its source's size and the excess is shared again by weight, until none is above. That is the
    level at which the sources of least cap * size / weight are full: one pass in that order finds it.
    """
    one = F.lit(1)  # one row a source: small
    order = W.partitionBy(one).orderBy(F.col("source").isNull(), "source")
    t = sizes.withColumn("w", ((F.row_number().over(order) - 1) % cycle + 1).cast("long"))
    t = t.withColumn("_full", F.lit(cap) * F.col("source_size") / F.col("w"))
    by = W.partitionBy(one).orderBy("_full", F.col("source").isNull(), "source")
    t = t.withColumns({
        "_left": F.sum("source_size").over(W.partitionBy(one)) - F.lit(cap) * (F.sum("source_size").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("source_size")),
        "_w": F.sum("w").over(W.partitionBy(one)) - F.sum("w").over(by.rowsBetween(W.unboundedPreceding, 0)) + F.col("w")})
    # the first source that is not full sets the level; if all are full, each stops at its cap
    t = t.withColumn("_first", F.min(F.when(F.col("_full") * F.col("_w") > F.col("_left"), F.struct("_full", F.col("source").isNull().alias("n"), "source", (F.col("_left") / F.col("_w")).alias("level")))).over(W.partitionBy(one)))
    target = F.least(F.lit(cap) * F.col("source_size"), F.col("_first.level") * F.col("w"))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of md5 of a string: the same in every run."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def copies(classes: DataFrame, goals: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, bits, words) and (source, source_size, target) -> (source, bits, source_size, target, whole, p).

    A document of a size class is expected least(cap, level * weight) times; the level is the one at which a source's
    expected words are its target. Classes of greatest weight are full first: one pass in that order finds it. `whole`
    is the whole part of the number, p the rest of it.
    """
    g = F.expr(f"{WEIGHT} div bits")
    t = classes.where("bits > 0").join(C.small(goals).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("g", g)
    by = W.partitionBy("source").orderBy("bits").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy("source")
    t = t.withColumns({
        "_left": F.col("target") - F.lit(cap) * (F.sum("words").over(by) - F.col("words")),
        "_w": F.sum(F.col("words") * F.col("g")).over(all_) - F.sum(F.col("words") * F.col("g")).over(by) + F.col("words") * F.col("g")})
    t = t.withColumn("_level", F.min(F.when(F.lit(cap) * F.col("_w") > F.col("_left") * F.col("g"), F.struct("bits", (F.col("_left") / F.col("_w")).alias("level")))).over(all_))
    t = t.withColumn("_e", F.least(F.lit(cap), F.col("_level.level") * F.col("g")))
    return t.select("source", "bits", "words", "source_size", "target", F.floor("_e").alias("whole"), (F.col("_e") - F.floor("_e")).alias("p"))


def pareto_mix(docs: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """All columns of docs plus size, source_size, target and taken (words the mix takes of the document).

    No row is dropped: documents that are not taken have taken = 0. A null text has size 0. Rows that share an id have
    random numbers of their own, by their text and, of equal rows, by a count; a null id has none and gives only its
    certain copies. A column of docs with the name of one of the four is replaced. The document that would go
    over its source's target is not taken; of those after it, the one whose size is nearest to what is missing is, if
    that brings the source nearer to its target. A source's rows are never gathered: sums by bin of the rank find the
    bin in which the target is reached, and only that bin (1 / BINS of the source) is ordered exactly. All of that runs
    on (doc_id, source, size); the documents themselves only meet tables of a few rows a source.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    counted = _keyed(docs)
    narrow = C.save(counted.drop("doc"), "sizes")
    classes = C.save(narrow.groupBy("source", _bits().alias("bits")).agg(F.sum("size").alias("words")), "classes")
    goals = C.save(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), cap, cycle), "targets")
    plan = C.save(copies(classes, goals, cap), "copies")
    rests = plan.groupBy(F.col("source").alias("_s")).agg((F.first("target") - F.sum(F.col("words") * F.col("whole"))).alias("_rest"))
    rests = C.save(rests, "rests")
    live = _ranked(narrow, plan).where(F.col("_q").isNotNull() & (F.col("size") > 0)).select("source", "key", "size", "_q")
    live = live.withColumn("_bin", F.floor(F.col("_q") / (1 + F.col("_q")) * BINS))  # the same order on [0, 1]
    bins = live.groupBy("source", "_bin").agg(F.sum("size").alias("s"))
    upto = W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("_before", F.sum("s").over(upto) - F.col("s"))
    # the bin in which the target is reached, one a source
    edge = bins.join(C.small(rests), F.col("source").eqNullSafe(F.col("_s"))).where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("s") > F.col("_rest")))
    edge = C.save(edge.select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), "_before", "_rest"), "edges")
    border = live.join(C.small(edge), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b")))
    run = W.partitionBy("source").orderBy("_q", "key").rowsBetween(W.unboundedPreceding, 0)
    border = border.withColumn("_cum", F.col("_before") + F.sum("size").over(run))
    inside = F.col("_cum") <= F.col("_rest")
    cut = border.groupBy("source").agg(
        F.max(F.when(inside, F.struct("_q", "key"))).alias("_last"), F.coalesce(F.max(F.when(inside, F.col("_cum"))), F.min("_before")).alias("_got"), F.min(F.struct("_q", "key")).alias("_first"), F.first("_rest").alias("_rest"))
    cut = C.save(cut.select(F.col("source").alias("_s"), "_last", "_got", "_first", "_rest"), "cuts")
    missing = F.col("_rest") - F.col("_got")
    away = F.abs(missing - F.col("size"))
    extra = live.join(C.small(cut), F.col("source").eqNullSafe(F.col("_s"))).where(~_before_cut() & (away < missing))
    extra = extra.groupBy("source").agg(F.min(F.struct(away.alias("a"), "_q", "key")).alias("_e")).select(F.col("source").alias("_x"), F.col("_e.key").alias("_extra"))
    cut = rests.join(cut.drop("_rest"), rests["_s"].eqNullSafe(cut["_s"]), "left").drop(cut["_s"])
    cut = C.save(cut.join(extra, F.col("_s").eqNullSafe(F.col("_x")), "left").drop("_x"), "cuts")
    goal = C.small(goals).toDF("_t", "source_size", "target")
    out = _ranked(counted, plan).join(goal, F.col("source").eqNullSafe(F.col("_t"))).drop("_t").join(C.small(cut), F.col("source").eqNullSafe(F.col("_s")), "left")
    # a source without a cut reaches its target with no document too many: all of it is inside
    chosen = F.col("_q").isNotNull() & (F.col("_first").isNull() | _before_cut() | (F.col("key") == F.col("_extra")))
    once = F.when(F.coalesce(chosen, F.lit(False)) & (F.col("_rest") > 0), 1).otherwise(0)
    taken = (F.col("size") * (F.coalesce("_whole", F.lit(0)) + once)).cast("long")
    return out.select("doc.*", "size", "source_size", "target", taken.alias("taken"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, source, size, key): a document as one column, so that no name of its own can clash, and what tells it from all
    others: its id, and for the rows of an id that occurs more than once also a hash of the text and a count. Only those
    rows are shuffled, by id and hash."""
    d = docs.select(F.struct("*").alias("doc"), "source", words(F.col("text")).alias("size"), F.col("doc_id").cast("string").alias("key"))
    repeated = C.save(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).count().where("count > 1").select("key"), "repeated")
    if not repeated.count():
        return d
    again = d.join(C.small(repeated), "key", "left_semi").withColumn("h", F.xxhash64("doc.text", "source"))
    nth = F.row_number().over(W.partitionBy("key", "h").orderBy("size"))
    again = again.withColumn("key", F.concat_ws("/", "key", F.col("h").cast("string"), nth.cast("string")))
    return d.join(C.small(repeated), "key", "left_anti").unionByName(again.select(*d.columns))


def _bits() -> Column:
    """Binary digits of the size; 0 for 0."""
    return F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)


def _ranked(d: DataFrame, plan: DataFrame) -> DataFrame:
    """d plus whole copies and the rank: random odds over inclusion odds."""
    plan = C.small(plan).select(F.col("source").alias("_c"), F.col("bits").alias("_n"), F.col("whole").alias("_whole"), F.col("p").alias("_p"))
    d = d.join(plan, F.col("source").eqNullSafe(F.col("_c")) & (_bits() == F.col("_n")), "left").drop("_c", "_n")
    p, u = F.col("_p"), uniform(F.col("key"))
    return d.withColumn("_q", F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))).drop("_p")


def _before_cut() -> Column:
    rank = F.struct(F.col("_q"), F.col("key"))
    return F.when(F.col("_last").isNotNull(), rank <= F.col("_last")).otherwise(rank < F.col("_first"))

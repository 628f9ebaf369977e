"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by a keyed hash and sent off in that order, over and over up
to ``CAP`` times. A sending finishes at the virtual time (words of its source so far) / (target of its
source), so that at any time all sources have sent the same part of their targets. The mix is all
sendings in order of that time, cut where the budget, the sum of all targets, is reached.

Targets: the budget is shared by weight; a share above ``CAP`` times the source's size is cut
to that, and the excess is shared among the others by weight until none is above.

Sums inside a source run over (source, range of the hash): the hash is uniform, so a source with a
third of all rows is spread evenly. The cut is found by refining a range of virtual times, from a
fixed number of sums per pass. A document's number of copies then depends only on its hash and two
values of its source, so texts are repeated in place, without a shuffle.

Defined results: null text and text without words have size 0 and are never taken; a null source
is a source; rows equal in id and text go together; an empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazegrid.llm.common import free_names, join_measured, running_sums, stored, WORD_GAP

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20240
BUCKET_BITS = 12
BINS = 4096
FEW = 10_000  # virtual times looked at one by one


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_GAP.replace("[", "[^", 1))), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id, text)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with ``target``; sources in code-point order, null last,
    take the weights in turn."""
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = running_sums(sizes.withColumn("_one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "_one", "_rank", "ranks", tasks)
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.select("source", "source_size", turn.cast("long").alias("weight")), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    size, weight = F.col("source_size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    rest, shares = total, ranked.agg(F.sum("weight")).first()[0] or 0
    while True:
        above = weight * F.lit(rest).cast("decimal(19,0)") > size * F.lit(cap * shares).cast("decimal(18,0)")
        cut, free = ranked.agg(F.sum(F.when(above, F.col("source_size") * cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if not free or (total - (cut or 0), free) == (rest, shares):
            break
        rest, shares = total - (cut or 0), free
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(max(shares, 1)).cast("double")
    return ranked.select("source", "source_size", F.when(above, (F.col("source_size") * cap).cast("double")).otherwise(share).alias("target"))


@dataclass
class Mix:
    """``rows``: a narrow row per document; ``cut``: the virtual time up to which is taken."""

    rows: DataFrame
    cut: float

    def times_sent(self) -> Column:
        return _copies(F.col("upto"), F.lit(self.cut))


def _copies(upto: Column, cut: Column) -> Column:
    """Sendings e = 0, 1, ... with (e * source_size + upto) / target <= cut, at most CAP."""
    hits = [F.when((F.col("target") > 0) & ((F.lit(e) * F.col("source_size") + upto) / F.col("target") <= cut), 1).otherwise(0) for e in range(CAP)]
    return sum(hits[1:], hits[0])


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """Sizes, targets, the order inside each source and the cut; reads the texts once."""
    key = shuffle_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    rows = stored(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                              n_words(F.col(f"`{text}`")).alias("size"), key.alias("key")), "sizes")
    aims = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    bucket = F.shiftright("key", 64 - BUCKET_BITS)
    sums = rows.groupBy(F.col("source").alias("_s"), bucket.alias("_b")).agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(sums.select("_s", "_b", before.alias("_before")), "starts")
    # tied keys are one step: a range frame counts them together
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key").rangeBetween(W.unboundedPreceding, 0))
    local = rows.withColumn("bucket", bucket).withColumn("_inside", inside)
    located = local.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    located = located.select("doc_id", "source", "size", "key", (F.col("_before") + F.col("_inside")).alias("upto"))
    aim = aims.select(F.col("source").alias("_source"), "source_size", "target")
    placed = stored(join_measured(located, stored(aim, "aims"), [("source", "_source")]).drop("_source"), "placed")
    return Mix(placed, _cut(placed, aims.agg(F.sum("source_size")).first()[0] or 0))


def _cut(placed: DataFrame, budget: int) -> float:
    """The last virtual time at which all sendings so far stay within the budget."""
    finish = F.explode(F.array(*((F.lit(e) * F.col("source_size") + F.col("upto")) / F.col("target") for e in range(CAP))))
    times = placed.where("size > 0 AND target > 0").select("size", finish.alias("t"))
    first, last = times.agg(F.min("t"), F.max("t")).first()
    spent, cut = 0, 0.0
    while first is not None:
        here = times.where(F.col("t").between(first, last))
        if here.count() <= FEW:
            steps = here.groupBy("t").agg(F.sum("size")).orderBy("t").collect()
            steps = [(words, t, t) for t, words in steps]
        else:
            bin_ = F.floor((F.col("t") - first) * (BINS / (last - first)))
            steps = here.groupBy(bin_.alias("bin")).agg(F.sum("size"), F.min("t"), F.max("t")).orderBy("bin").collect()
            steps = [tuple(r)[1:] for r in steps]
        first = None
        for words, bottom, top in steps:
            if spent + words > budget:
                if bottom < top:  # the cut lies inside this range
                    first, last = bottom, top
                break
            spent, cut = spent + words, top
    return cut


def shares_taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken, first_finish for every document."""
    mix = plan(docs, doc_id, text, source)
    return mix.rows.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * mix.times_sent()).alias("taken"),
                           F.when(F.col("target") > 0, F.col("upto") / F.col("target")).alias("first_finish"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, unchanged, each as often as the mix sends it.

    Texts without a word (null, empty, blank) are never sent; a null source is a source; rows equal in id
    and text are sent equally often; columns of any name pass through."""
    own, of, most, last, copy = free_names(docs, "_key", "_source", "_most", "_last", "_copy")
    mix = plan(docs, doc_id, text, source)
    sent = mix.rows.where("size > 0").withColumn("_n", mix.times_sent())
    top = stored(sent.groupBy(F.col("source").alias("_source")).agg(F.max("_n").alias("_most")), "most")
    ends = join_measured(sent, top, [("source", "_source")]).where("_n = _most").groupBy("_source", "_most").agg(F.max("key").alias("_last"))
    ends = stored(ends.select(F.col("_source").alias(of), F.col("_most").alias(most), F.col("_last").alias(last)), "last")
    keyed = docs.withColumn(own, shuffle_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))).where(n_words(F.col(f"`{text}`")) > 0)
    named = join_measured(keyed, ends, [(source, of)], "inner")
    copies = F.when(F.col(own) <= F.col(last), F.col(most)).otherwise(F.col(most) - 1)
    repeated = named.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))

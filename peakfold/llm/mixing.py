"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, whole, written

#: Rows of one bucket of the shuffled order and of the queue, about, and buckets of the queue, at most;
#: prefix sums are taken within a bucket and over the buckets' sums.
BUCKET_ROWS, MOST_BUCKETS = 5_000, 1 << 16
#: Sources whose targets are broadcast (some 100 bytes each); those of more sources are joined.
MOST_SOURCES = 10_000


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size in words, and the key of the shuffled order; the text goes no further."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
    )


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, most, budget.  One row for each source.

    Sources by code point, null last, take the weights in turn.  A target stops at ``most`` times
    its source's size; what is over goes to the others by weight, which ends at one water level:
    with sources ordered by ``most * size / weight``, the first whose level is not above its own
    ratio fixes the level for all.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    turn = (F.row_number().over(every) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    by_level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    rows = rows.withColumns({"most": F.col("source_size") * F.lit(float(most)), "budget": F.sum("source_size").over(whole) * F.lit(float(share)), "weights": F.sum("weight").over(whole)})
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    fixed = F.min_by("level", "ratio_at").over(whole)
    rows = rows.withColumn("ratio_at", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.coalesce("source", F.lit("￿")))))
    rows = rows.withColumn("level", fixed)
    return rows.select("source", "source_size", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"), "most", "budget")


def schedule(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix-1", split: bool = True) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, virtual_finish, times
    (and tie, a hash of the text, which tells rows of one doc_id apart).

    The documents of a source stand in a shuffled order (the md5 of seed and doc_id, so that reruns
    agree) and are offered up to ``most`` times, one pass after the other.  Each offer has a virtual
    start and finish: the source's cumulative words, before and after, over its target.  All offers that
    start before virtual time 1, when every source has its target, make one queue, sorted by virtual
    finish, whose cumulative words are cut at the total budget, the sum of the targets.  The queue's unit
    is the offer; of the one of each source during which time 1 passes, the words before time 1 are a
    unit and those after it are units of a word each, as far as the cut can lie (:func:`_edges`).  With ``split`` the words before the cut are taken;
    without, an offer is one unit, queued by its middle, and taken if the middle of its words is before
    the cut.  taken sums a document's offers, times counts those taken, virtual_finish is the first one's.

    All prefix sums are by levels: sums of buckets and of runs of buckets first, then a window within
    a bucket, so that a source with a third of all rows is many small groups.  The targets, a row for each
    source, are broadcast up to ``MOST_SOURCES`` of them.

    Null text or one without words has size 0 and takes 0; a very long text is counted whole, and its
    words are never rows; a null
    source is a source of its own; rows that repeat each count, null ids too; columns but doc_id, text
    and source are left out; an empty table gives no rows.
    """
    base = written(sized(docs, seed).withColumn("row", F.monotonically_increasing_id()), "mix")
    rows = base.count()
    digits = max(1, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16)))
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))
    base = base.withColumns({"key": key, "bucket": F.substring("draw", 1, digits)})
    sums = _before_buckets(base.groupBy("key", "bucket").agg(F.sum("size").alias("words")), digits)
    aims = written(targets(base, weights, share, float(most)).withColumn("key", key).drop("source"), "aims")
    within = Window.partitionBy("key", "bucket").orderBy("draw", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(sums, ["key", "bucket"]).join(F.broadcast(aims) if aims.count() <= MOST_SOURCES else aims, "key")
    placed = placed.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = written(placed.select("row", "doc_id", "tie", "draw", "key", "size", "source_size", "target", "before"), "placed")

    offers = placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    offers = offers.withColumn("start", F.col("before") + F.col("pass") * F.col("source_size")).where("start < target")
    if split:
        whole_offer = F.col("start") + F.col("size") <= F.col("target")
        parts = [c for c in ("row", "pass", "key", "draw", "doc_id")]
        time = ((F.col("start") + F.col("end")) / F.col("target")).alias("time")
        queue = offers.where(whole_offer).select(*parts, F.col("size").alias("words"), F.col("size").alias("end"), "start", "target")
        queue = queue.unionByName(_edges(offers.where(~whole_offer).select(*parts, "size", "start", "target"))).select(*parts, "words", "end", time)
    else:
        queue = offers.select("row", "pass", "key", "draw", "doc_id", F.col("size").alias("words"), F.col("size").alias("end"), ((F.col("start") + F.col("size") / 2) / F.col("target")).alias("time")).where("time <= 1")
    buckets = max(1, min(MOST_BUCKETS, math.ceil(most * rows / BUCKET_ROWS)))
    queue = queue.withColumn("slot", F.least(F.floor(F.col("time") * buckets), F.lit(buckets)).cast("int"))
    slots = queue.groupBy("slot").agg(F.sum("words").alias("words"))
    slots = slots.select("slot", F.coalesce(F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("served"))
    budget = aims.agg(F.round(F.least(F.max("budget"), F.sum("most"))).cast("long").alias("budget"))
    line = Window.partitionBy("slot").orderBy("time", "key", "draw", "doc_id", "pass", "end", "row").rowsBetween(Window.unboundedPreceding, -1)
    queue = queue.join(slots, "slot").crossJoin(F.broadcast(budget))
    queue = queue.withColumn("served", F.col("served") + F.coalesce(F.sum("words").over(line), F.lit(0)))
    left = F.col("budget") - F.col("served")
    got = F.greatest(F.lit(0), F.least("words", left)) if split else F.when(F.col("words") <= left * 2, F.col("words")).otherwise(F.lit(0))
    taken = queue.withColumn("got", got.cast("long")).where("got > 0").groupBy("row").agg(F.sum("got").alias("taken"), F.count_distinct("pass").cast("int").alias("times"))
    return placed.join(taken, "row", "left").select(
        "doc_id", "tie", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), ((F.col("before") + F.col("size")) / F.nullif("target", F.lit(0.0))).alias("virtual_finish"),
        F.coalesce("times", F.lit(0)).alias("times"),
    )


def _before_buckets(sums: DataFrame, digits: int) -> DataFrame:
    """key, bucket and base, the words of a source in the buckets before, by runs of buckets first."""
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("run", F.substring("bucket", 1, max(1, digits // 2)))
    runs = sums.groupBy("key", "run").agg(F.sum("words").alias("all"))
    runs = runs.select("key", "run", F.coalesce(F.sum("all").over(earlier("key").orderBy("run")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("words").over(earlier("key", "run").orderBy("bucket")), F.lit(0))
    return sums.join(runs, ["key", "run"]).select("key", "bucket", (F.col("base") + inside).alias("base"))


def _edges(edges: DataFrame) -> DataFrame:
    """The units of the offers during which virtual time 1 passes, one a source at most.

    By time 1 every source has been given the whole words of its target, which together are at most the
    budget; what is left is less than a word a source.  So the cut lies among the first words after time 1,
    as many as there are sources in all.  How far in virtual time these reach is searched on the sources'
    rows: a source has as many words by a time as its target grows by then.
    """
    edges = written(edges.withColumn("early", F.floor("target") - F.col("start")), "edges")
    n, total = edges.agg(F.count("*"), F.sum("target")).first()
    reach, left = 4.0 * (n + 1) / (total or 1.0), F.col("size") - F.col("early")
    while n:
        late = F.least(left, F.floor((1 + reach) * F.col("target")) - F.floor("target"))
        found, rest = edges.agg(F.sum(late), F.sum(left)).first()
        if found >= min(n, rest):
            break
        reach *= 4
    whole_part = edges.where("early > 0").withColumns({"words": F.col("early"), "end": F.col("early")})
    late = F.least(left, F.floor((1 + reach) * F.col("target")) - F.floor("target") + 1)
    single = edges.withColumn("end", F.explode(F.sequence(F.col("early") + 1, F.col("early") + late))).withColumn("words", F.lit(1).cast("long"))
    return whole_part.unionByName(single).drop("size", "early")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The schedule, documents sorted by virtual finish over all partitions."""
    return schedule(docs, **options).orderBy("virtual_finish", "doc_id")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: whole documents, each as often as the mix takes it, with the columns of ``docs``,
    whatever their names.  A document without words (null or empty) is taken once, as it costs nothing
    and is no reason to lose it.  Rows that repeat are taken as often as all of them are; an empty table
    gives no rows."""
    slim = schedule(docs, split=False, **options)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("times"))
    counts = slim.groupBy(F.col("doc_id").alias("at"), F.col("tie").alias("own")).agg(F.sum(times).cast("int").alias("times"), F.count("*").alias("n"))
    counts = written(counts.where("times > 0"), "times")
    rows = whole(docs, id=F.col("doc_id"), tie=F.xxhash64(F.coalesce("text", F.lit(""))))

    def met(own: DataFrame) -> DataFrame:
        return rows.join(own, rows["id"].eqNullSafe(own["at"]) & (rows["tie"] == own["own"]))

    # rows that repeat as a whole are one row as often as all of them are taken
    out = met(counts.where("n = 1")).unionByName(met(counts.where("n > 1")).dropDuplicates(["id", "tie"]))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("times", "tie")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM per),
ratios AS (SELECT *, most / weight AS ratio, sum(weight) OVER () AS weights FROM weighed),
levels AS (
  SELECT *, (budget - coalesce(sum(most) OVER w, 0)) / (weights - coalesce(sum(weight) OVER w, 0)) AS lvl
  FROM ratios WINDOW w AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fixed AS (SELECT lvl FROM levels WHERE lvl <= ratio ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
aims AS (SELECT source, source_size, least(most, (SELECT lvl FROM fixed) * weight) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.draw, s.size, a.source_size, a.target, CASE WHEN s.source IS NULL THEN '' ELSE '=' || s.source END AS key,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
offers AS (
  SELECT *, before + pass * source_size AS start FROM placed, (VALUES (0), (1)) passes(pass)
  WHERE size > 0 AND before + pass * source_size < target),
queue AS (
  SELECT doc_id, draw, key, pass, size AS finish, size AS words, (start + size)::DOUBLE / target AS time FROM offers WHERE start + size <= target
  UNION ALL
  SELECT doc_id, draw, key, pass, word, 1, (start + word)::DOUBLE / target FROM (SELECT *, unnest(range(1, size + 1)) AS word FROM offers WHERE start + size > target)),
served AS (
  SELECT doc_id, words, coalesce(sum(words) OVER (ORDER BY time, key, draw, doc_id, pass, finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM queue),
got AS (
  SELECT doc_id, sum(greatest(0, least(words, (SELECT round(least(max(budget), sum(most)))::BIGINT FROM ratios) - before)))::BIGINT AS taken
  FROM served GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, (before + size)::DOUBLE / nullif(target, 0) AS virtual_finish
FROM placed LEFT JOIN got USING (doc_id)
"""

"""Near copies: one-permutation MinHash with optimal densification, bands, star-shaped candidate
edges, links confirmed on whole shingle sets, connected components."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BoundedFilter, Scratch, attach, documents, giving_back, let_go, may_hold, small_batches, whole, without, written
from .fingerprints import bin_minima, densified
from .textops import _STEPS, mixed, row_shingles

NO_ID = (1 << 63) - 1  # stands for a null id, above all others
#: At 40 bands of 6 bins, two sets of similarity 0.85 miss all bands once in 10**8.
BANDS, BAND_ROWS = 40, 6
#: Members and shingles of one side of a block, about, and different shingles of it that are compared at once.
BLOCK, SHINGLES, STRIPE = 256, 1 << 18, 4096


def shingle_sets(col: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of every row."""
    for i, j, hashes, at in row_shingles(col, k):
        for r in range(j - i):
            own = np.sort(hashes[at[r] : at[r + 1]])
            yield i + r, own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def _set_id(own: np.ndarray) -> bytes:
    return sha256(own.tobytes()).digest()[:16]


def _signed(k: int, bands: int, rows: int):
    """id, n_shingles, set_id and band keys of each text, and the columns after these two as they are."""

    def sign(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sets = [s for _, s in shingle_sets(part.column(1), k)]
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                low = densified(bin_minima(np.concatenate(sets), at, bands * rows)).reshape(len(sets), bands, rows)
                keys = mixed((low * _STEPS[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                full = np.array([len(s) > 0 for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * bands)]), pa.int32()), pa.array(keys[full].ravel()))
                own = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_id(s) for s in sets], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays([*own, *part.columns[2:]], ["id", "n_shingles", "set_id", "bands", *part.schema.names[2:]])

    return sign


def _sets_of(k: int, wanted: BoundedFilter):
    """id, set_id and the shingle hashes of the texts that may be wanted."""

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.may_hold(batch.column(0).to_numpy(zero_copy_only=False))))
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                own = [s for _, s in shingle_sets(part.column(1), k)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in own])]), pa.int32()), pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_set_id(s) for s in own], pa.binary()), lists], ["id", "set_id", "hashes"])

    return sets


def _at_heads(rows: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """``rows`` and what ``found`` has for their comp (one row for each comp).  A component may have most
    of the rows; its rows are dealt by chance."""
    heads = rows.groupBy("comp").agg(F.count("*").alias("heads"))
    return attach(rows, found.join(heads, "comp"), "comp", "heads", total).drop("heads")


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch, total: int) -> DataFrame:
    """node, comp: the smallest node reachable.  ``edges``: a, b; ``total``: nodes, at most.  Labels shrink
    to the smallest one of the neighbours' and then to their label's label, so a chain takes steps by its
    length's logarithm; every step is a table in the shared folder.  A node may have most of the edges and
    a label most of the nodes, so both joins deal hot keys by chance."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", scratch, 2 * total)
    n_edges = both.count()
    degree = both.groupBy("b").agg(F.count("*").alias("n"))
    labels = nodes.join(degree, nodes["node"] == degree["b"], "left").select("node", F.coalesce("n", F.lit(0)).alias("n"), F.col("node").alias("comp"))
    labels = written(labels, "labels", scratch, total)
    while True:
        near = attach(both, labels.select(F.col("node").alias("b"), "comp", "n"), "b", "n", n_edges).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "n", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        step = written(step, "nearer", scratch, total)
        step = _at_heads(step, step.select(F.col("node").alias("comp"), F.col("comp").alias("further")), total)
        step = written(step.select("node", "n", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels", scratch, total)
        if step.where("old > comp").isEmpty():
            return step.select("node", "comp")
        labels = step.select("node", "n", "comp")


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose whole sets are alike enough."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    n_a, n_b = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a")), sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
    able = edges.join(n_a, "a").join(n_b, "b").where(sizes)
    pairs = able.join(two, "b").join(one, "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select("a", "b")


def _several(known: DataFrame) -> DataFrame:
    """key, most: the keys whose nodes are in more than one component, and the component with most of them."""
    each = known.groupBy("key", "comp").agg(F.count("*").alias("have"))
    each = each.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("have", "comp")).alias("top"))
    return each.where("comps > 1").select("key", F.col("top.comp").alias("most"))


def _reach(share, sizes, percent: int):
    """Whether sets with sizes of this sum can be alike while sharing so many."""
    return share * (100 + percent) >= sizes * percent


def _able(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The members of a group that could be alike to its smallest member, if not to it then to none:
    what a set can share from its first common shingle on is ``room``, and a larger partner needs more."""
    small = rows.groupBy("key").agg(F.min("n").alias("small"), F.count("*").alias("all")).where("all > 1").drop("all")
    small = written(small, "smallest", scratch)
    return rows.join(small, "key").where(_reach(F.col("room"), F.col("n") + F.col("small"), percent)).drop("small")


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, node, n, room: the rarest shingles of each node, so many that two sets alike enough share one.

    Sets of sizes x and y that are alike share at least ``percent`` of either, so the first x less that
    share, plus one, of x's shingles in any one order meet those of y.  The order is by frequency among
    these nodes, so a passage that many of them share comes last.  ``room`` counts the shingles from
    there on: two sets whose first common shingle this is share no more than the smaller room.
    """
    rows = sets.join(nodes, "node").select("node", "n", F.explode("hashes").alias("key"))
    often = rows.groupBy("key").agg(F.count("*").alias("often"))
    ranked = rows.join(often, "key").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("often", "key")))
    first = F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return ranked.where(first).where("often > 1").select("key", "node", "n", (F.col("n") - F.col("rank") + 1).alias("room"))


def _blocks(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Deal the members of each open group to blocks: those outside its largest component (one side)
    to rows of blocks and all (other side) to columns, so that each pair of a member outside and any
    other meets in one block.  A block has about ``BLOCK`` members of either side, and about ``SHINGLES``
    shingles of these, whatever the group's size and its texts' length, and the largest component's
    members are not compared with each other."""
    share = F.greatest(F.lit(1 / BLOCK), F.col("n") / SHINGLES)  # of a block that a member takes
    outside = F.when(F.col("comp") != F.col("most"), share).otherwise(0.0)
    size = left.groupBy("key").agg(F.ceil(F.round(F.sum(share), 9)).alias("cols"), F.ceil(F.round(F.sum(outside), 9)).alias("rows"))
    dealt = left.join(size, "key").select("key", "node", "comp", F.col("comp") != F.col("most"), "rows", "cols").toDF("key", "node", "comp", "outside", "rows", "cols")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = dealt.where("outside").select("key", "node", "comp", F.lit(True).alias("one"), own("rows").alias("i"), every("cols").alias("j"))
    two = dealt.select("key", "node", "comp", F.lit(False).alias("one"), own("cols").alias("j"), every("rows").alias("i"))
    return one.unionByName(two).join(sets.select("node", "hashes"), "node")


def _linked(percent: int):
    """Components of a block that hold sets alike enough, as few pairs of them as connect them."""

    def link(table: pa.Table) -> pa.Table:
        side = table.column("one").to_numpy()
        comp = table.column("comp").to_numpy()
        lists = table.column("hashes").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        count = np.diff(at)
        row = np.repeat(np.arange(len(count)), count)
        flat = flat[at[0] : at[-1]]
        words, word = np.unique(flat, return_inverse=True)
        both = (np.bincount(word[side[row]], minlength=len(words)) > 0) & (np.bincount(word[~side[row]], minlength=len(words)) > 0)
        place = np.cumsum(both) - 1
        row, word = row[both[word]], place[word[both[word]]]
        order = np.argsort(word, kind="stable")
        row, word = row[order], word[order]
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        local = np.cumsum(side) - 1
        local[two] = np.arange(len(two))
        common = np.zeros((len(one), len(two)), np.float32)
        for lo in range(0, int(both.sum()), STRIPE):
            a, b = np.searchsorted(word, [lo, lo + STRIPE])
            left, right = np.zeros((len(one), STRIPE), np.float32), np.zeros((len(two), STRIPE), np.float32)
            r, w = row[a:b], word[a:b] - lo
            left[local[r[side[r]]], w[side[r]]] = 1
            right[local[r[~side[r]]], w[~side[r]]] = 1
            common += left @ right.T
        common = np.rint(common).astype(np.int64)
        alike = common * 100 >= (count[one][:, None] + count[two][None] - common) * percent
        x, y = np.nonzero(alike & (comp[one][:, None] != comp[two][None]))
        root: dict[int, int] = {}
        out = []

        def top(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        for c, d in np.unique(np.sort(np.stack([comp[one[x]], comp[two[y]]], axis=1), axis=1), axis=0).tolist():
            p, q = top(c), top(d)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((c, d))
        if len(flat) > SHINGLES:
            let_go()
        return pa.table([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.int64())], names=["a", "b"])

    return link


def near_groups(docs: DataFrame, k: int = 3, percent: int = 85, bands: int = BANDS, rows: int = BAND_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    A document's set is that of its distinct runs of ``k`` lower-cased words; a shorter text is one run,
    one without words (or null) is empty and linked with nothing.  Documents are linked when 100 times
    the intersection is at least ``percent`` times the union.  component_id is the smallest doc_id
    reachable; rows with a null doc_id are never the smallest unless alone (then null).

    1. Rows of equal sets become one node, whatever their number.
    2. Each bucket of equal band keys makes a star: its smallest node against every other.  The links
       are confirmed on the whole sets.
    3. A bucket whose members are in one component is done.  In the others, pairs that no star has
       compared could still link.  Their nodes are joined by an exact prefix filter instead: nodes meet
       where they share one of their rarest shingles and could be alike by size and place.  Groups with
       several components are dealt to blocks in which all pairs across components are compared at once
       by their whole sets; only which components link comes out.

    So no pair that shares a bucket is lost, a group of n near copies makes n edges and not n * n, and
    pairs of components are never rows.
    """
    out = _grouped(docs, k, percent, bands, rows, scratch, [])
    comp = F.coalesce("component", "id")
    null = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(null(F.col("id")).alias("doc_id"), "n_shingles", null(comp).alias("component_id"), (F.col("id") == comp).alias("kept"))


def _grouped(docs: DataFrame, k: int, percent: int, bands: int, rows: int, scratch: Scratch | None, more: list) -> DataFrame:
    """id, n_shingles, set_id, component (its smallest id) and group (its number) of every row, and ``more``, long columns."""
    small_batches(docs.sparkSession)
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    names = [f"more{n}" for n in range(len(more))]
    wide = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), *[c.alias(n) for c, n in zip(more, names)])
    signed = written(wide.mapInArrow(giving_back(_signed(k, bands, rows)), ", ".join(["id long, n_shingles long, set_id binary, bands array<long>", *[f"{n} long" for n in names]])), "signed", scratch)
    total = signed.count()
    with Scratch(docs.sparkSession) as own_scratch:
        nodes = signed.where("n_shingles > 0").groupBy("set_id").agg(F.min("id").alias("label"), F.count("*").alias("n_docs"), F.first("bands").alias("bands"))
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", own_scratch)
        slim = nodes.select("node", "set_id", "label", "n_docs")
        keyed = nodes.select("node", F.explode("bands").alias("key"))
        # tables of one row a key are written first: a join to one can then be split where a key is hot, which
        # a join in the stage of the aggregation itself cannot
        shared = written(keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1"), "shared", own_scratch, total)
        members = written(keyed.join(shared, "key").select("key", "node", "centre"), "members", own_scratch)
        inner = members.select("node").distinct()
        wanted = slim.join(inner, "node", "left_semi")
        ids = wanted.select("label")
        own = base.mapInArrow(giving_back(_sets_of(k, BoundedFilter(ids, ids.count()))), "id long, set_id binary, hashes array<long>")
        sets = own.join(wanted.select("node", "set_id", "label"), (own["set_id"] == wanted["set_id"]) & (own["id"] == F.col("label")))
        sets = written(sets.select("node", F.size("hashes").alias("n"), "hashes").dropDuplicates(["node"]), "sets", own_scratch)
        star = members.where("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        links = written(_confirmed(star, sets, percent), "links", own_scratch, total)
        comps = components(inner, links, own_scratch, total)
        open_keys = written(_several(members.where("node > centre").join(comps, "node")), "open-keys", own_scratch, total)
        prefixes = written(_prefixes(members.join(open_keys, "key").select("node").distinct(), sets, percent), "prefixes", own_scratch)
        left = written(_able(prefixes, percent, own_scratch).join(comps, "node"), "able", own_scratch)
        left = written(left.join(written(_several(left), "several", own_scratch), "key"), "open", own_scratch)
        merges = written(_blocks(left, sets).groupBy("key", "i", "j").applyInArrow(_linked(percent), "a long, b long").distinct(), "merges", own_scratch)
        ends = merges.select(F.col("a").alias("node")).union(merges.select(F.col("b").alias("node"))).distinct()
        over = components(ends, merges, own_scratch, total).select(F.col("node").alias("comp"), F.col("comp").alias("over"))
        comps = _at_heads(comps, over, total).select("node", F.coalesce("over", "comp").alias("comp"))
        linked = written(slim.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "linked", own_scratch, total)
        smallest = linked.groupBy("comp").agg(F.min("label").alias("component"), F.count("*").alias("heads"))
        found = written(attach(linked, smallest, "comp", "heads", total).select("set_id", "n_docs", "component", F.col("comp").alias("group")), "found", scratch, total)
    return attach(signed.select("id", "n_shingles", "set_id", *names), found, "set_id", "n_docs", total)


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, with its columns as they are, whatever their names: that
    with the smallest doc_id (nulls last), and of several with that the one whose text has the smallest
    hash.

    Rows are told apart by doc_id and two hashes of the text, so ids may repeat or be null.  Rows equal
    in both are one document.  Rows without words (or null) are in no component and all stay; a very
    long text is compared whole; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    hashes = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    own, by = ["id", "more0", "more1"], ["a", "b", "id"]
    with Scratch(docs.sparkSession) as scratch:
        rows = written(_grouped(docs, k, percent, BANDS, BAND_ROWS, scratch, hashes).where("group is not null").select("group", *own), "grouped", scratch)
        total = rows.count()
        best = rows.groupBy("group").agg(F.min(F.struct(*own)).alias("best"), F.count("*").alias("n")).where("n > 1")
        judged = attach(rows, written(best, "best", scratch, total), "group", "n", total).where("n > 1")
        drop = judged.groupBy(*own).agg(F.first(F.struct(*own) == F.col("best")).alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
        drop = written(drop.select(F.nullif("id", F.lit(NO_ID)).alias("id"), F.col("more0").alias("a"), F.col("more1").alias("b"), "kept"), "dropped", rows=total)
    rows = whole(docs, id=F.col("doc_id"), a=hashes[0], b=hashes[1])
    out = without(rows, drop.select(*by), by)
    again = drop.where("kept").select(*by)
    if not again.isEmpty():  # rows that repeat and stay, once each
        may = may_hold(BoundedFilter(again.select("a"), again.count()))
        same = (rows["a"] == again["a"]) & (rows["b"] == again["b"]) & rows["id"].eqNullSafe(again["id"])
        out = out.unionByName(rows.where(may("a")).join(again, same, "left_semi").dropDuplicates(by))
    return out.select("doc.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reached.doc_id, links.y FROM reached JOIN links ON reached.r = links.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id, n
"""

"""Groups that grow with every batch of decisions (G8), without relabelling the edges of earlier batches.

The state is one row a record: (node, component).  A batch of links first turns each end into the component it already
has - a whole group is one node from then on - and finds components among these nodes only.  Then the groups that a link
touched are renamed, and new records join.  So a batch costs its own links and the members of groups that merge, and the
groups and links of all batches before are neither read into the search nor kept.

A component is named by its smallest node, as ``connected_components`` over all links would name it.  Ends that are null
link nothing, a record linked with itself is a group of its own, repeated links count once."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.buckets import BucketedTable
from .components import connected_components

HASHES = [F.xxhash64] + [lambda c, i=i: F.xxhash64(F.lit(i), c) for i in range(4)]


def numbered(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(held, known, code): the ends of links (a, b, link) by the component they have, or by themselves if they are in none
    yet.  ``code`` is 2 * link for the end a and 2 * link + 1 for b."""
    end = lambda s, i: F.struct(F.col(s).alias("node"), (F.col("link") * 2 + i).alias("code"))
    ends = links.select(F.inline(F.array(end("a", 0), end("b", 1))))
    if groups is None:
        return ends.select(F.col("node").alias("held"), F.lit(False).alias("known"), "code")
    return ends.join(groups.select("node", "component"), "node", "left").select(
        F.coalesce("component", "node").alias("held"), F.col("component").isNotNull().alias("known"), "code")


def placed(links: DataFrame, groups: DataFrame | None, hashes: Sequence[Callable[[str], Column]] = HASHES) -> DataFrame:
    """(held, known, component), written: what a batch does to each group or new record (``held``) that its links meet.

    The search runs on hashes of 8 bytes, so ids are not carried through its rounds.  Ids that share a hash are found where
    ids and hashes meet; the search is then done again with the next hash."""
    met = cut_lineage(numbered(links, groups))
    for number in hashes:
        out = cut_lineage(_named(met.withColumn("number", number("held"))))
        if out.filter("shared").isEmpty():
            return out.drop("shared")
    raise RuntimeError("ids share all of their hashes")


def _named(met: DataFrame) -> DataFrame:
    edges = met.groupBy(F.shiftright("code", 1)).agg(F.min("number").alias("a"), F.max("number").alias("b"))
    found = connected_components(edges).select(F.col("node").alias("number"), F.col("component").alias("root"))
    ids = met.groupBy("number").agg(F.min("held").alias("held"), F.max("held").alias("last"), F.max("known").alias("known"))
    rooted = ids.join(found, "number", "left").select(F.struct("held", "known", (F.col("held") != F.col("last")).alias("shared")).alias(
        "id"), F.coalesce("root", "number").alias("root"))
    # The smallest is taken of whole structs: both uses of ``rooted`` then read the same shuffles.
    names = rooted.groupBy("root").agg(F.min("id").alias("first"))
    return rooted.join(names, "root").select("id.*", F.col("first.held").alias("component"))


class GroupTable:
    """Groups kept in two bucketed tables: ``labels`` by node and ``members`` by component.

    ``labels`` answers what group a record is in; ``members`` finds the records of a group that a merge renames.  Both
    rewrite only the buckets of the records that enter or move."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.labels = BucketedTable(spark, f"{path}/labels", "node", buckets)
        self.members = BucketedTable(spark, f"{path}/members", "node", buckets,
                                     place=F.pmod(F.xxhash64("component"), F.lit(buckets)))
        self.moved = 0  # records that the last batch renamed

    def read(self) -> DataFrame | None:
        return self.labels.read()

    def _labels_of(self, nodes: DataFrame) -> DataFrame | None:
        touched = {r[0] for r in nodes.select(self.labels.place.alias("b")).distinct().collect()}  # at most ``buckets``
        return self.labels.read(only=touched)

    def add(self, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        """Add a batch of links and return (node, component) of the records that entered or moved.

        ``labels`` is written last and names the groups; a batch that died before it can be added again."""
        links = cut_lineage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").withColumn(
            "link", F.monotonically_increasing_id()))
        ends = links.select(F.col("a").alias("node")).union(links.select("b"))
        met = placed(links, self._labels_of(ends))
        changed = met.filter(~F.col("known")).select(F.col("held").alias("node"), "component")
        moves = met.filter(F.col("known") & (F.col("held") != F.col("component"))).select("held", F.col("component").alias("moved"))
        rows = changed.withColumn("gone", F.lit(False))
        place = F.pmod(F.xxhash64("held"), F.lit(self.buckets)).alias("b")
        touched = {int(r[0]) for r in moves.select(place).distinct().collect()}
        self.moved = 0
        old = self.members.read(only=touched) if touched else None
        if old is not None:
            held = cut_lineage(old.select("node", "component").join(moves.withColumnRenamed("held", "component"), "component").select(
                "node", "component", "moved"))
            self.moved = held.count()
            arriving = held.select("node", F.col("moved").alias("component"))
            changed = changed.unionByName(arriving)
            # In ``members`` a moved record leaves its old bucket: the row that says so meets the old one there.
            rows = rows.unionByName(arriving.withColumn("gone", F.lit(False))).unionByName(
                held.select("node", "component", F.lit(True).alias("gone")))
        self.members.upsert(rows, merge=self._without_gone, dealt=True)
        self.labels.upsert(changed, merge=self._latest, dealt=True)
        return changed

    # Old and new rows of a bucket meet in the shuffle that the writer needs anyway.
    def _without_gone(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new).withColumn("_place", self.members.place).repartition("_place")
        return both.groupBy("_place", "node", "component").agg(F.max("gone").alias("gone")).filter("not gone").drop("_place")

    def _latest(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        both = both.withColumn("_place", self.labels.place).repartition("_place")
        return both.groupBy("_place", "node").agg(F.max_by("component", "_new").alias("component")).drop("_place")

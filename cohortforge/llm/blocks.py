"""All-pairs work inside groups of any size, in blocks of bounded weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.components import components
from cohortforge.llm.tables import written

#: A block has about so many documents and so much weight at most.
ROWS = 250
WEIGHT = 200_000
#: Documents that every block of a cut group holds.
BRIDGES = 16


def _parts(sizes: DataFrame, count: str, weight: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / ROWS), F.ceil(F.col(weight) / WEIGHT), F.lit(1).cast("long"))


def linked_in_groups(rows: DataFrame, compare, label: str) -> DataFrame:
    """Edges ``a, b`` that tie together whatever is linked inside each group.

    ``rows`` has ``cell, rep, weight`` (a row per member) and the columns ``compare`` reads,
    which takes the rows of one block as an Arrow table and returns the edges of a spanning forest
    of its links. A group over the block's size is cut by a hash of the member; about ``BRIDGES``
    members stand in every block, so that a dense group hangs together at once. Members
    outside the largest component of their group are then compared with every block, so
    that no link is lost to the cut; pairs inside that component need no further one.
    """
    edges = "a long, b long"
    sizes = rows.groupBy("cell").agg(F.count("*").alias("_size"), F.sum("weight").alias("_weight"))
    sizes = sizes.where(F.col("_size") > 1).withColumn("_parts", _parts(sizes, "_size", "_weight"))
    sizes = written(sizes, f"{label}-sizes")
    sized = rows.join(sizes, "cell")
    own = F.array(F.pmod(F.xxhash64("rep", "cell"), F.col("_parts")))
    bridge = F.pmod(F.xxhash64("rep", F.lit("bridge")), F.col("_size")) < BRIDGES
    every = F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)
    spread = sized.withColumn("part", F.explode(F.when((F.col("_parts") > 1) & bridge, every).otherwise(own)))
    spread = spread.select("part", *rows.columns)
    links = written(spread.groupBy("cell", "part").applyInArrow(compare, edges), f"{label}-links")
    large = written(sizes.where(F.col("_parts") > 1).select("cell", "_parts"), f"{label}-large")
    if large.isEmpty():
        return links
    inside = rows.select("cell", "rep", "weight").join(large, "cell")
    tied = components(links)
    found = inside.join(tied, inside["rep"] == tied["node"], "left")
    found = found.select("cell", "rep", "weight", F.coalesce("component", "rep").alias("component"))
    main = found.groupBy("cell", "component").count().groupBy("cell").agg(F.max(F.struct("count", "component")).alias("_main"))
    loose = found.join(main, "cell").where(F.col("component") != F.col("_main.component"))
    loose = written(loose.select("cell", "rep", "weight"), f"{label}-loose")
    cuts = loose.groupBy("cell").agg(F.count("*").alias("_n"), F.sum("weight").alias("_w"))
    cuts = written(cuts.select("cell", _parts(cuts, "_n", "_w").alias("_slots")), f"{label}-slots")
    wide = rows.join(large, "cell").join(cuts, "cell")
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1))
    base = wide.withColumn("part", F.pmod(F.xxhash64("rep", F.lit("across")), F.col("_parts"))).withColumn("slot", slots)
    again = wide.join(loose.select("cell", "rep"), ["cell", "rep"])
    again = again.withColumn("slot", F.pmod(F.xxhash64("rep", F.lit("slot")), F.col("_slots"))).withColumn("part", F.explode(every))
    names = ["part", "slot", *rows.columns]
    both = base.select(*names).unionAll(again.select(*names)).dropDuplicates(["cell", "part", "slot", "rep"])
    more = both.groupBy("cell", "part", "slot").applyInArrow(compare, edges)
    return links.unionAll(written(more, f"{label}-across"))

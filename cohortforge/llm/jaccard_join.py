"""N-gram Jaccard join by prefix filters under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortforge.llm.blocks import linked_in_groups
from cohortforge.llm.components import components
from cohortforge.llm.near_dup import shingle_sets
from cohortforge.llm.tables import drop_table, written
from cohortforge.llm.text import mix, slices

#: Of the first order's prefix, one in so many tokens of a set has to be shared: the prefix is that much longer.
EXTRA = 20


def _needed(size, percent: int):
    """Tokens that a set shares with a partner at least: the ceiling of its size times the threshold."""
    return (percent * size + 99) // 100


def _signed(percent: int):
    """Set size, two digests of the set and its prefix in the order of the tokens' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), 2 << 20):
                value, first = shingle_sets(texts)
                size = np.diff(first)
                digests = [np.zeros(len(texts), np.uint64) for _ in range(2)]
                some = np.flatnonzero(size)
                if len(some):
                    with np.errstate(over="ignore"):
                        digests[0][some] = np.add.reduceat(mix(value + np.uint64(29)), first[some])
                        digests[1][some] = np.add.reduceat(mix(value * np.uint64(0x2545F4914F6CDD1D) + np.uint64(31)), first[some])
                keep = np.minimum(size, size - _needed(size, percent) + 1 + size // EXTRA)
                # Values of a text are sorted, so the order needs no further work.
                taken = np.arange(len(value)) - np.repeat(first[:-1], size) < np.repeat(keep, size)
                flat = pa.array(value[taken].view(np.int64))
                ends = pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(size.astype(np.int64)),
                        *[pa.array(d.view(np.int64)) for d in digests],
                        pa.ListArray.from_arrays(ends, flat),
                    ],
                    names=["doc_id", "n", "d1", "d2", "prefix"],
                )

    return run


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch.column(1), 2 << 20):
            value, first = shingle_sets(texts)
            sets = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64)))
            rep = batch.column(0).slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([rep, pa.array(np.diff(first).astype(np.int64)), sets], names=["rep", "n", "tokens"])


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of several ranges in a row, and where each one's begin."""
    begins = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(begins - begin, size), begins


def _compare(percent: int):
    """Links of a block: candidates share a prefix token under three orders; whole sets decide.

    Orders: rarest in the block first, and two hashes. Each is a total order of the
    tokens, so a pair at the threshold shares a prefix token under every one of them.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps = table["rep"].to_numpy()
        lists = table["tokens"].combine_chunks()
        value = lists.flatten().to_numpy().view(np.uint64)
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        first = np.cumsum(size) - size
        known, number, count = np.unique(value, return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(reps)), size)
        keep = size - _needed(size, percent) + 1
        orders = []
        for key in (count.astype(np.uint64), known, mix(known + np.uint64(7))):
            place = np.empty(len(known), np.int64)
            place[np.lexsort((known, key))] = np.arange(len(known))
            order = np.lexsort((place[number], doc))
            taken = np.arange(len(value)) - np.repeat(first, size) < np.repeat(keep, size)
            orders.append(number[order][taken])
        starts = np.cumsum(keep) - keep
        flag = np.zeros(len(known), bool)

        def hits(tokens: np.ndarray, begin: np.ndarray, length: np.ndarray, node: int, rest: np.ndarray) -> np.ndarray:
            """Tokens of ``node`` that each of ``rest`` has."""
            mine = tokens[begin[node] : begin[node] + length[node]]
            flag[mine] = True
            at, begins = _ranges(begin[rest], length[rest])
            found = np.add.reduceat(flag[tokens[at]].astype(np.int64), begins)
            flag[mine] = False
            return found

        def partners(node: int, rest: np.ndarray) -> np.ndarray:
            open_ = np.flatnonzero(100 * np.minimum(size[rest], size[node]) >= percent * np.maximum(size[rest], size[node]))
            for tokens in orders:
                if len(open_):
                    open_ = open_[hits(tokens, starts, keep, node, rest[open_]) > 0]
            linked = np.zeros(len(rest), bool)
            if len(open_):
                both = hits(number, first, size, node, rest[open_])
                linked[open_] = 100 * both >= percent * (size[node] + size[rest[open_]] - both)
            return linked

        edges, todo = [], np.ones(len(reps), bool)
        for root in range(len(reps)):
            if not todo[root]:
                continue
            todo[root] = False
            queue = [root]
            while queue:
                node = queue.pop()
                rest = np.flatnonzero(todo)
                if not len(rest):
                    break
                near = rest[partners(node, rest)]
                todo[near] = False
                edges += [(root, other) for other in near.tolist()]
                queue += near.tolist()
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(reps[pairs[:, 0]]), "b": pa.array(reps[pairs[:, 1]])})

    return run


def _shared(rows: DataFrame) -> DataFrame:
    """Tokens that two sets hold at least, with their number."""
    return rows.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > 1)


def _first_order(signed: DataFrame, firsts: DataFrame) -> DataFrame:
    """Representatives ``rep`` whose prefix in hash order shares enough tokens with other sets.

    A partner shares at least ``_needed`` tokens, of which all but ``n - _needed`` lie in any part of the set:
    a prefix longer by ``n / EXTRA`` than the shortest one has ``1 + n / EXTRA`` of them. An id that stands for
    several sets is judged by its smallest one and all their tokens, which only keeps more. ``signed`` isn't needed afterwards.
    """
    reps = signed.join(firsts, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"])
    rows = written(reps.select(F.col("doc_id").alias("rep"), F.explode("prefix").alias("token")), "order-1")
    drop_table(signed)
    shared = written(_shared(rows).select("token"), "order-1-shared")
    held = rows.join(shared, "token").groupBy("rep").agg(F.count("*").alias("held"))
    least = firsts.groupBy(F.col("doc_id").alias("_rep")).agg((1 + F.floor(F.min("n") / EXTRA)).alias("_least"))
    alive = held.join(least, held["rep"] == least["_rep"]).where(F.col("held") >= F.col("_least")).select("rep")
    alive = written(alive, "order-1-alive")
    drop_table(rows)
    drop_table(shared)
    return alive


def _second_order(sets: DataFrame, percent: int) -> DataFrame:
    """Prefix rows ``rep, token`` in order of document frequency, tokens that stand alone left out.

    The tokens of one set only come first in that order; they fill as much of a prefix as there are. An id
    that stands for several sets keeps all its shared tokens.
    """
    rows = sets.select("rep", F.explode("tokens").alias("token"))
    shared = written(_shared(rows), "order-2-shared")
    held = rows.join(shared, "token")
    one = Window.partitionBy("rep")
    place = F.row_number().over(one.orderBy("df", "token")).alias("place")
    ranked = held.select("rep", "token", F.count("*").over(one).alias("held"), place)
    needed = sets.groupBy(F.col("rep").alias("_rep")).agg(F.min("n").alias("_n"), F.count("*").alias("_sets"))
    needed = needed.select("_rep", F.when(F.col("_sets") == 1, F.floor((F.lit(percent) * F.col("_n") + 99) / 100)).otherwise(0).alias("_needed"))
    ranked = ranked.join(needed, ranked["rep"] == needed["_rep"])
    prefix = ranked.where(F.col("place") <= F.col("held") - F.col("_needed") + 1).select("rep", "token")
    prefix = written(prefix, "order-2-prefix")
    drop_table(shared)
    return prefix


def jaccard_components(
    docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per input row: ``doc_id, n_shingles, component_id``.

    Two documents link if 100 * shared shingles >= ``percent`` * all shingles of the two;
    ``component_id`` is the smallest id reachable over links, the document's own included. Shingles:
    five words ``[^\\x20\\x09-\\x0D]+`` in a row, ``A-Z`` in lower case, or the whole text if it has fewer.

    1. Equal sets are one class by their digests; its smallest id goes on.
    2. Prefixes in hash order, lengthened: sets that share too few of their prefix tokens have no partner.
    3. Prefixes in order of document frequency among what is left; sets that share a prefix token hang together in a cell.
    4. Inside a cell, candidates share a prefix token under three orders at once and are
       verified on whole sets. Large cells are cut in blocks without losing a link.
    5. Components of the links.

    No filter loses a pair, so links are exact up to the 64-bit hashes of shingles. A text without
    words has no shingles and links with nothing; so does a row with a null id (null
    component). Rows that repeat an id are one document: their links are joined. An empty
    table gives an empty result; other columns are not read.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    plain = docs.select(docs[id_column].cast("long").alias("doc_id"), text.alias("text"))
    signed = written(
        plain.mapInArrow(_signed(percent), "doc_id long, n long, d1 long, d2 long, prefix array<long>"), "join-signed"
    )
    named = written(signed.select("doc_id", "n", "d1", "d2"), "join-keys")
    usable = named.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(usable.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "join-classes")
    members = written(usable.join(classes, ["n", "d1", "d2"]).select("doc_id", "rep"), "join-members")
    alive = _first_order(signed, classes.select(F.col("rep").alias("doc_id"), "n", "d1", "d2"))
    # ``alive`` grows with the corpus, so its join is by sort and merge at every size.
    texts = plain.join(alive.hint("merge"), plain["doc_id"] == alive["rep"], "left_semi").distinct()
    sets = written(texts.mapInArrow(_whole_sets, "rep long, n long, tokens array<long>"), "join-sets")

    prefix = _second_order(sets, percent)
    hubs = prefix.groupBy("token").agg(F.min("rep").alias("b"))
    cells = components(prefix.join(hubs, "token").select(F.col("rep").alias("a"), "b"))
    cells = written(cells.select(F.col("node").alias("_node"), F.col("component").alias("cell")), "join-cells")
    rows = sets.join(cells, sets["rep"] == cells["_node"]).select("cell", "rep", F.col("n").alias("weight"), "tokens")
    links = linked_in_groups(rows, _compare(percent), "join")

    # An id that stands for several sets (a repeated id) ties them.
    several = members.groupBy("doc_id").agg(F.min("rep").alias("_lo"), F.max("rep").alias("_hi"))
    several = several.where(F.col("_lo") != F.col("_hi")).select("doc_id")
    ties = members.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = written(components(links.unionAll(ties)), "join-components")
    tied = members.join(found, members["rep"] == found["node"], "left")
    tied = tied.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    tied = tied.withColumnRenamed("doc_id", "_tied")
    out = named.join(tied, named["doc_id"] == tied["_tied"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

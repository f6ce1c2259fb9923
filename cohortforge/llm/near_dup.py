"""Near-duplicate documents by a chosen-path similarity join over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.components import components
from cohortforge.llm.tables import written
from cohortforge.llm.text import Words, mix, slices

SHINGLE_WORDS = 5
TREES = 8
DEPTH = 5
#: Minwise tokens of a tree: one for its root, two for each level below.
PER_TREE = 1 + 2 * (DEPTH - 1)
SKETCH = 128
#: Nodes and clusters of more documents are cut, see ``_cut``.
SMALL = 1000
#: Documents that every part of a cut node holds.
BRIDGES = 24


def branch_share(percent: int) -> float:
    """Share of the nodes in which a second branch follows, so that a pair at the threshold keeps one path alive on average, level by level."""
    return min(1.0, 100 / percent - 1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin (one more for the end).

    Five lower-cased words in a row are a shingle; the whole of a text with fewer words is one.
    """
    words = Words(texts, lower=True)
    hashes, whole = words.grams(SHINGLE_WORDS)
    values, docs = [hashes[whole]], [words.doc[: len(hashes)][whole]]
    n_words = np.diff(words.first)
    for size in range(1, SHINGLE_WORDS):
        short = np.flatnonzero(n_words == size)
        if len(short):
            grams, _ = words.grams(size, seed=size)
            values.append(grams[words.first[short]])
            docs.append(short.astype(np.int32))
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, two digests of the set, a one-permutation sketch and the trees' minwise tokens."""
    factors = mix(np.arange(1, TREES * PER_TREE + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        for at, texts in slices(batch.column(1), 2 << 20):
            value, first = shingle_sets(texts)
            sizes = np.diff(first)
            some = np.flatnonzero(sizes)
            begin = first[some]
            digests = [np.zeros(len(texts), np.uint64) for _ in range(2)]
            sketch = np.full(len(texts) * SKETCH, 0xFFFFFFFF, np.uint32)
            tokens = np.zeros((len(texts), TREES * PER_TREE), np.int32)
            if len(some):
                with np.errstate(over="ignore"):
                    digests[0][some] = np.add.reduceat(mix(value + np.uint64(17)), begin)
                    digests[1][some] = np.add.reduceat(mix(value * np.uint64(0x2545F4914F6CDD1D) + np.uint64(5)), begin)
                    for n, factor in enumerate(factors):
                        tokens[some, n] = (np.minimum.reduceat((value ^ factor) * factor, begin) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                slot = np.repeat(np.arange(len(texts)), sizes) * SKETCH + (value >> np.uint64(57)).astype(np.int64)
                # Values of a text are sorted, so the first in a slot is its least.
                head = np.ones(len(slot), bool)
                head[1:] = slot[1:] != slot[:-1]
                sketch[slot[head]] = (value[head] >> np.uint64(20)).astype(np.uint32)
            ids = batch.column(0).slice(at, len(texts))
            flat = pa.array(tokens.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(sizes.astype(np.int64)),
                    *[pa.array(d.view(np.int64)) for d in digests],
                    pa.array([r.tobytes() for r in sketch.reshape(-1, SKETCH)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TREES * PER_TREE), pa.int32()), flat),
                ],
                names=["doc_id", "n", "d1", "d2", "sketch", "tokens"],
            )


_SIGNED = "doc_id long, n long, d1 long, d2 long, sketch binary, tokens array<int>"


def _forest(size: int, partners) -> list[tuple[int, int]]:
    """Edges from the first node of each component of a graph to its others.

    ``partners(i, open)`` tells which of the open nodes i is tied to.
    """
    edges, todo = [], np.ones(size, bool)
    for root in range(size):
        if not todo[root]:
            continue
        todo[root] = False
        queue = [root]
        while queue:
            node = queue.pop()
            rest = np.flatnonzero(todo)
            if not len(rest):
                return edges
            for other in rest[partners(node, rest)].tolist():
                edges.append((root, other))
                todo[other] = False
                queue.append(other)
    return edges


def _alike(percent: int):
    """Compare the sketches of a small node exhaustively; edges that tie its components together."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps, sizes = table["rep"].to_numpy(), table["n"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint32).reshape(-1, SKETCH)
        filled = sketch != 0xFFFFFFFF

        def partners(node: int, rest: np.ndarray) -> np.ndarray:
            near = 100 * np.minimum(sizes[rest], sizes[node]) >= percent * np.maximum(sizes[rest], sizes[node])
            either = (filled[rest] | filled[node]).sum(axis=1)
            equal = ((sketch[rest] == sketch[node]) & filled[node]).sum(axis=1)
            # Few filled slots tell little: a few standard errors are allowed for.
            slack = 4.5 * np.sqrt(0.13 / np.maximum(either, 1))
            return near & (equal >= (percent / 100 - slack) * either)

        edges = np.array(_forest(len(reps), partners), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(reps[edges[:, 0]]), "b": pa.array(reps[edges[:, 1]])})

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch.column("text")):
            value, first = shingle_sets(texts)
            rep, cluster = (batch.column(n).slice(at, len(texts)) for n in ("rep", "cluster"))
            sets = [value[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([cluster, rep, pa.array(sets, pa.binary())], names=["cluster", "rep", "shingles"])


def _confirm(percent: int):
    """Links of a cluster on the full sets; edges that tie its components together."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        reps = table["rep"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        known, number = np.unique(np.concatenate(sets), return_inverse=True)
        flag = np.zeros(len(known), bool)

        def partners(node: int, rest: np.ndarray) -> np.ndarray:
            near = (100 * np.minimum(sizes[rest], sizes[node])) >= percent * np.maximum(sizes[rest], sizes[node])
            linked = np.zeros(len(rest), bool)
            some = np.flatnonzero(near)
            if len(some):
                mine = number[first[node] : first[node + 1]]
                flag[mine] = True
                begin, size = first[rest[some]], sizes[rest[some]]
                begins = np.concatenate([[0], np.cumsum(size)[:-1]])
                at = np.arange(size.sum()) - np.repeat(begins - begin, size)
                both = np.add.reduceat(flag[number[at]].astype(np.int64), begins)
                flag[mine] = False
                linked[some] = 100 * both >= percent * (sizes[node] + size - both)
            return linked

        edges = np.array(_forest(len(reps), partners), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(reps[edges[:, 0]]), "b": pa.array(reps[edges[:, 1]])})

    return run


def _cut(members: DataFrame, group: str, label: str) -> DataFrame:
    """``part`` for rows ``group, rep, ...``: groups of up to ``SMALL`` documents are one part.

    A larger group is cut into parts by a hash of the document, and its ``BRIDGES``
    documents of smallest hash stand in every part, so that parts of one dense group are tied to each other.
    """
    sizes = written(members.groupBy(group).agg(F.count("*").alias("_size"), F.min("rep").alias("_least")), f"{label}-sizes")
    many = sizes.where(F.col("_size") > 1)
    parts = F.ceil(F.col("_size") / SMALL)
    sized = members.join(many, group).withColumn("_parts", parts)
    draw = F.xxhash64("rep", group)
    own = F.pmod(draw, F.col("_parts"))
    # About BRIDGES of the documents, by hash, without gathering the group.
    bridge = F.pmod(F.xxhash64("rep", F.lit("bridge")), F.col("_size")) < BRIDGES
    every = F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)
    return sized.withColumn("part", F.explode(F.when((F.col("_parts") > 1) & bridge, every).otherwise(F.array(own)))).drop(
        "_size", "_least", "_parts"
    )


def _paths(reps: DataFrame, percent: int) -> DataFrame:
    """Leaves of all trees: ``node, rep``. A node with more than ``SMALL`` documents branches on the next tokens."""
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.slice("tokens", t * PER_TREE + 1, PER_TREE).alias("chosen")),
    )
    level = reps.where(F.col("n") > 0).select("rep", F.inline(trees))
    level = level.select("rep", "chosen", F.xxhash64("tree", F.get("chosen", F.lit(0))).alias("node"))
    leaves = None
    for depth in range(DEPTH):
        level = written(level, f"paths-{depth}")
        sizes = level.groupBy("node").agg(F.count("*").alias("_size")).where(F.col("_size") > 1)
        last = depth == DEPTH - 1
        small = sizes if last else sizes.where(F.col("_size") <= SMALL)
        found = level.join(small.select("node"), "node").select("node", "rep")
        leaves = found if leaves is None else leaves.unionAll(found)
        if last:
            break
        large = written(sizes.where(F.col("_size") > SMALL).select("node"), f"large-{depth}")
        if large.isEmpty():
            break
        at = 1 + 2 * depth
        first = F.xxhash64("node", F.lit(depth), F.get("chosen", F.lit(at)))
        second = F.xxhash64("node", F.lit(-depth - 1), F.get("chosen", F.lit(at + 1)))
        also = F.pmod(F.xxhash64("node", F.lit("branch")), F.lit(10_000)) < int(10_000 * branch_share(percent))
        branches = F.when(also, F.array(first, second)).otherwise(F.array(first))
        level = level.join(large, "node").select("rep", "chosen", F.explode(branches).alias("node"))
    return leaves


def near_duplicates(
    docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 * shared shingles >= ``percent`` * all shingles of the two,
    confirmed on full sets. ``component_id`` is the smallest id reachable over links, the
    document's own included; ``kept`` marks that one. Shingles: five lower-cased words
    (``A-Z`` only) ``[^\\x20\\x09-\\x0D]+`` in a row, or the whole text if it has fewer.

    1. Equal sets fall into one class by their digests, and only its smallest id goes on.
    2. Trees: a representative follows its minwise tokens; nodes of over ``SMALL`` documents branch again.
    3. Nodes are compared exhaustively by sketches, large ones of the last level in blocks; a spanning forest of each stays.
    4. Candidates that hang together are a cluster, compared on full sets, once each.
    5. Components of the confirmed links.

    A text without words has no shingles and is linked with nothing; so is a row with a null id
    (null component, kept). Rows that repeat an id are one document: their links are
    joined. An empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    plain = docs.select(docs[id_column].cast("long").alias("doc_id"), text.alias("text"))
    signed = written(plain.mapInArrow(_signed, _SIGNED), "signatures")
    named = signed.select("doc_id", "n", "d1", "d2")
    shared = named.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(shared.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "set-classes")
    members = written(shared.join(classes, ["n", "d1", "d2"]).select("doc_id", "rep", "n", "d1", "d2"), "set-members")
    own = members.where(F.col("doc_id") == F.col("rep")).select("doc_id", "d1", "d2").distinct()
    reps = signed.join(own, ["doc_id", "d1", "d2"]).dropDuplicates(["doc_id", "d1", "d2"])
    reps = written(reps.select(F.col("doc_id").alias("rep"), "n", "sketch", "tokens"), "set-reps")

    nodes = written(_cut(_paths(reps, percent), "node", "nodes"), "node-parts")
    sketched = nodes.join(reps.select("rep", "n", "sketch"), "rep")
    edges = "a long, b long"
    candidates = sketched.groupBy("node", "part").applyInArrow(_alike(percent), edges).distinct()
    candidates = _across_nodes(nodes, reps, written(candidates, "candidate-links"), percent)

    clusters = written(components(candidates).select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "clusters")
    sets = plain.join(clusters, plain["doc_id"] == clusters["rep"]).select("rep", "cluster", "text")
    sets = written(sets.mapInArrow(_shingled, "cluster long, rep long, shingles binary"), "cluster-sets")
    parts = _cut(sets, "cluster", "clusters")
    links = written(parts.groupBy("cluster", "part").applyInArrow(_confirm(percent), edges), "links")
    links = _across(sets, clusters, links, _confirm(percent))

    # An id that stands for several sets (a repeated id) ties them.
    ties = members.where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = members.join(members.groupBy("doc_id").count().where("count > 1").select("doc_id"), "doc_id")
    ties = ties.join(repeated.select(F.col("doc_id").alias("a")).distinct(), "a")
    found = written(components(links.unionAll(ties)), "components")
    linked = members.select("doc_id", "rep").distinct().join(found, F.col("rep") == F.col("node"), "left")
    linked = linked.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    linked = linked.withColumnRenamed("doc_id", "_linked")
    out = named.join(linked, named["doc_id"] == linked["_linked"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _across(rows: DataFrame, members: DataFrame, links: DataFrame, compare) -> DataFrame:
    """Links between the parts of groups that were cut.

    ``rows`` are those of ``members`` (``cluster, rep``) with what ``compare`` reads. The documents
    of a cut group that do not hang together with its largest component
    yet are compared with every part; the others need no further link among themselves.
    """
    large = members.groupBy("cluster").agg(F.count("*").alias("_size")).where(F.col("_size") > SMALL)
    large = written(large, "large-clusters")
    if large.isEmpty():
        return links
    inside = members.join(large, "cluster")
    tied = components(links)
    found = inside.join(tied, inside["rep"] == tied["node"], "left")
    found = found.select("cluster", "rep", "_size", F.coalesce("component", "rep").alias("component"))
    weights = found.groupBy("cluster", "component").count()
    main = weights.groupBy("cluster").agg(F.max(F.struct("count", "component")).alias("_main"))
    loose = found.join(main, "cluster").where(F.col("component") != F.col("_main.component"))
    loose = written(loose.select("cluster", "rep"), "loose")
    parts = F.ceil(F.col("_size") / SMALL)
    sized = rows.join(large, "cluster").withColumn("_parts", parts)
    base = sized.withColumn("part", F.pmod(F.xxhash64("rep", F.lit("across")), F.col("_parts")))
    counts = loose.groupBy("cluster").agg(F.count("*").alias("_loose")).withColumn("_cut", F.ceil(F.col("_loose") / SMALL))
    base = base.join(counts.select("cluster", "_cut"), "cluster")
    base = base.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cut") - 1)))
    base = base.select("part", "slot", *rows.columns)
    again = sized.join(loose, ["cluster", "rep"]).join(counts.select("cluster", "_cut"), "cluster")
    again = again.withColumn("slot", F.pmod(F.xxhash64("rep", F.lit("slot")), F.col("_cut")))
    again = again.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    again = again.select("part", "slot", *rows.columns)
    both = base.unionAll(again).dropDuplicates(["cluster", "part", "slot", "rep"])
    more = both.groupBy("cluster", "part", "slot").applyInArrow(compare, "a long, b long")
    return links.unionAll(written(more, "links-across"))


def _across_nodes(nodes: DataFrame, reps: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates between the parts of nodes that were still large at the last level."""
    cut = written(nodes.where(F.col("part") > 0).select("node").distinct(), "cut-nodes")
    if cut.isEmpty():
        return candidates
    # A bridge stands in every part.
    members = written(nodes.join(cut, "node").select(F.col("node").alias("cluster"), "rep").distinct(), "cut-members")
    rows = members.join(reps.select("rep", "n", "sketch"), "rep").select("cluster", "rep", "n", "sketch")
    return written(_across(rows, members, candidates, _alike(percent)).distinct(), "candidate-links-all")

"""Suffix classes of line-id sequences by prefix doubling; maximal repeated line runs from LCP intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortforge.llm.tables import drop_table, numbered, written

KEY = ["doc_id", "text_key"]
PLACE = [*KEY, "line"]
#: A place of the state of ``longest_earlier`` and the interval it lies in.
ROW = [*PLACE, "length", "node"]


def _place() -> Column:
    return F.struct(*PLACE)


def _named(parts: DataFrame, by: list[str], label: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Name every position by the first that holds the same content; drop the unique ones.

    Names are minima over all positions of a content, summed up before the shuffle, and
    come back by a join that may split hot contents.
    """
    firsts = parts.groupBy(*by).agg(F.min(_place()).alias("_first"), F.max(_place()).alias("_last"))
    firsts = written(firsts.where(F.col("_first") != F.col("_last")).drop("_last"), f"{label}-names")
    out = written(parts.join(firsts, by).select(*PLACE, *extra, F.col("_first").alias("name")), f"{label}-level")
    drop_table(firsts)
    drop_table(parts)
    return out


def suffix_levels(docs: DataFrame) -> list[DataFrame]:
    """Suffix classes: table k names each position by the first with the same 2**k lines, repeated ones only.

    A round of prefix doubling names runs of 2k lines by the names of their two halves.
    Suffixes that have become unique, or end, leave; rounds go on until none is left. Table 0
    also has the number of ``words`` of each line.
    """
    cut = docs.select(*KEY, F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    lines = cut.select(
        *PLACE,
        F.xxhash64("content").alias("c1"),
        F.xxhash64(F.lit("line"), "content").alias("c2"),
        F.size(F.array_remove(F.split("content", "[\\x20\\x09-\\x0D]+"), "")).alias("words"),
    )
    levels = [_named(written(lines, "lines"), ["c1", "c2"], "line", ("words",))]
    while True:
        step = 1 << (len(levels) - 1)
        order = Window.partitionBy(*KEY).orderBy("line").rangeBetween(step, step)
        pairs = levels[-1].select(*PLACE, F.col("name").alias("half"), F.min("name").over(order).alias("second"))
        # Rows that repeat an id and its text are one document.
        pairs = pairs.where(F.col("second").isNotNull()).dropDuplicates(PLACE)
        level = _named(written(pairs, "line-pairs"), ["half", "second"], "run")
        if level.isEmpty():
            drop_table(level)
            return levels
        levels.append(level)


def _descended(state: DataFrame, level: DataFrame, step: int) -> DataFrame:
    """Move rows of an interval that share the next ``step`` lines to the interval they form.

    The first of those that move also stays, for rows that share fewer lines with them.
    """
    ahead = level.select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("line").alias("_line"), F.col("name").alias("_next")
    )
    on = (state["doc_id"] == ahead["_doc"]) & (state["text_key"] == ahead["_key"])
    on = on & (state["line"] + state["length"] == ahead["_line"])
    looked = written(state.join(ahead, on, "left").select(*ROW, "_next"), "line-ahead")
    by = ["length", "node", "_next"]
    groups = looked.where(F.col("_next").isNotNull()).groupBy(*by).agg(F.min(_place()).alias("_lo"), F.max(_place()).alias("_hi"))
    groups = groups.where(F.col("_lo") != F.col("_hi")).drop("_hi")
    moved = looked.join(groups, by, "left")
    here = F.struct(F.col("length"), F.col("node"))
    deeper = F.struct((F.col("length") + step).alias("length"), F.col("_lo").alias("node"))
    to = F.when(F.col("_lo").isNull(), F.array(here)).when(F.col("_lo") == _place(), F.array(here, deeper)).otherwise(F.array(deeper))
    out = written(moved.select(*PLACE, F.explode(to).alias("_to")).select(*PLACE, "_to.length", "_to.node"), "line-intervals")
    drop_table(looked)
    return out


def longest_earlier(levels: list[DataFrame], least: int) -> DataFrame:
    """For each position the longest run, of ``least`` lines or more, that also begins at an earlier one: ``length, source``.

    The intervals of common prefixes are found from the longest steps to single lines. A
    position enters at its longest level; ``node`` is the first position of its interval and
    ``length`` the interval's common prefix. An interval's members that agree on the next
    2**k lines form an interval within it. All but the first of an interval repeat an earlier
    position; the deepest such interval of a position has its longest one.
    """
    state = None
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        if state is not None:
            before, state = state, _descended(state, levels[k].dropDuplicates(PLACE) if k == 0 else levels[k], step)
            drop_table(before)
        if 2 * step <= least:
            continue
        enter = levels[k].select(*PLACE, F.lit(step).alias("length"), F.col("name").alias("node"))
        if k + 1 < len(levels):
            gone = levels[k + 1].where(F.col("name") != _place()).select(*PLACE)
            enter = enter.join(gone, PLACE, "left_anti")
        if k == 0:
            enter = enter.dropDuplicates(PLACE)
        before, state = state, written(enter if state is None else state.unionByName(enter), "line-intervals")
        if before is not None:
            drop_table(before)
    if state is None:
        none = levels[0].select(*PLACE, F.lit(0).alias("length"), F.col("name").alias("node"))
        state = none.where(F.lit(False))
    found = state.where((F.col("node") < _place()) & (F.col("length") >= least))
    best = found.groupBy(*PLACE).agg(F.max(F.struct("length", "node")).alias("_best"))
    return best.select(*PLACE, F.col("_best.length").alias("length"), F.col("_best.node").alias("source"))


def maximal_runs(levels: list[DataFrame], min_lines: int = 2) -> DataFrame:
    """Maximal repeated runs: ``doc_id, text_key, line, length, source``.

    A run of ``length`` lines from ``line`` also begins at ``source``, an earlier place (in a
    document with a smaller id, or further up); no run of the document that has an earlier
    copy holds it. Runs may overlap.
    """
    longest = longest_earlier(levels, min_lines)
    end = F.col("line") + F.col("length")
    before = Window.partitionBy(*KEY).orderBy("line").rangeBetween(-1, -1)
    ends = longest.withColumn("_before", F.max(end).over(before))
    return ends.where(F.col("_before").isNull() | (F.col("_before") < end)).drop("_before")


def repeated_runs(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """``maximal_runs`` of documents with ``doc_id, text_key, text``."""
    return maximal_runs(suffix_levels(docs), min_lines)


def repeated_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 8) -> DataFrame:
    """Lines to delete, ``doc_id, text_key, line``: those of maximal runs, and single ones of ``min_words`` words."""
    levels = suffix_levels(docs)
    runs = maximal_runs(levels, min_lines)
    inside = F.explode(F.sequence(F.col("line"), F.col("line") + F.col("length") - 1)).alias("line")
    alone = levels[0].where((F.col("name") < _place()) & (F.col("words") >= min_words)).select(*PLACE)
    gone = written(runs.select(*KEY, inside).unionAll(alone).distinct(), "line-marks")
    for level in levels:
        drop_table(level)
    return gone


def dedup_lines(
    docs: DataFrame,
    min_lines: int = 2,
    min_words: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs``, with later copies of repeated line runs deleted.

    Lines are what line feeds separate. A line goes if it is one of ``min_lines`` lines in
    a row that also stand, in that order, in a document with a smaller id or further up in
    its own; or if it has ``min_words`` words at least and stands there by itself. Lines
    are compared whole and unchanged, on the input, whatever is deleted of the other copy.
    ``repeated_runs`` has the maximal runs with their sources.
    Adds ``n_lines``, ``n_removed``; replaces the text by the lines that are left.

    A null text stays null with no lines; an empty text is one line; rows with a null id
    are neither compared nor changed (0 removed); rows equal in id and text are one
    document and end alike; rows with one id and several texts are documents of their own,
    ordered by a hash of their text. Columns named like an added one are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = docs[text_column]
    keyed = numbered(docs, kept, _id=docs[id_column], _key=F.xxhash64(text), _lines=F.split(text, "\n", -1))
    plain = docs.where(docs[id_column].isNotNull() & docs[text_column].isNotNull()).select(
        docs[id_column].alias("doc_id"), F.xxhash64(docs[text_column]).alias("text_key"), docs[text_column].alias("text")
    )
    gone = repeated_lines(plain, min_lines, min_words)
    gone = gone.groupBy(*KEY).agg(F.collect_set("line").alias("_gone"))
    gone = written(gone.withColumnsRenamed({"doc_id": "_gone_id", "text_key": "_gone_key"}), "lines-gone")
    joined = keyed.join(gone, (F.col("_id") == F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return joined.select(
        *[
            F.when(F.col("_gone").isNull(), F.col(f"_{n}")).otherwise(text).alias(c) if c == text_column else F.col(f"_{n}").alias(c)
            for n, c in enumerate(kept)
        ],
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"),
    )


DEDUP_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content,
    generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY line) AS follows,
    lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS next_line,
    len(list_filter(regexp_split_to_array(content, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words FROM l
), f AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, line) > 1 AS seen,
    next_line IS NOT NULL AND row_number() OVER (
      PARTITION BY content, follows, next_line IS NULL ORDER BY doc_id, line) > 1 AS pair_seen
  FROM p
), g AS (
  SELECT *, pair_seen OR (seen AND words >= 8)
    OR coalesce(lag(pair_seen) OVER (PARTITION BY doc_id ORDER BY line), false) AS gone
  FROM f
)
SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(sum(gone::INT) AS INT) AS n_removed,
  sha256(coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""

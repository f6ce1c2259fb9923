"""Benchmark passages in training text, found by spaced seeds; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.llm.tables import ascii_words, written

WINDOW = 13
MOST_CHANGED = 2
#: Positions that count; the others are ignored. Any two changed words of 13 in a row leave
#: room for one of the two, so no overlap of that kind is missed.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 1 + max(MASKS[0] + MASKS[1])
#: Up to so many benchmark seeds (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased words, as both sides compare them."""
    return ascii_words(F.lower(text))


def _seeds(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys, ``pos`` and one 64-bit seed for each mask at every position with ``SPAN`` words."""
    # The words' hashes, as every mask reads each of them again.
    hashed = df.select(*keys, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("_h"))
    used = sorted(set().union(*MASKS))
    shifted = [F.slice("_h", o + 1, F.greatest(F.size("_h") - SPAN + 1, F.lit(0))).alias(f"h{o}") for o in used]
    at = hashed.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "_z"))
    seed = [F.xxhash64(F.lit(n), *[F.col(f"_z.h{o}") for o in mask]).alias(f"seed{n}") for n, mask in enumerate(MASKS)]
    return at.select(*keys, "pos", *seed)


def hits(docs: DataFrame, items: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Distinct ``(doc_id, text_key, item_id, shift)`` whose texts share a seed.

    ``shift`` is the document's word position of the item's first word. Documents are
    looked up against the distinct benchmark seeds as they are scanned; only positions
    that hit go on. Beyond ``broadcast_seeds`` the positions are shuffled by seed instead.
    """
    parts = [
        F.struct(F.col(f"seed{n}").alias("seed"), F.lit(n).alias("mask")) for n in range(len(MASKS))
    ]
    item_seeds = written(
        _seeds(items, ["item_id"], "item_text").select("item_id", "pos", F.inline(F.array(*parts))), "item-seeds"
    )
    distinct = item_seeds.select("seed").distinct()
    at = _seeds(docs, ["doc_id", "text_key"], "text")
    if item_seeds.count() <= broadcast_seeds:
        small = F.broadcast(distinct)
        for n in range(len(MASKS)):
            found = small.select(F.col("seed").alias(f"seed{n}"), F.lit(True).alias(f"hit{n}"))
            at = at.join(found, f"seed{n}", "left")
        at = at.where(F.col("hit0") | F.col("hit1"))
        at = at.select("doc_id", "text_key", F.col("pos").alias("doc_pos"), F.inline(F.array(*parts)))
    else:
        at = at.select("doc_id", "text_key", F.col("pos").alias("doc_pos"), F.inline(F.array(*parts)))
    joined = at.join(item_seeds, ["seed", "mask"])
    return joined.select("doc_id", "text_key", "item_id", (F.col("doc_pos") - F.col("pos")).alias("shift")).distinct()


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    most_changed: int = MOST_CHANGED,
) -> DataFrame:
    """Pairs of a document and a benchmark item it holds a passage of.

    A pair counts if, for some alignment, ``window`` words in a row of the item stand in
    the document with ``most_changed`` of them changed at most. An item of 8 to
    ``window - 1`` words must stand there whole and unchanged; shorter ones are too common
    to tell and never count. Per pair, of its best alignment: ``doc_id, item_id, shift``
    (word position in the document of the item's first word), ``n_words`` of the item,
    ``n_equal`` of them, and ``best_window``, the most equal words of any window.

    Null ids and null or empty texts are in no pair; rows that repeat an id are each
    compared, and the pair has the best; ties go to the smallest shift; an empty table on
    either side gives an empty result; other columns are not read. ``window`` over 13 or
    fewer changes are found too; the seeds are complete for these settings only.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    docs = docs.where(docs[id_column].isNotNull()).select(
        docs[id_column].alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )
    items = benchmark.where(benchmark[item_column].isNotNull()).select(
        benchmark[item_column].alias("item_id"), benchmark[item_text_column].alias("item_text")
    )
    candidates = written(hits(docs, items), "leak-candidates")
    item_words = items.select("item_id", words(F.col("item_text")).alias("_item")).where(F.size("_item") >= SPAN)
    pairs = candidates.join(item_words.distinct(), "item_id")
    compared = pairs.join(docs, ["doc_id", "text_key"])
    # The document's words beside the item's, cut out once for each pair: a lambda that
    # reads them by place would split the text again for each place.
    size = F.size("_item")
    ahead = F.array_repeat(F.lit(None).cast("string"), F.greatest(-F.col("shift"), F.lit(0)))
    first = F.greatest(F.col("shift"), F.lit(0)) + 1
    beside = F.concat(ahead, F.slice(words(F.col("text")), first, size))
    equal = F.zip_with(F.slice(beside, F.lit(1), size), "_item", lambda w, v: F.coalesce(w == v, F.lit(False)).cast("int"))
    compared = compared.select("doc_id", "item_id", "shift", size.alias("n_words"), F.slice(equal, F.lit(1), size).alias("_eq"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, e: s + e)
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("n_words") - window, F.lit(0))),
            lambda s: total(F.slice("_eq", s + 1, window)),
        )
    )
    scored = compared.select("doc_id", "item_id", "shift", "n_words", best.alias("best_window"), total(F.col("_eq")).alias("n_equal"))
    needed = F.when(F.col("n_words") >= window, window - most_changed).otherwise(F.col("n_words"))
    kept = scored.where(F.col("best_window") >= needed)
    order = F.struct("best_window", "n_equal", (-F.col("shift")).alias("near"), "n_words")
    top = kept.groupBy("doc_id", "item_id").agg(F.max(order).alias("top"))
    return top.select(
        "doc_id",
        "item_id",
        (-F.col("top.near")).alias("shift"),
        F.col("top.n_words").alias("n_words"),
        F.col("top.n_equal").alias("n_equal"),
        F.col("top.best_window").alias("best_window"),
    )


OVERLAP_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM benchmark WHERE item_id IS NOT NULL
), dw AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
iw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS q FROM i WHERE len(ws) >= 8),
same AS (SELECT doc_id, item_id, n, p - q AS shift, q FROM dw JOIN iw USING (w)),
lines AS (
  SELECT doc_id, item_id, n, shift, count(*) AS n_equal, list(q) AS qs FROM same
  GROUP BY ALL HAVING count(*) >= least(n, 11)
),
windows AS (
  SELECT doc_id, item_id, n, shift, n_equal, unnest(range(0, greatest(n - 13, 0) + 1)) AS s, qs FROM lines
),
best AS (
  SELECT doc_id, item_id, n, shift, n_equal, max(len(list_filter(qs, lambda q: q >= s AND q < s + 13))) AS best_window
  FROM windows GROUP BY ALL
)
SELECT doc_id, item_id, CAST(shift AS INT) AS shift, CAST(n AS INT) AS n_words, CAST(n_equal AS INT) AS n_equal,
  CAST(best_window AS INT) AS best_window
FROM best WHERE best_window >= CASE WHEN n >= 13 THEN 11 ELSE n END
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best_window DESC, n_equal DESC, shift) = 1
"""

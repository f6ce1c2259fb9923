"""Comparable pairs and their credit inside one key of bounded size, for many weightings at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from cohortforge.functions.digests import md5_heads

RISK_TIE = 1e-8
#: Up to so many rows every event is compared with all later ones directly.
DIRECT_ROWS = 512
EVENTS_AT_ONCE = 256
#: Weights held at once as floating numbers: rows times columns.
CELLS_AT_ONCE = 500_000
#: Counts that a drawing task holds at once: slots times draws.
WINDOW_CELLS = 8_000_000
#: Nanoseconds a column: one event against one row, one node, one row at one level.
PAIR_COST, NODE_COST, LEVEL_COST = 0.07, 150.0, 4.0


def concordant(
    time: np.ndarray, event: np.ndarray, risk: np.ndarray, weight: np.ndarray, at: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted comparable pairs and credit for each column of ``weight`` (rows x columns).

    An event's partners are later in time, or censored at the same time. A pair weighs the product of its two
    weights; a partner of lower risk gives full credit and one of a risk within ``RISK_TIE`` half.
    ``at`` names the row of ``weight`` that each row has, its own if not given.
    """
    _, moment = np.unique(time, return_inverse=True)
    code = 2 * moment + (event != 1)
    order = np.argsort(code, kind="stable")
    code, risk = code[order], risk[order]
    source = order if at is None else at[order]
    levels, place = np.unique(risk, return_inverse=True)
    cases = np.flatnonzero(code % 2 == 0)
    start = np.searchsorted(code, code[cases], side="right")
    lower = np.searchsorted(levels, risk[cases] - RISK_TIE, side="left")
    upto = np.searchsorted(levels, risk[cases] + RISK_TIE, side="right")
    columns = weight.shape[1]
    comparable, credit = np.zeros(columns), np.zeros(columns)
    if not len(cases):
        return comparable, credit
    _, code = np.unique(code, return_inverse=True)
    shift = _leaf_digits(code, cases)
    leaf = code >> shift
    for first, last in _leaves(leaf, cases, shift):
        one, rows = slice(first, last), slice(start[first], np.searchsorted(leaf, leaf[cases[first]], side="right"))
        credit += _direct(place, rows, start[one], lower[one], upto[one], weight[source[cases[one]]], weight[source[rows]])
    step = max(16, CELLS_AT_ONCE // len(code))
    halves = _halves(code, place, cases, lower, upto, shift)
    if columns > step:
        halves = list(halves)
    cuts = np.flatnonzero(np.diff(code, prepend=-1))
    asks = np.flatnonzero(np.isin(code[cuts], code[cases]))
    running = np.zeros(len(code) + 1)
    for left in range(0, columns, step):
        # One column after the other: running totals over neighbours in memory.
        part = np.ascontiguousarray(weight[source, left : left + step].T)
        own = part[:, cases].astype(float)
        sums = np.add.reduceat(part, cuts, axis=1, dtype=float)
        later = np.cumsum(sums[:, ::-1], axis=1)[:, ::-1] - sums
        comparable[left : left + step] = np.einsum("ij,ij->i", sums[:, asks], later[:, asks])
        for order, asked, first, low, high in halves:
            if not (len(order) and len(asked)):
                continue
            nodes = np.flatnonzero(np.diff(first, prepend=-1))
            tied = np.flatnonzero(high > low)
            upper, first = high[tied], first[nodes]
            for at, (column, events) in enumerate(zip(part, own), left):
                np.cumsum(column.take(order), out=running[1 : len(order) + 1], dtype=float)
                events = events.take(asked)
                below = running.take(low)
                found = events @ below - np.add.reduceat(events, nodes) @ running.take(first)
                if len(tied):
                    found += 0.5 * (events.take(tied) @ (running.take(upper) - below.take(tied)))
                credit[at] += found
    return comparable, credit


def _leaf_digits(code: np.ndarray, cases: np.ndarray) -> int:
    """How many of the last binary digits of a time code are left to direct comparison."""
    digits = int(code[-1]).bit_length()
    if len(code) <= DIRECT_ROWS:
        return digits

    def cost(shift: int) -> float:
        node = code >> shift
        events = np.bincount(node[cases], minlength=node[-1] + 1)
        pairs = float(np.bincount(node) @ events)
        return PAIR_COST * pairs + NODE_COST * np.count_nonzero(events) + LEVEL_COST * (digits - shift) * len(code)

    return min(range(digits + 1), key=cost)


def _leaves(leaf, cases, shift):
    """Runs of events of one leaf; leaves without digits have no pairs."""
    if not shift:
        return []
    cuts = np.flatnonzero(np.diff(leaf[cases])) + 1
    return zip(np.r_[0, cuts], np.r_[cuts, len(cases)])


def _direct(place, rows, start, lower, upto, own, weight) -> np.ndarray:
    """Credit from every event and every later one of the rows, in blocks of events."""
    total = np.zeros(weight.shape[1])
    weight, number = weight.astype(float), np.arange(rows.start, rows.stop)
    for at in range(0, len(start), EVENTS_AT_ONCE):
        part = slice(at, at + EVENTS_AT_ONCE)
        share = 0.5 * (place[rows] < lower[part, None]) + 0.5 * (place[rows] < upto[part, None])
        share *= number >= start[part, None]
        total += np.einsum("ij,ij->j", own[part].astype(float), share @ weight)
    return total


def _halves(code, place, cases, lower, upto, shift):
    """Events against the rows whose codes first differ from theirs, and are higher, in one digit above ``shift``.

    For each digit: the rows that have it, by what precedes it and by risk, and for each event without it where those of
    its node begin and where their lower and not higher risks end.
    """
    width = int(upto.max()) + int(place.max()) + 2
    for level in range(shift, int(code[-1]).bit_length()):
        node = code >> (level + 1)
        rows = np.flatnonzero((code >> level) & 1)
        key = node[rows] * width + place[rows]
        by_risk = np.argsort(key, kind="stable")
        rows, key = rows[by_risk], key[by_risk]
        asked = np.flatnonzero(((code[cases] >> level) & 1) == 0)
        begin = node[cases[asked]] * width
        yield rows, asked, *(np.searchsorted(key, begin + limit) for limit in (0, lower[asked], upto[asked]))


def key_totals(keys: list[str]):
    """For ``applyInArrow``: ``comparable, credit`` of one key's rows ``_t, _e, _r, _w``."""

    def run(table: pa.Table) -> pa.Table:
        time, event, risk, weight = (table[c].to_numpy() for c in ("_t", "_e", "_r", "_w"))
        comparable, credit = concordant(time, event, risk, weight[:, None])
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "comparable": comparable, "credit": credit})

    return run


def packed(values: np.ndarray) -> bytes:
    """An array's bytes, the first of every value before the second, compressed."""
    return pa.compress(values.reshape(-1, 1).view(np.uint8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str, size: int) -> np.ndarray:
    """The ``size`` values of ``kind`` that ``packed`` was given."""
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=size * width, codec="zstd")
    values = np.zeros(size, f"<u{width}")
    for place, part in enumerate(np.frombuffer(raw, np.uint8).reshape(width, size)):
        if part.any():
            values |= part.astype(values.dtype) << (8 * place)
    return values.view(kind)


def drawn_slots(by: list[str], seed: int, slots: int, bin_slots: int):
    """For ``mapInArrow``: how often the slots from ``_from`` on select each slot in the draws from ``_first`` up to ``_last``, among ``_n``.

    A result row has the counts of one bin of ``bin_slots`` slots, those of a slot in the ``_draws`` draws side by side; a slot
    selected from several ranges has its counts in as many rows.
    """

    def run(batches):
        for batch in batches:
            for unit in batch.to_pylist():
                n, upto, first = unit["_n"], min(unit["_from"] + slots, unit["_n"]), unit["_first"]
                draws = unit["_last"] - first
                heads = md5_heads([b"%d|%d|" % (seed, first + d + 1) for d in range(draws)], unit["_from"], upto)
                # The first 15 hexadecimal digits.
                chosen = ((heads >> np.uint64(4)) % np.uint64(n)).view(np.int64)
                window = bin_slots * max(1, WINDOW_CELLS // (bin_slots * draws))
                for low in range(0, n, window):
                    high = min(low + window, n)
                    counts = np.empty((high - low, draws), "<u2")
                    for d, own in enumerate(chosen):
                        if high - low < n:
                            own = own[(own >= low) & (own < high)]
                        counts[:, d] = np.bincount(own - low, minlength=high - low)
                    parts = [(low + at, counts[at : at + bin_slots]) for at in range(0, high - low, bin_slots)]
                    parts = [(at, part) for at, part in parts if part.any()]
                    yield pa.record_batch({
                        **{k: pa.array([unit[k]] * len(parts), batch.schema.field(k).type) for k in by},
                        "_bin": pa.array([at // bin_slots for at, _ in parts], pa.int64()),
                        "_first": pa.array([first] * len(parts), pa.int32()),
                        "_draws": pa.array([draws] * len(parts), pa.int32()),
                        "_slots": pa.array([len(part) for _, part in parts], pa.int32()),
                        "_counts": pa.array([packed(part) for _, part in parts], pa.binary()),
                    })

    return run


def _block_counts(drawn: pa.Table, block_draws: int, bin_slots: int):
    """Each block with its counts, slots of one bin by draws of the block, from the rows of ``drawn_slots``."""
    first = drawn["_first"].to_numpy()
    for block in np.unique(first // block_draws):
        counts = np.zeros((bin_slots, block_draws), "<u2")
        for row in drawn.take(np.flatnonzero(first // block_draws == block)).to_pylist():
            left, size = row["_first"] % block_draws, row["_slots"] * row["_draws"]
            counts[: row["_slots"], left : left + row["_draws"]] += unpacked(row["_counts"], "<u2", size).reshape(-1, row["_draws"])
        yield int(block), counts


def slot_lists(by: list[str], block_draws: int, bin_slots: int):
    """For a cogroup's ``applyInArrow``: ``sample_id, _block, _chosen`` of one bin, from the rows of ``drawn_slots`` and the bin's samples by ``_slot``."""

    def run(drawn: pa.Table, samples: pa.Table) -> pa.Table:
        place, parts = samples["_slot"].to_numpy() % bin_slots, []
        for block, counts in _block_counts(drawn, block_draws, bin_slots):
            some = np.flatnonzero(counts[place].any(axis=1))
            chosen = [np.repeat(np.arange(block_draws, dtype=np.uint8), counts[place[s]]).tobytes() for s in some]
            own = samples.select([*by, "sample_id"]).take(some)
            parts.append(own.append_column("_block", pa.array([block] * len(some), pa.int32())).append_column("_chosen", pa.array(chosen, pa.binary())))
        if not parts:
            none = samples.select([*by, "sample_id"]).slice(0, 0)
            return none.append_column("_block", pa.array([], pa.int32())).append_column("_chosen", pa.array([], pa.binary()))
        return pa.concat_tables(parts)

    return run


def fold_counts(by: list[str], block_draws: int, bin_slots: int):
    """For a cogroup's ``applyInArrow``: what each fold and block needs of one bin, from the rows of ``drawn_slots`` and the bin's cases.

    A row has the ``_counts`` of the fold's ``_size`` patients, and for each model the cases of its patients, packed, ``at``
    naming the row of the counts. Models without a patient picked in the block are left out.
    """

    def run(drawn: pa.Table, cases: pa.Table) -> pa.Table:
        cases = cases.combine_chunks()
        place = cases["_slot"].to_numpy() % bin_slots
        kinds = {"t": "<f8", "e": "<i4", "r": "<f8"}
        values = {k: cases[f"_{k}"].to_numpy().astype(kind) for k, kind in kinds.items()}
        codes = [cases[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in ("repeat", "fold", "model")]
        fold = codes[0].astype(np.int64) * (len(place) + 1) + codes[1]
        order = np.argsort(fold, kind="stable")
        folds = []
        for own in np.split(order, np.flatnonzero(np.diff(fold[order])) + 1) if len(place) else []:
            places, at = np.unique(place[own], return_inverse=True)
            models = [(own[codes[2][own] == m], at[codes[2][own] == m]) for m in np.unique(codes[2][own])]
            lists = [
                {"model": cases["model"][int(rows[0])].as_py(), "n": len(rows), "at": packed(at.astype("<u4")), **{k: packed(v[rows]) for k, v in values.items()}}
                for rows, at in models
            ]
            folds.append((int(own[0]), places, [at for _, at in models], lists))
        found: dict[str, list] = {k: [] for k in ("_row", "_block", "_size", "_counts", "_cases")}
        for block, counts in _block_counts(drawn, block_draws, bin_slots):
            picked = counts.any(axis=1)
            for row, places, ats, lists in folds:
                held = [own for own, at in zip(lists, ats) if picked[places[at]].any()]
                if held:
                    for k, v in zip(found, (row, block, len(places), packed(counts[places]), held)):
                        found[k].append(v)
        lists = pa.list_(pa.struct([("model", cases.schema.field("model").type), ("n", pa.int32()), *[(k, pa.binary()) for k in ("at", *kinds)]]))
        rows = cases.select([*by, "repeat", "fold"]).take(pa.array(found["_row"], pa.int64()))
        for k, kind in (("_block", pa.int32()), ("_size", pa.int32()), ("_counts", pa.binary()), ("_cases", lists)):
            rows = rows.append_column(k, pa.array(found[k], kind))
        return rows

    return run


def draw_totals(keys: list[str], block_draws: int):
    """For ``applyInArrow``: a row per model and draw of one block, from the rows of ``fold_counts`` of one fold."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table["_size"].to_numpy()
        ends = np.cumsum(sizes)
        weight = np.empty((ends[-1], block_draws), np.uint16)
        for end, size, counts in zip(ends, sizes, table["_counts"]):
            weight[end - size : end] = unpacked(counts.as_buffer(), "<u2", size * block_draws).reshape(size, block_draws)
        models: dict = {}
        for begin, lists in zip(ends - sizes, table["_cases"].to_pylist()):
            for own in lists:
                at = unpacked(own["at"], "<u4", own["n"]).astype(np.int64) + begin
                models.setdefault(own["model"], []).append((at, *[unpacked(own[k], kind, own["n"]) for k, kind in (("t", "<f8"), ("e", "<i4"), ("r", "<f8"))]))
        draw = table["_block"][0].as_py() * block_draws + np.arange(block_draws, dtype=np.int32) + 1
        once, parts = np.zeros(block_draws, np.int64), []
        name = table.schema.field("_cases").type.value_type.field("model").type
        for model, cases in models.items():
            at, time, event, risk = (np.concatenate(c) for c in zip(*cases))
            comparable, credit = concordant(time, event, risk, weight, at)
            found = {**{k: table[k].take(once) for k in keys if k != "model"}, "model": pa.array([model] * block_draws, name)}
            parts.append(pa.table({**{k: found[k] for k in keys}, "draw": draw, "comparable": comparable, "credit": credit}))
        return pa.concat_tables(parts)

    return run


def permuted_totals(keys: list[str], repeats: int):
    """For ``applyInArrow``: ``c_index`` of each ``permutation`` of one key's rows ``sample_id, part, risk, _t, _e, _prefix``.

    Contributions go from the order of the digests of (prefix, permutation, sample) to that of the samples' digests.
    """

    def order(texts) -> np.ndarray:
        return np.argsort(np.array([hashlib.md5(t.encode()).digest().hex() for t in texts], "S32"), kind="stable")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("sample_id").combine_chunks()
        part, risk, time, event = (table[c].to_numpy().astype(float) for c in ("part", "risk", "_t", "_e"))
        names, prefix = table["sample_id"].to_pylist(), table["_prefix"][0].as_py()
        taker, found = order(names), []
        for number in range(1, repeats + 1):
            given = np.empty_like(part)
            given[taker] = part[order(f"{prefix}|{number}|{n}" for n in names)]
            moved = risk - part + given
            known = ~(np.isnan(moved) | np.isnan(time) | np.isnan(event))
            one = np.ones((int(known.sum()), 1))
            comparable, credit = concordant(time[known], event[known], moved[known], one)
            found.append(float(credit[0] / comparable[0]) if comparable[0] else None)
        once = np.zeros(repeats, np.int64)
        numbers = pa.array(np.arange(1, repeats + 1), pa.int32())
        return pa.table({**{k: table[k].take(once) for k in keys}, "permutation": numbers, "c_index": pa.array(found, pa.float64())})

    return run

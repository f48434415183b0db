"""Scores of blocks of chunks for a batch of queries: what a scoring task does with its postings.

Postings come in the order of their chunks, so a block of chunks is complete once the next chunk begins. A block's scores are sums over cells
of a table of query terms (or fields) by chunks; what a task keeps of them is bounded by what is asked for, however many chunks match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CELLS = 1 << 18  # of a block, by query terms and chunks
ROWS = 1 << 17  # postings read before blocks are made of them
PENDING = 1 << 16  # rows in question before the best of them are chosen
_COARSE, _FINE, _UNIT = float(1 << 20), float(1 << 26), float(1 << 46)  # as in ``sizing.exact_sum``
_EXACT = float(1 << 53)


def _parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``exact_sum`` adds up, as whole numbers."""
    scaled = values * _COARSE
    coarse = np.floor(scaled)
    return coarse, np.rint((scaled - coarse) * _FINE)


def _exact(coarse: np.ndarray, fine: np.ndarray) -> np.ndarray:
    return coarse / _COARSE + fine / _UNIT


def _sums(values: np.ndarray, total) -> np.ndarray:
    """What ``exact_sum`` gives for values of which none is negative; ``total`` adds up whole numbers, group by group.

    A group's units are added in one number as long as it holds them all exactly: sums only grow, so the last one tells.
    """
    units = total(np.rint(values * _UNIT))
    return units / _UNIT if units.max(initial=0.0) < _EXACT else _exact(*map(total, _parts(values)))


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where a new group begins in rows sorted by the keys."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return new


def _place_in_group(new: np.ndarray) -> np.ndarray:
    """Places 1, 2, ... in every group of rows that lie together."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0)) + 1


@dataclass(frozen=True)
class Plan:
    """The leaves of a batch of queries by index term (``keys`` and ``bounds``), and how they add up: leaves in query terms, these in
    fields, and these in queries, each level in one order."""

    queries: pa.Array
    keys: np.ndarray
    bounds: np.ndarray
    slot: np.ndarray
    weight: np.ndarray
    repeats: np.ndarray  # per query term
    leaf_count: np.ndarray
    field_of: np.ndarray
    field_starts: np.ndarray
    field_no: np.ndarray  # per field of a query
    query_of: np.ndarray
    token_count: np.ndarray
    query_starts: np.ndarray
    field_count: int
    fuzzy: bool

    @property
    def width(self) -> int:
        return max(1, CELLS // max(1, len(self.repeats)))


def plan_of(leaves: pa.Table, field_count: int, fuzzy: bool) -> Plan:
    """``leaves``: query_id, field_no, term_no, repeats, token_count, leaf_count, leaf_weight and key, the number of the index term."""
    encoded = leaves["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    query = np.asarray(encoded.indices).astype(np.int64)
    field, term, key = (leaves[name].to_numpy().astype(np.int64) for name in ("field_no", "term_no", "key"))
    order = np.lexsort((term, field, query))
    new_slot, new_field = _starts(query[order], field[order], term[order]), _starts(query[order], field[order])
    slot = np.empty(len(order), np.int64)
    slot[order] = np.cumsum(new_slot) - 1
    slots, fields = order[new_slot], order[new_field]
    field_of = np.cumsum(new_field[new_slot]) - 1
    by_key = np.argsort(key, kind="stable")
    keys, firsts = np.unique(key[by_key], return_index=True)
    column = {name: leaves[name].to_numpy().astype(np.float64) for name in ("repeats", "leaf_count", "token_count", "leaf_weight")}
    return Plan(
        encoded.dictionary, keys, np.append(firsts, len(key)), slot[by_key], column["leaf_weight"][by_key],
        column["repeats"][slots], column["leaf_count"][slots], field_of, np.flatnonzero(_starts(field_of)),
        field[fields], query[fields], column["token_count"][fields], np.flatnonzero(_starts(query[fields])), field_count, fuzzy,
    )


def field_scores(plan: Plan, chunk: np.ndarray, key: np.ndarray, base: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and matched query tokens, by field of a query and chunk of the block. ``base`` is a posting's share of its leaf scores.

    Of the many cells of query terms by chunks only those with a match are worked on.
    """
    at = np.searchsorted(plan.keys, key)
    counts = plan.bounds[at + 1] - plan.bounds[at]
    pair = np.arange(counts.sum())  # of a posting and a leaf
    leaf = np.repeat(plan.bounds[at] - (np.cumsum(counts) - counts), counts)
    leaf += pair
    value, slot, column = np.repeat(base, counts), plan.slot.take(leaf), np.repeat(chunk, counts)
    value *= plan.weight.take(leaf)
    slots, fields = len(plan.repeats), len(plan.field_no)

    if not plan.fuzzy:  # a query term is one index term, so the innermost level is the leaf itself
        repeats = plan.repeats[slot]
        scores = repeats * (np.rint(value * _UNIT) / _UNIT)
    else:
        cell = column * slots
        cell += slot
        mark = np.empty(width * slots, np.int64)  # read only where it was written
        mark[cell] = pair
        one = np.flatnonzero(mark.take(cell) == pair)  # of the pairs of each cell
        mark[cell.take(one)] = np.arange(len(one))
        cell, column, slot = mark.take(cell), column.take(one), slot.take(one)
        found = np.bincount(cell, minlength=len(one))
        sums = _sums(value, lambda x: np.bincount(cell, x, len(one)))
        repeats = plan.repeats.take(slot)
        scores = repeats * (sums * found / plan.leaf_count.take(slot))
    cell = column * fields + plan.field_of.take(slot)
    score, matched = _sums(scores, lambda x: np.bincount(cell, x, width * fields)), np.bincount(cell, repeats, width * fields)
    score, matched = (x.reshape(width, fields).T for x in (score, matched))
    return score * matched / plan.token_count[:, None], matched


def query_scores(plan: Plan, score: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and numbers of matching fields, by query and chunk of the block."""
    fields = np.add.reduceat((matched > 0).astype(np.float64), plan.query_starts)
    total = _sums(score, lambda x: np.add.reduceat(x, plan.query_starts))
    return total * fields / plan.field_count, fields


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(numbers of the chunks, their groups, and per posting: chunk of the block, key, base) of whole chunks, ``width`` at most at once."""
    held: list[list[np.ndarray]] = []

    def cut(last: bool):
        rows = [np.concatenate(c) for c in zip(*held)]
        starts = np.flatnonzero(_starts(rows[0]))
        ends = np.append(starts[1:], len(rows[0]))
        whole = len(starts) if last else len(starts) - 1
        for a in range(0, whole, width):
            b = min(a + width, whole)
            part = slice(starts[a], ends[b - 1])
            chunk = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
            yield rows[0][starts[a:b]], rows[1][starts[a:b]], chunk, rows[2][part], rows[3][part]
        held[:] = [] if last else [[x[starts[-1] :] for x in rows]]

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(x[0]) for x in held) >= ROWS:
            yield from cut(False)
    if held:
        yield from cut(True)


class Leading:
    """The best ``limit`` rows of every query among those seen, with at most ``cap`` of a group (0: any number).

    Chunks come in their order, so among equal scores those seen first stay, and a row that does not beat the last one kept is out at once.
    """

    def __init__(self, queries: int, limit: int, cap: int):
        self.limit, self.cap, self.least = limit, cap, np.full(queries, -np.inf)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def add(self, chunk_no: np.ndarray, group: np.ndarray, total: np.ndarray, found: np.ndarray) -> None:
        query, chunk = np.nonzero(found & (total > self.least[:, None]))
        self.rows.append((query, chunk_no[chunk], group[chunk], total[query, chunk]))
        self.pending += len(query)
        if self.pending > max(PENDING, len(self.rows[0][0])):
            self.choose()

    def choose(self) -> tuple[np.ndarray, ...]:
        query, chunk_no, group, score = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((chunk_no, -score, query))
        if self.cap:
            in_group = order[np.lexsort((group[order], query[order]))]  # stable: best first in every group
            nth = np.empty(len(order), np.int64)
            nth[in_group] = _place_in_group(_starts(query[in_group], group[in_group]))
            order = order[nth[order] <= self.cap]
        rank = _place_in_group(_starts(query[order]))
        last = order[rank == self.limit]
        self.least[query[last]] = score[last]
        kept = order[rank <= self.limit]
        self.rows, self.pending = [(query[kept], chunk_no[kept], group[kept], score[kept])], 0
        return self.rows[0]


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, schema)], schema=schema)


def leading(batches: Iterator[pa.RecordBatch], plan: Plan, schema: pa.Schema, limit: int, cap: int) -> Iterator[pa.RecordBatch]:
    """(query_id, chunk_no, group, score): the leading rows of every query; for a ``limit`` of 0 all that match, or the ``cap`` best of each group."""
    kept = Leading(len(plan.queries), limit or len(plan.keys) << 40, cap)
    for chunk_no, group, *postings in blocks(batches, plan.width):
        total, fields = query_scores(plan, *field_scores(plan, *postings, len(chunk_no)))
        if limit or cap:
            kept.add(chunk_no, group, total, fields > 0)
        else:
            query, chunk = np.nonzero(fields)
            yield _batch(schema, [plan.queries.take(pa.array(query)), chunk_no[chunk], group[chunk], total[query, chunk]])
    if kept.rows:
        query, *columns = kept.choose()
        yield _batch(schema, [plan.queries.take(pa.array(query)), *columns])


def clauses(batches: Iterator[pa.RecordBatch], plan: Plan, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(query_id, field_no, chunk_no, every): chunks that a field's clause retrieves, and whether every token of the query matches."""
    for chunk_no, _, *postings in blocks(batches, plan.width):
        _, matched = field_scores(plan, *postings, len(chunk_no))
        at, chunk = np.nonzero(matched)
        every = matched[at, chunk] == plan.token_count[at]
        yield _batch(schema, [plan.queries.take(pa.array(plan.query_of[at])), plan.field_no[at], chunk_no[chunk], every])


def clause_sizes(batches: Iterator[pa.RecordBatch], plan: Plan, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(query_id, field_no, any, all): a task's numbers of chunks that match any token, and every token."""
    sizes = np.zeros((2, len(plan.field_no)), np.int64)
    for chunk_no, _, *postings in blocks(batches, plan.width):
        _, matched = field_scores(plan, *postings, len(chunk_no))
        sizes += [np.count_nonzero(matched, axis=1), np.count_nonzero(matched == plan.token_count[:, None], axis=1)]
    at = np.flatnonzero(sizes[0])
    yield _batch(schema, [plan.queries.take(pa.array(plan.query_of[at])), plan.field_no[at], sizes[0][at], sizes[1][at]])

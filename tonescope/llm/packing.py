"""Packing of documents into sequences of a fixed length, by swap-based local search.

Documents become token ids with an end id; only longer ones are cut, into whole sequences, the first piece being the
short one. Pieces are dealt by a hash of their place in the table into groups of about ``group`` pieces, as many as the
pieces need, so each task packs a bounded number, whatever ids repeat. In a group pieces go to the sequence that they
fit best, in their order, which is the start. The search then takes the emptiest sequences in turn and moves documents
out of them, or exchanges one for one or two for one with other underfull sequences; each step raises the sum of
squared fills. It ends when the sequences are as few as the tokens allow, or when no step of any sequence raises the
sum. In the second case the underfull sequences and as many full ones are filled anew, the largest documents first, and
searched again, with more full ones each time, and what needs fewer sequences is kept.

Defined results: a null or empty text is one piece that holds the end id; repeated rows are pieces of their own; an
empty table gives an empty result. A group leaves one sequence partly filled at most when the search succeeds, so
about (pieces / group) sequences are lost against one search over all.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, ceil_div, chunk_encoder, trimmed, tune

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(df: DataFrame, tokenizer: str, end_id: int, length: int, key: str = "doc_id", text: str = "text", spaced: bool = True, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every whole text's ids and the end id, cut to pieces of length."""
    tune(df.sparkSession)

    def cut(batches):
        encoder = chunk_encoder(tokenizer, spaced, 800_000)
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0)
            for i, j in blocks(texts):
                flat, counts = encoder.encode(texts[i:j])
                stop = np.cumsum(counts + 1)
                ids = np.full(int(stop[-1]), end_id, "<u4")
                keep = np.ones(len(ids), bool)
                keep[stop - 1] = False
                ids[keep] = flat
                size = counts + 1
                n = -(-size // length)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = size - (n - 1) * length
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * length)
                long = np.where(piece == 0, first[row], length)
                at = (stop - size)[row] + start
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at, long)]
                out = [keys.take(pa.array(row + i)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(long), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, length: int, group: int = 8192) -> DataFrame:
    """pieces (a stored table with doc_id, piece, length, whose rows keep their places) with ``sequence_id`` and ``offset``.

    Columns of pieces that have these names give way to the new ones; all others stay as they are. Repeated rows are a
    piece each. No pieces make no sequences.
    """
    pieces = pieces.drop("sequence_id", "offset")
    dealt_to = "_group"
    while dealt_to in pieces.columns:
        dealt_to += "_"
    groups = max(1, ceil_div(pieces.count(), group))

    def pack_group(table: pa.Table) -> pa.Table:
        size = table.column("length").to_numpy()
        # a fixed order, so that a task that runs again gives the same sequences
        order = np.lexsort([table.column("ids_crc32").to_numpy(), table.column("piece").to_numpy(), table.column("doc_id").to_numpy(zero_copy_only=False)]) if "ids_crc32" in table.column_names else np.arange(len(size))
        table = table.take(pa.array(order))
        size = size[order]
        bin_of, _ = pack_items(size, length)
        by_bin = np.argsort(bin_of, kind="stable")
        before = np.cumsum(size[by_bin]) - size[by_bin]
        firsts = np.flatnonzero(np.diff(bin_of[by_bin], prepend=-1))
        offset = np.empty(len(size), np.int64)
        offset[by_bin] = before - np.repeat(before[firsts], np.diff(np.append(firsts, len(size))))
        number = table.column(dealt_to).to_numpy() * (1 << 24) + bin_of
        return table.drop_columns([dealt_to]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn(dealt_to, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy(dealt_to).applyInArrow(pack_group, schema)


def best_fit(size: np.ndarray, length: int, order: np.ndarray | None = None) -> np.ndarray:
    """The bin of each item: the open one it fits best, in the given order. Bins are found by a bit mask of their room."""
    bin_of = np.empty(len(size), np.int64)
    by_room: dict[int, list[int]] = {}
    mask = n = 0
    for i in (range(len(size)) if order is None else order.tolist()):
        s = int(size[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            bins = by_room[room]
            b = bins.pop()
            if not bins:
                mask &= ~(1 << room)
        else:
            room, b, n = length, n, n + 1
        bin_of[i] = b
        if room > s:
            by_room.setdefault(room - s, []).append(b)
            mask |= 1 << (room - s)
    return bin_of


def pack_items(size: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """The bin of each item, numbered from 0, and how many steps the search took."""
    bin_of, steps = search(size, best_fit(size, length), length)
    least = ceil_div(int(size.sum()), length)
    more = 1
    while len(np.unique(bin_of)) > least:
        fill = np.bincount(bin_of, weights=size).astype(np.int64)
        under, full = np.flatnonzero(fill < length), np.flatnonzero(fill == length)
        # full ones of the smallest items help the most
        mean = fill[full] / np.bincount(bin_of, minlength=len(fill))[full]
        pool = np.concatenate([under, full[np.argsort(mean, kind="stable")[: more * max(len(under), 16)]]])
        items = np.flatnonzero(np.isin(bin_of, pool))
        fresh, n = search(size[items], best_fit(size[items], length, np.argsort(-size[items], kind="stable")), length)
        steps += n
        if fresh.max() + 1 < len(pool):
            bin_of[items] = len(fill) + fresh
            bin_of = np.unique(bin_of, return_inverse=True)[1].astype(np.int64)
        if len(pool) == len(fill):
            break
        more *= 2
    return bin_of, steps


def search(size: np.ndarray, bin_of: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Local search from bin_of: every step raises the sum of squared fills; bins that empty are gone. Also the steps.

    A step takes one or two items of a bin, the donor, and moves them to another underfull bin, or exchanges them for
    one smaller item there, so that the receiver ends fuller than the donor was. Donors come in the order of their fill.
    """
    bin_of = bin_of.copy()
    fill = np.bincount(bin_of, weights=size).astype(np.int64)
    left, least = int((fill > 0).sum()), ceil_div(int(size.sum()), length)
    steps, before = 0, -1
    while left > least and steps != before:
        before = steps
        under = np.flatnonzero((fill > 0) & (fill < length))
        for k, donor in enumerate(under[np.argsort(fill[under], kind="stable")].tolist()):
            if left <= least:
                break
            if k % 32 == 0:  # items of bins that became full take no part any more
                active = np.flatnonzero(fill[bin_of] < length)
            while 0 < fill[donor] < length and (step := _step(size, bin_of, fill, active, donor, length)):
                out, back, to = step
                moved = int(size[out].sum()) - (0 if back is None else int(size[back]))
                bin_of[out] = to
                if back is not None:
                    bin_of[back] = donor
                fill[donor] -= moved
                fill[to] += moved
                steps += 1
            left -= int(fill[donor] == 0)
    return np.unique(bin_of, return_inverse=True)[1].astype(np.int64), steps


def _step(size, bin_of, fill, active, donor, length):
    """(items that leave the donor, item that comes back or None, receiver): the step that drains the donor most and,
    of equal ones, fills the receiver best. active: the items of all underfull bins, and perhaps of some that are full."""
    homes, sizes = bin_of[active], size[active]
    own = active[homes == donor]
    mine = size[own].tolist()
    kinds = sorted(set(mine))
    give = np.array(sorted({*kinds, *(a + b for i, a in enumerate(kinds) for b in kinds[i + 1 :]), *(2 * a for a in kinds if mine.count(a) > 1)}))  # what one or two items amount to
    room = length - fill
    room[donor] = room[fill == 0] = 0
    best, found = 0, None
    bins = np.flatnonzero(room)
    bins = bins[np.argsort(room[bins], kind="stable")]
    at = np.searchsorted(room[bins], give)  # the tightest bin for each
    fits = at < len(bins)
    out, to = give[fits], bins[at[fits]]
    score = np.where(fill[to] + out > fill[donor], out * (length + 1) - (room[to] - out), 0)
    if len(score) and score.max() > 0:
        k = int(score.argmax())
        best, found = int(score[k]), (int(out[k]), None, int(to[k]))
    where = room[homes]
    some = np.flatnonzero((where > 0) & (sizes < give[-1]) & (sizes + where >= give[0]))
    where, back = where[some], sizes[some]
    at = np.searchsorted(give, back + where, side="right") - 1  # the most that may come for each item
    drain = give[at] - back
    score = np.where((drain > 0) & (length - where + drain > fill[donor]), drain * (length + 1) - (where - drain), 0)
    if len(score) and score.max() > best:
        k = int(score.argmax())
        found = (int(give[at[k]]), int(active[some[k]]), int(homes[some[k]]))
    if found is None:
        return None
    amount, back, to = found
    one = own[size[own] == amount]
    if len(one):
        return one[:1], back, to
    for k, i in enumerate(own.tolist()):
        other = own[k + 1 :][size[own[k + 1 :]] == amount - size[i]]
        if len(other):
            return np.array([i, int(other[0])]), back, to
    return None

"""Sampled segmentations into pieces of a SentencePiece vocabulary, by forward filtering and backward sampling.

A text's lattice has an edge for each substring that is a piece, and byte edges for characters that no piece holds. A
segmentation's weight is the product of its pieces' weights to the power of ``alpha``; a piece's weight falls with its
rank in the vocabulary (its rank is what a BPE vocabulary's scores tell). Forward filtering sums the weights of all
paths to each position; backward sampling draws the last piece, then the one before it, and so on, each in proportion
to the sums, which is an exact draw from all segmentations.

No piece holds a space behind another character, or a line end, so lattices part into units (spaces with the word
behind them; line ends). A unit's sums serve all its occurrences in a block, and draws are made for many at once. A draw's
random number is a hash of seed, row key, the unit's place in the text and the position, so a row's segmentation
depends on nothing else.

Decoding joins the pieces' bytes and is lossless: byte edges cover whatever the vocabulary lacks, the sign that marks
spaces in pieces included. Defined results: a null or empty text has no pieces; a null key counts as 0, and rows with
equal key and text have equal segmentations; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix64, tune

MARK = "▁"
UNITS = re.compile(r" *[^ \n]+| +|\n").findall


class PieceSampler:
    """Draws segmentations of texts. Lattices of all different units of a block are made and summed at once."""

    #: Units up to this many characters are summed without logarithms, scaled by SCALE for each character.
    SHORT, SCALE = 96, math.e**2

    def __init__(self, path: str, alpha: float = 0.5):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces: dict[str, int] = {}
        byte_id = np.full(256, -1)
        shown = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_id[int(piece[3:5], 16)] = i
                shown[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(MARK, " ")
                shown[i] = text.encode()
                if "\n" not in text and " " not in text.lstrip(" "):
                    self.pieces[text] = i
        if (byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces; decoding could not be lossless")
        self.byte_id = byte_id
        self.log_weight = -alpha * np.log(np.arange(n) + 1.0)
        self.byte_log_weight = -alpha * math.log(n + 1.0)
        self.longest = max(map(len, self.pieces))
        # by length: sorted hashes of the pieces' beginnings, and the piece that a beginning is, or -1
        found: list[dict[int, int]] = [{} for _ in range(self.longest + 1)]
        for text, i in self.pieces.items():
            h = np.zeros(1, np.uint64)
            for k, c in enumerate(text, 1):
                h = self._hash(h, np.uint64(ord(c)))
                found[k].setdefault(int(h[0]), -1)
            found[len(text)][int(h[0])] = i
        self.begins = [(np.array(sorted(f), np.uint64), np.array([f[k] for k in sorted(f)], np.int64)) for f in found]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_end = np.cumsum([len(s) for s in shown])
        self.shown_size = np.array([len(s) for s in shown])

    @staticmethod
    def _hash(h: np.ndarray, c) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(h * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1))

    def _edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, id) of every piece in units one behind the other; left: characters from a place to its unit's end.

        A character that is no piece gets an edge with minus the number of its UTF-8 bytes for an id.
        """
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        places, lengths, ids = [], [], []
        single = np.zeros(len(chars), bool)
        for k in range(1, self.longest + 1):
            fits = left[at] >= k
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = self._hash(h, chars[at + k - 1])
            known, piece = self.begins[k]
            found = np.minimum(np.searchsorted(known, h), len(known) - 1)
            ok = known[found] == h
            at, h, found = at[ok], h[ok], piece[found[ok]]
            real = found >= 0
            places.append(at[real])
            lengths.append(np.full(int(real.sum()), k))
            ids.append(found[real])
            if k == 1:
                single[at[real]] = True
        bare = np.flatnonzero(~single)
        width = 1 + (chars[bare] >= 0x80) + (chars[bare] >= 0x800) + (chars[bare] >= 0x10000)
        return np.concatenate([*places, bare]), np.concatenate([*lengths, np.ones(len(bare), np.int64)]), np.concatenate([*ids, -width])

    def _lattices(self, units: list[str]):
        """Of all units' states (a unit of n characters has n + 1): first and last; and by state, its edges' range, and the
        edges' upper share, state before, and id, sorted by state."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        first = np.cumsum(size + 1) - size - 1
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        unit = np.repeat(np.arange(len(units)), size)
        inside = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
        place, length, ids = self._edges(chars, size[unit] - inside)
        own = unit[place]
        before = first[own] + inside[place]
        state = before + length
        end = inside[place] + length
        log_w = np.where(ids >= 0, self.log_weight[np.maximum(ids, 0)], np.where(ids < 0, -ids, 0) * self.byte_log_weight)
        order = np.argsort(state, kind="stable")
        own, before, state, end, ids, length, log_w, place = (v[order] for v in (own, before, state, end, ids, length, log_w, place))
        share = np.empty(len(state))
        short = size[own] <= self.SHORT
        at = np.flatnonzero(short)
        if len(at):
            total = np.zeros(int(first[-1] + size[-1] + 1))
            total[first] = 1.0
            w = np.exp(log_w[at]) * self.SCALE ** length[at]
            by_end = np.argsort(end[at].astype(np.uint16), kind="stable")
            cuts = np.searchsorted(end[at][by_end], np.arange(1, self.SHORT + 2))
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                some = by_end[i:j]
                path = total[before[at[some]]] * w[some]
                share[at[some]] = path
                target = state[at[some]]  # sorted
                starts = np.flatnonzero(np.diff(target, prepend=-1))
                total[target[starts]] = np.add.reduceat(path, starts)
            share[at] /= total[state[at]]
        long = np.flatnonzero(~short)
        if len(long):  # one by one, with logarithms
            log_total = np.zeros(int(first[-1] + size[-1] + 1))
            starts = np.append(np.flatnonzero(np.diff(state[long], prepend=-1)), len(long))
            for i, j in zip(starts[:-1], starts[1:]):
                e = long[i:j]
                v = log_total[before[e]] + log_w[e]
                top = v.max()
                v = np.exp(v - top)
                whole = v.sum()
                log_total[state[e[0]]] = top + math.log(whole)
                share[e] = v / whole
        cum = np.cumsum(share)
        begin = np.searchsorted(state, np.arange(int(first[-1] + size[-1] + 1) if len(units) else 0))
        cum -= np.append(0.0, cum)[begin[state]]
        cum[np.append(state[1:] != state[:-1], True)] = 2.0  # a state's last edge takes what is left
        return first, first + size, begin, cum, before, ids, chars[place]

    def sample(self, texts: list[str | None], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has."""
        table: dict[str, int] = {}
        counts = np.zeros(len(texts), np.int64)
        number = table.setdefault
        parts = []
        for k, t in enumerate(texts):
            units = UNITS(t) if t else []
            counts[k] = len(units)
            parts.append(np.fromiter((number(u, len(table)) for u in units), np.int64, len(units)))
        code = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if not len(code):
            return np.zeros(0, np.int64), counts
        first, last, begin, cum, before, piece, char = self._lattices(list(table))
        ordinal = (np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
        with np.errstate(over="ignore"):
            row = mix64(np.asarray(keys).astype(np.int64).view(np.uint64) + np.uint64(seed % 2**64) * np.uint64(0x9E3779B97F4A7C15))
            stream = mix64(np.repeat(row, counts) + ordinal * np.uint64(0xD1B54A32D192ED03))
        state, origin = last[code], first[code]
        active = np.arange(len(code))
        steps = []
        while len(active):
            with np.errstate(over="ignore"):
                u = (mix64(stream[active] + (state - origin).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(11)) * 2.0**-53
            edge = begin[state]
            later = np.flatnonzero(u >= cum[edge])
            while len(later):
                edge[later] += 1
                later = later[u[later] >= cum[edge[later]]]
            steps.append((active, edge))
            state = before[edge]
            go = state > origin
            active, state, origin = active[go], state[go], origin[go]
        # the steps go backwards through each unit
        n = np.zeros(len(code), np.int64)
        for who, _ in steps:
            n[who] += 1
        stop = np.cumsum(n)
        path = np.empty(int(stop[-1]), np.int64)
        for k, (who, edge) in enumerate(steps):
            path[stop[who] - 1 - k] = edge
        ids = piece[path]
        upto = np.append(0, stop)[np.cumsum(counts)]
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, np.diff(upto, prepend=0)
        wide = np.where(ids < 0, -ids, 1)
        end = np.cumsum(wide)
        out = np.repeat(ids, wide)
        for w in range(1, 5):
            some = bare[ids[bare] == -w]
            if len(some):
                c = char[path[some]].astype(np.int64)
                lead = (0, 0xC0, 0xE0, 0xF0)[w - 1]
                for k in range(w):
                    byte = (c >> (6 * (w - 1 - k))) & 0x3F | 0x80 if k else c >> (6 * (w - 1)) | lead
                    out[end[some] - w + k] = self.byte_id[byte]
        return out, np.diff(np.append(0, end)[upto], prepend=0)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.shown_size[ids]
        end = np.cumsum(size)
        if not len(end):
            return b""
        return self.shown[np.repeat(self.shown_end[ids] - end, size) + np.arange(int(end[-1]))].tobytes()


@functools.lru_cache(maxsize=2)
def sampler(path: str, alpha: float) -> PieceSampler:
    """One for each Python worker."""
    return PieceSampler(path, alpha)


PIECE_IDS = "doc_id long, ids array<int>"
PIECE_DIGEST = "doc_id long, n_chars long, n_pieces long, ids_crc32 long, lossless boolean"


def sample_pieces(df: DataFrame, model: str, alpha: float = 0.5, seed: int = 0, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, ids) of every whole text, or the digest (doc_id, n_chars, n_pieces, ids_crc32, lossless) of them.

    lossless: decoding the ids gives the text's bytes.
    """
    tune(df.sparkSession)

    def draw(batches):
        pieces = sampler(model, alpha)
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in blocks(texts, 2_500_000):
                some = texts[i:j]
                ids, n = pieces.sample(some, keys[i:j], seed)
                end = np.cumsum(n)
                if not digest:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])
                    continue
                little = ids.astype("<u4")
                crc = [zlib.crc32(little[x - k : x]) for x, k in zip(end, n)]
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in some]
                size = np.bincount(np.repeat(np.arange(len(some)), n), weights=pieces.shown_size[ids], minlength=len(some)).astype(np.int64)
                whole, stop = pieces.decode(ids), np.cumsum(size)
                same = [whole[x - k : x] == r for x, k, r in zip(stop.tolist(), size.tolist(), raw)]
                chars = [len(t or "") for t in some]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(chars, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(same)], [c.split(" ")[0] for c in PIECE_DIGEST.split(", ")])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(draw, PIECE_DIGEST if digest else PIECE_IDS)


def decode_pieces(df: DataFrame, model: str, alpha: float = 0.5) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def decode(batches):
        pieces = sampler(model, alpha)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(np.array(x or [], np.int64)).decode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")

"""Scoring of texts by a hierarchical Pitman-Yor language model with Gibbs-sampled Chinese-restaurant seating.

Tokens, grouped by their context, travel as packed arrays (``blobs``), not as rows: a task of the map side sorts some millions
of them and sends each bucket one value.  A bucket holds whole contexts; one that is too frequent for that is dealt over
several buckets by the words that follow it.

Packed values travel and are stored in pieces of ``PIECE`` bytes and are put together again in Python: an executor's heap keeps
longer ones apart, copies them at every step, and fills up with them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import bucketed_table, free_shuffles, scratch
from .blobs import even_keys, narrow, pack, steps_of, unpack
from .common import hash_words, id_type, map_texts, mix, own_memos, shared_table, shuffle_partitions, small_batches, space_words, trim
from .quality import remainder

#: (discount, strength) of the unigram parent and of the contexts.
ROOT, CONTEXT = (0.5, 10.0), (0.75, 5.0)

#: Gibbs sweeps over all restaurants that are passed over, and those whose predictive probabilities are averaged.
BURN, SAMPLES = 2, 2

SEED = 20_000_003

#: Tokens and documents that a task of the map side sorts at a time, and tokens that a bucket is meant to hold.
GATHER, GATHER_DOCS, BUCKET_TOKENS = 1 << 20, 1 << 16, 1 << 21

#: Bytes of an Arrow batch: values are large, and both sides of a Python worker hold whole batches.
BATCH_BYTES = 1 << 20

#: Bytes of a value in a row, at most, and rows that are read from Parquet at a time.
PIECE, READ_ROWS = 1 << 16, 8

#: How tables of pieces are written: they are compressed already, and a writer holds a row group in memory.
WRITTEN = {
    "compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": 4 * BATCH_BYTES, "parquet.page.size": 2 * PIECE,
    "parquet.block.size.row.check.min": 10, "parquet.page.size.row.check.min": 2,
}

#: Tokens of a bucket that are scored at a time.
STEP_TOKENS = 1 << 18

#: One of so many documents is looked at to find the contexts that are dealt over several buckets.  It decides nothing else.
LOOK = 64

#: The end of a text, which no word can be: words hold no space.
END = int(hash_words([b" end"])[0])


#: Customers up to which a cell's number of tables is drawn from all its probabilities, and numbers that one step weighs.
LISTED, STEP = 128, 1 << 20


@functools.lru_cache
def log_seatings(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: the weight of all seatings of c customers at t tables."""
    out = np.full((LISTED + 1, LISTED + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, LISTED):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - discount * t)
        out[c + 1, 1:] = np.logaddexp(out[c + 1, 1:], out[c, :-1])
    return out


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """The number of tables of each cell: t with a probability as (seatings of its customers at t tables) * weight^t.

    Beyond LISTED customers: that is the number of jumps of a compound Poisson variable (weight / d jumps of Sibuya's law)
    given their sum, here by its saddle point: ``mean`` and ``spread`` of the jumps besides the largest.  The work doesn't
    grow with the customers of a cell."""
    tables = np.ones(len(customers), np.int64)
    if not len(customers):
        return tables
    order = np.argsort(customers, kind="stable")
    sizes, starts = np.unique(customers[order], return_index=True)
    ways = log_seatings(discount)
    for c, lo, hi in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        if c < 2:
            continue
        if c > LISTED:
            break
        for at in range(lo, hi, max(1, STEP // c)):
            cells = order[at : min(hi, at + max(1, STEP // c))]
            logs = ways[c, 1 : c + 1] + np.log(weight[cells])[:, None] * np.arange(1, c + 1)
            sums = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
            tables[cells] = 1 + (sums < (rng.random(len(cells)) * sums[:, -1])[:, None]).sum(1)
    hot = np.flatnonzero(customers > LISTED)
    if len(hot):
        c, a, d = customers[hot].astype(np.float64), weight[hot], discount
        # a z (1 - z)^(d - 1) = c in x = log(1 - z), by halving.
        low, high = np.full(len(hot), -700.0), np.zeros(len(hot))
        for _ in range(60):
            x = (low + high) / 2
            more = np.log(a) + np.log(-np.expm1(x)) + (d - 1) * x > np.log(c)
            low, high = np.where(more, x, low), np.where(more, high, x)
        q = np.exp(high)
        g = -np.expm1(d * high)
        mean = a / d * g
        first = (1 - q) * d * q ** (d - 1) / g
        second = first + (1 - q) ** 2 * d * (1 - d) * q ** (d - 2) / g
        spread = np.where(np.isfinite(second), mean * (1 - first * (first / second)), mean)
        drawn = np.where(mean < 50, rng.poisson(np.minimum(mean, 50)), np.rint(mean + np.sqrt(np.maximum(spread, 0)) * rng.standard_normal(len(hot))))
        tables[hot] = np.clip(1 + drawn, 1, customers[hot]).astype(np.int64)
    return tables


class Restaurants:
    """Seating of customers: for each cell (a dish in a restaurant) the number of its tables.

    A customer of a dish joins a table of that dish with weight size - d, or opens one with weight
    (theta + d * tables of the restaurant) * P(dish in the parent).  Probabilities depend on the numbers of tables alone, so
    a sweep sums over the sizes and draws each number anew, given all else.  ``once`` counts, for each restaurant, further
    cells of one customer, which have one table whatever happens.
    """

    def __init__(
        self, room: np.ndarray, customers: np.ndarray, rooms: int, law: tuple[float, float], rng: np.random.Generator, once: np.ndarray | int = 0
    ) -> None:
        self.room, self.customers, self.rooms, self.rng = room, customers.astype(np.int64), rooms, rng
        self.discount, self.strength = law
        self.once = once
        self.tables = np.ones(len(self.customers), np.int64)

    def start(self, base: np.ndarray) -> None:
        """A table a cell, and a sweep."""
        self.tables = np.ones(len(self.customers), np.int64)
        self.sweep(base)

    def opened(self) -> np.ndarray:
        """Tables of each restaurant."""
        return self.once + np.bincount(self.room, self.tables, self.rooms).astype(np.int64)

    def sweep(self, base: np.ndarray, gamma: np.ndarray | None = None) -> None:
        """Seat all customers of all cells again.  Given a gamma variable for each restaurant, drawn from the tables that it
        has just now, its cells are independent of each other."""
        if gamma is None:
            gamma = self.rng.standard_gamma(self.strength / self.discount + self.opened())
        self.tables = draw_tables(self.customers, self.discount * gamma[self.room] * base, self.discount, self.rng)

    @property
    def cell(self) -> np.ndarray:
        """The cell of each table."""
        return np.repeat(np.arange(len(self.customers)), self.tables)

    @property
    def size(self) -> np.ndarray:
        """Sizes of the tables in one of the seatings with these numbers: the first one of a cell takes what the others leave."""
        size = np.ones(int(self.tables.sum()), np.int64)
        size[np.cumsum(self.tables) - self.tables] += self.customers - self.tables
        return size

    def predictive(self) -> tuple[np.ndarray, np.ndarray]:
        """(share of each cell without its parent, weight of the parent in each restaurant)."""
        d, s = self.discount, self.strength
        total = np.bincount(self.room, self.customers, self.rooms) + self.once
        return (self.customers - d * self.tables) / (s + total[self.room]), (s + d * self.opened()) / (s + total)


def parent(customers: np.ndarray, tables: np.ndarray, words: int, all_customers: int, all_tables: int) -> np.ndarray:
    """P of words in the unigram parent, whose base is even over ``words`` known words and one unknown one."""
    d, s = ROOT
    return (customers - d * tables + (s + d * all_tables) / (words + 1)) / (s + all_customers)


# --- tokens by context -----------------------------------------------------------------------------------------------


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with an end after each text, their number in each text)."""
    parts, lengths = [], []
    end = np.array([END], np.uint64)
    for text in texts:
        words = space_words(text)
        parts += [hash_words(words), end]
        lengths.append(len(words) + 1)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(lengths, np.int64)


def _count(docs) -> Iterator[dict]:
    for _, texts, _ in docs:
        words, counts = np.unique(_tokens(texts)[0], return_counts=True)
        yield {"h": words.view(np.int64), "c": counts}


def _layout(docs: DataFrame, id_col: str, text_col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of buckets, frequent contexts, number of buckets that each of those is dealt over), from a sample.

    At most four contexts a bucket are frequent.  Whatever the sample holds, results are the same."""
    seen = map_texts(docs.sample(False, 1 / LOOK, SEED), _count, "h long, c long", id_col, text_col).groupBy("h").agg(F.sum("c").alias("c"))
    seen = shared_table(seen, "look")
    tokens = (seen.agg(F.sum("c")).first()[0] or 0) * LOOK
    buckets = max(shuffle_partitions(docs.sparkSession), -(-tokens // BUCKET_TOKENS))
    fair = tokens / buckets / 4
    hot = seen.where(F.col("c") * LOOK > max(fair, LOOK * 8)).toPandas()
    hashes = hot["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    deal = np.minimum(buckets, np.ceil(hot["c"].to_numpy(np.float64) * LOOK / max(fair, 1))).astype(np.int64)
    return buckets, hashes[order], deal[order]


def _place(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, known) of values in an ascending sequence."""
    if not len(hashes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return at, hashes[at] == wanted


def _blocks(shared: Broadcast):
    """Rows of two kinds: (bucket, chunk, piece, data) for the tokens of a chunk of documents that belong to a bucket, sorted by context
    and word; and (bucket, chunk, ids, held, n) for its documents.  A document's code is its number in the chunk, and whether it teaches."""

    def block(words: np.ndarray, cu: np.ndarray, cw: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> bytes:
        first = np.flatnonzero(np.diff(cu, prepend=-1))
        own, index = np.unique(cw, return_inverse=True)
        return pack(
            steps_of(words[cu[first]]), narrow(np.diff(np.append(first, len(cu)))), steps_of(words[own]), narrow(index), narrow(counts), narrow(codes)
        )

    def run(docs) -> Iterator[dict]:
        hot, deal, keys = shared.value
        buckets, task, chunks = len(keys), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> Iterator[dict]:
            nonlocal chunks
            ids, words, lengths, out = (list(x) for x in zip(*held, strict=True))
            ids, lengths, out = pa.chunked_array(ids).combine_chunks(), np.concatenate(lengths), np.concatenate(out)
            tokens = np.concatenate(words)
            held.clear()
            words, index = np.unique(tokens, return_inverse=True)
            # The context of a token is the word before it, an end for the first one of a text.
            u = np.concatenate((np.searchsorted(words, np.array([END], np.uint64)), index[:-1]))
            u[np.cumsum(lengths)[:-1]] = u[0]
            home = (mix(words) % np.uint64(buckets)).astype(np.int64)
            b = home[u]
            at, known = _place(hot, words)
            if known.any():
                spread = np.where(known, deal[at], 1)[u]
                apart = np.flatnonzero(spread > 1)
                b[apart] = (b[apart] + (mix(tokens[apart] + np.uint64(1)) % spread[apart].astype(np.uint64)).astype(np.int64)) % buckets
            del tokens
            bits = np.uint64(max(1, len(words).bit_length()))
            if 2 * int(bits) + buckets.bit_length() > 64:
                raise ValueError("too many words in one text for this many buckets")
            key = ((b.astype(np.uint64) << bits | u.astype(np.uint64)) << bits) | index.astype(np.uint64)
            order = np.argsort(key)
            key = key[order]
            codes = np.repeat(np.arange(len(lengths)) * 2 + ~out, lengths)[order]
            del order, b, u, index
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends, cells = np.append(starts, len(key)), key[starts]
            del key
            mask = (np.uint64(1) << bits) - np.uint64(1)
            cw, cu, cb = (cells & mask).astype(np.int64), (cells >> bits & mask).astype(np.int64), (cells >> (bits + bits)).astype(np.int64)
            cuts = np.searchsorted(cb, np.arange(buckets + 1))
            rows = [(k, x, y) for k, x, y in zip(keys.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if x < y]
            data = [block(words, cu[x:y], cw[x:y], np.diff(ends[x : y + 1]), codes[ends[x] : ends[y]]) for _, x, y in rows]
            chunk = task << 24 | chunks
            chunks += 1
            split = [(k, i, x) for (k, _, _), whole in zip(rows, data, strict=True) for i, x in enumerate(_pieces(whole))]
            del data
            offsets = pa.array([0] * (len(split) + 1) + [len(ids)], pa.int32())
            made = {
                "b": [k for k, _, _ in split] + [int(keys[chunk % buckets])], "chunk": [chunk] * (len(split) + 1),
                "piece": [i for _, i, _ in split] + [0], "data": [*[x for *_, x in split], None],
                "ids": pa.ListArray.from_arrays(offsets, ids), "held": pa.ListArray.from_arrays(offsets, pa.array(out)),
                "n": pa.ListArray.from_arrays(offsets, pa.array(lengths)),
            }
            for lo in range(0, len(split) + 1, BATCH_BYTES // PIECE):
                yield {name: column[lo : lo + BATCH_BYTES // PIECE] for name, column in made.items()}

        tokens = count = 0
        for ids, texts, batch in docs:
            words, lengths = _tokens(texts)
            if held and (tokens + len(words) > GATHER or count + len(lengths) > GATHER_DOCS):
                yield from flush()
                trim()
                tokens = count = 0
            held.append((ids, words, lengths, batch.column("held_out").to_numpy(zero_copy_only=False)))
            tokens, count = tokens + len(words), count + len(lengths)
        if held:
            yield from flush()
        trim()

    return run


def _pieces(data: bytes) -> list[bytes]:
    return [data[at : at + PIECE] for at in range(0, len(data), PIECE)]


def _whole(pieces: list[tuple[int, pa.Buffer]]) -> bytes:
    return b"".join(x for _, x in sorted(pieces, key=lambda x: x[0]))


def _thin(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BATCH_BYTES``."""
    rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def _by(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of sorted batches, those of one value at a time.  Binary values are buffers."""
    own, rows = None, []
    for batch in batches:
        columns = [batch.column(n) for n in batch.schema.names]
        for i in range(batch.num_rows):
            row = {n: c[i] for n, c in zip(batch.schema.names, columns, strict=True)}
            now = row[column].as_py()
            if now != own and rows:
                yield own, rows
                rows = []
            own = now
            rows.append(row)
    if rows:
        yield own, rows
    trim()


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[int, dict[int, dict[int, bytes]]]:
    """(bucket, {kind: {part: value}}) of rows (bucket, kind, part, piece, data) of one bucket, in any order; parts ascend."""
    b, found = 0, {}
    for batch in batches:
        b = batch.column("bucket")[0].as_py()
        kinds, parts, pieces = (batch.column(n).to_pylist() for n in ("kind", "part", "piece"))
        for kind, part, piece, data in zip(kinds, parts, pieces, batch.column("data"), strict=True):
            found.setdefault(kind, {}).setdefault(part, []).append((piece, data.as_buffer()))
    return b, {kind: {part: _whole(parts.pop(part)) for part in sorted(parts)} for kind, parts in found.items()}


def _merge(shared: Broadcast, schema: pa.Schema):
    """Rows for each bucket, in pieces: its cells (context, word, customers), its tokens by cell, and what sweeps need of the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memos(__name__)
        for b, rows in _by("b", batches):
            for r in rows:
                if not r["data"].is_valid:
                    one = {"b": [b], "chunk": [r["chunk"].as_py()], "ids": pa.array([r["ids"]], schema.field("ids").type), "held": [r["held"]], "n": [r["n"]]}
                    yield pa.RecordBatch.from_arrays([pa.array(one[f.name], f.type) if f.name in one else pa.nulls(1, f.type) for f in schema], schema=schema)
            rows = [r for r in rows if r["data"].is_valid]
            if not rows:
                continue
            split: dict[int, list] = {}
            for r in rows:
                split.setdefault(r["chunk"].as_py(), []).append((r["piece"].as_py(), r["data"].as_buffer()))
            chunks, parts = list(split), [unpack(_whole(x)) for x in split.values()]
            del rows, split
            us, ws = [np.cumsum(p[0]) for p in parts], [np.cumsum(p[2]) for p in parts]
            u_all, w_all = np.unique(np.concatenate(us)), np.unique(np.concatenate(ws))
            key, code = [], []
            for i, (_, cells, _, index, counts, codes) in enumerate(parts):
                at = np.repeat(np.searchsorted(u_all, us[i]), cells).astype(np.uint64) << np.uint64(32) | np.searchsorted(w_all, ws[i])[index].astype(np.uint64)
                key.append(np.repeat(at, counts))
                code.append(codes.astype(np.int64) | i << 17)
            del parts, us, ws
            key, code = np.concatenate(key), np.concatenate(code)
            order = np.argsort(key)
            key, code = key[order], code[order]
            del order
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            counts = np.diff(np.append(starts, len(key)))
            learn = np.add.reduceat(code & 1, starts)
            room, word = (key[starts] >> np.uint64(32)).astype(np.int64), (key[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            del key
            many, one = np.flatnonzero(learn > 1), learn == 1
            at, known = _place(shared.value[0], u_all)
            hot = np.flatnonzero(known)
            made = {
                "cells": pack(
                    steps_of(u_all), narrow(np.bincount(room, minlength=len(u_all))), steps_of(w_all), narrow(word), narrow(learn), np.array(chunks, np.int64)
                ),
                "tokens": pack(narrow(counts), narrow(code)),
                "more": pack(
                    steps_of(room[many].astype(np.uint32)), narrow(word[many]), narrow(learn[many]), narrow(np.bincount(room[one], minlength=len(u_all))),
                    narrow(np.bincount(word[one], minlength=len(w_all))), narrow(hot), narrow(at[hot]),
                ),
            }
            for name, value in made.items():
                pieces = _pieces(value)
                row = {"b": [b] * len(pieces), "piece": range(len(pieces)), name: pieces}
                yield from _thin(pa.RecordBatch.from_arrays(
                    [pa.array(row[f.name], f.type) if f.name in row else pa.nulls(len(pieces), f.type) for f in schema], schema=schema
                ))

    return run


# --- Gibbs sweeps ----------------------------------------------------------------------------------------------------

#: Rows of buckets: requests to the shards of the parent (``shard`` is set), or the seating of a bucket.
_ASKED = "b int, shard int, piece int, data binary, hot array<struct<u:long,c:long,t:long>>"
_HOT = pa.list_(pa.struct([("u", pa.int64()), ("c", pa.int64()), ("t", pa.int64())]))


#: Kinds of rows that are a bucket's own; those of rows that are sent to it are 0 or more.
_CELLS, _TOKENS, _MORE = -3, -2, -1


def _asked(b: int, rows: list[tuple[int | None, bytes]], hot: list[dict]) -> Iterator[pa.RecordBatch]:
    """``hot`` goes with the first row.  What asks no shard is split; a request needs no more than the words of one shard."""
    rows = [(s, i, x) for s, whole in rows for i, x in enumerate(_pieces(whole) if s is None else [whole])]
    yield from _thin(pa.RecordBatch.from_pydict({
        "b": pa.array([b] * len(rows), pa.int32()), "shard": pa.array([s for s, _, _ in rows], pa.int32()),
        "piece": pa.array([i for _, i, _ in rows], pa.int32()), "data": pa.array([x for *_, x in rows], pa.binary()),
        "hot": pa.array([hot, *[None] * (len(rows) - 1)], _HOT),
    }))


def _first_requests(shared: Broadcast, shards: np.ndarray):
    """Ask the shards for the words of a bucket, with their customers and (one a cell) tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memos(__name__)
        b, own = _gather(batches)
        u, cells, w, word, learn, _ = unpack(own[_CELLS][-1])
        u, w, learn = np.cumsum(u), np.cumsum(w), learn.astype(np.int64)
        customers, tables = np.bincount(word, learn, len(w)).astype(np.int64), np.bincount(word[learn > 0], minlength=len(w))
        cuts = np.searchsorted(((w >> np.uint64(32)) * np.uint64(len(shards))) >> np.uint64(32), np.arange(len(shards) + 1))
        rows = [
            (s, pack(steps_of(w[x:y]), narrow(customers[x:y]), narrow(tables[x:y])))
            for s, x, y in zip(shards.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if x < y
        ]
        room = np.repeat(np.arange(len(u)), cells)
        at, known = _place(shared.value[0], u)
        hot = [
            {"u": int(at[r]), "c": int(learn[lo:hi].sum()), "t": int((learn[lo:hi] > 0).sum())}
            for r in np.flatnonzero(known) for lo, hi in [np.searchsorted(room, [r, r + 1])]
        ]
        yield from _asked(b, rows, hot)
        trim()

    return run


_ANSWER = "b int, shard int, data binary, counts binary, v long, n long, c long, t long"


def _serve(sweep: int, gamma: float, words: int):
    """A shard of the parent: its customers are the tables of all contexts.  Draw its own tables, and tell each bucket about its words.

    Sweep 0 begins with one table for each word, and numbers the words of the shard, by which they are named from then on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memos(__name__)
        for shard, rows in _by("shard", batches):
            parts = [unpack(r["data"].as_buffer()) for r in rows]
            first = [np.cumsum(p[0]) for p in parts]
            if sweep == 0:
                names = np.unique(np.concatenate(first))
                places, size = [np.searchsorted(names, x) for x in first], len(names)
                counts = np.zeros(size, np.int64)
                for at, p in zip(places, parts, strict=True):
                    counts[at] += p[1]
            else:
                places = [x.astype(np.int64) for x in first]
                size = 1 + max(int(x[-1]) for x in places)
            customers = np.zeros(size, np.int64)
            for at, p in zip(places, parts, strict=True):
                customers[at] += p[-1]
            known = customers > 0
            tables = known.astype(np.int64)
            if sweep:
                weight = np.full(int(known.sum()), ROOT[0] * gamma / (words + 1))
                tables[known] = draw_tables(customers[known], weight, ROOT[0], np.random.default_rng([SEED, sweep, 1, shard]))
            sums = [int(known.sum()), int(counts.sum()) if sweep == 0 else 0, int(customers.sum()), int(tables.sum())]
            none = [0] * (len(rows) - 1)
            yield from _thin(pa.RecordBatch.from_arrays(
                [
                    pa.array([r["b"].as_py() for r in rows], pa.int32()), pa.array([shard] * len(rows), pa.int32()),
                    pa.array([pack(steps_of(at.astype(np.uint32)), narrow(customers[at]), narrow(tables[at])) for at in places], pa.binary()),
                    pa.array([pack(narrow(counts[at])) if sweep == 0 else None for at in places], pa.binary()),
                    *[pa.array([x, *none], pa.int64()) for x in sums],
                ],
                names=["b", "shard", "data", "counts", "v", "n", "c", "t"],
            ))

    return run


def _answers(values: dict[int, bytes], order: dict[int, int]) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """(shard and places of its words, customers, tables) of a bucket's words, in the words' order."""
    rows = [(s, unpack(values[s])) for s in sorted(values, key=order.__getitem__)]
    return [(s, x[0]) for s, x in rows], *(np.concatenate([x[i] for _, x in rows]).astype(np.int64) for i in (1, 2))


def _seat(sweep: int, figures: dict, hot: Broadcast, shards: np.ndarray):
    """Seat the customers of a bucket's contexts again, given the parent, and ask the shards for the next one."""
    order = {int(s): i for i, s in enumerate(shards)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memos(__name__)
        b, given = _gather(batches)
        room, word, customers, once, once_words, hot_at, hot_of = unpack(given[_MORE][-1])
        room, word, once = np.cumsum(room).astype(np.int64), word.astype(np.int64), once.astype(np.int64)
        places, served, laid = _answers(given[0], order)
        p = parent(served, laid, **figures)
        rng = np.random.default_rng([SEED, sweep, 0, b])
        rooms = Restaurants(room, customers, len(once), CONTEXT, rng, once)
        before = unpack(given[1][-1])[0].astype(np.int64) if 1 in given else rooms.opened()
        del given
        gamma = rng.standard_gamma(CONTEXT[1] / CONTEXT[0] + before)
        gamma[hot_at] = hot.value[hot_of]
        rooms.sweep(p[word], gamma)
        now = rooms.opened()
        tables = once_words + np.bincount(word, rooms.tables, len(once_words)).astype(np.int64)
        cuts = np.cumsum([0] + [len(x) for _, x in places])
        rows = [(s, pack(x, narrow(tables[lo:hi]))) for (s, x), lo, hi in zip(places, cuts[:-1], cuts[1:], strict=True)]
        yield from _asked(b, [(None, pack(narrow(now), narrow(rooms.tables))), *rows], [{"u": int(of), "c": 0, "t": int(now[at])} for at, of in zip(hot_at, hot_of, strict=True)])
        trim()

    return run


# --- scores ----------------------------------------------------------------------------------------------------------


def _score(figures: list[dict], hot: Broadcast, total: int, words: int, shards: np.ndarray):
    """Sums over the tokens of each document that lie in a bucket: base, score, known tokens."""
    order = {int(s): i for i, s in enumerate(shards)}
    floor = math.log10(total + 0.1 * (words + 1))
    discount, strength = CONTEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memos(__name__)
        _, given = _gather(batches)
        u, cells, _, word, learn, chunks = unpack(given[_CELLS][-1])
        hot_at, hot_of = unpack(given[_MORE][-1])[-2:]
        room, learn = np.repeat(np.arange(len(u)), cells), learn.astype(np.int64)
        many = learn > 1
        customers = np.bincount(room, learn, len(u))
        customers[hot_at] = hot.value[0][hot_of]
        p = np.zeros(len(learn))
        for s, sums in enumerate(figures):
            _, served, laid = _answers(given[2 * s + 1], order)
            opened, tables = unpack(given[2 * s + 2][-1])
            opened = opened.astype(np.float64)
            opened[hot_at] = hot.value[s + 1][hot_of]
            seats = (learn > 0).astype(np.float64)
            seats[many] = tables
            p += (learn - discount * seats + (strength + discount * opened)[room] * parent(served, laid, **sums)[word]) / (strength + customers)[room]
        counts = np.concatenate([unpack(given[0][x])[0] for x in sorted(given[0], key=order.__getitem__)]).astype(np.int64)
        packed = given[_TOKENS][-1]
        del given, room, learn
        each, codes = unpack(packed)
        ends = np.cumsum(each.astype(np.int64))
        p = np.log10(p / len(figures))
        single, met = np.log10(counts + 0.1) - floor, counts > 0
        parts, lo = [], 0
        while lo < len(each):  # in steps, so that no array has an entry for each token
            at = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, at + STEP_TOKENS, "right")))
            doc, own = np.unique(codes[at : ends[hi - 1]].astype(np.int64) >> 1, return_inverse=True)
            sums = [np.bincount(own, np.repeat(x, each[lo:hi]), len(doc)) for x in (single[word[lo:hi]], p[lo:hi], met[word[lo:hi]])]
            parts.append((doc, *sums))
            lo = hi
        doc, own = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        base, score, known = (np.bincount(own, np.concatenate([x[i] for x in parts]), len(doc)) for i in (1, 2, 3))
        known = known.astype(np.int64)
        cuts = np.searchsorted(doc >> 16, np.arange(len(chunks) + 1))
        data = [pack((doc[x:y] & 0xFFFF).astype(np.uint16), base[x:y], score[x:y].astype(np.float32), narrow(known[x:y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        yield from _thin(pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int64()), "sums": pa.array(data, pa.binary())}))
        trim()

    return run


def _add_up(schema: pa.Schema):
    """One row for each document of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by("chunk", batches):
            (docs,) = (r for r in rows if r["ids"].is_valid)
            ids, held, n = docs["ids"].values, docs["held"].values, docs["n"].values
            base, score, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for r in rows:
                if r["sums"].is_valid:
                    at, *values = unpack(r["sums"].as_buffer())
                    for into, x in zip((base, score, known), values, strict=True):
                        into[at] += x
            out = {"id": ids, "held_out": held, "n_tokens": n, "n_known": known, "base_score": base, "score": score}
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A-Z are lower-cased; tokens are words ``[^\\x20\\x09-\\x0D]+`` and one end; a null or empty text is the end alone.  Rows
    whose id's crc32 modulo ``folds`` is 0 (a null id is one) teach nothing.  ``base_score`` adds up
    log10((c + 0.1) / (N + 0.1 (V + 1))); ``score`` is the log10 probability of the text in the model.  Rows that repeat an id
    are texts of their own.  An empty table gives an empty result; only the id and the text are read, so no name can clash.

    The model: every word (and the end) is a context with a restaurant that serves the words that follow it; all share a
    unigram parent, whose customers are their tables and whose base is even over the words of the training texts and one
    unknown word.  Seating begins with one table for each cell.  A sweep seats every customer of every context again, given
    the parent, and then every customer of the parent; after BURN sweeps, the predictive probabilities of SAMPLES more are
    averaged.  Without training rows every probability is that of the base.

    Buckets (about BUCKET_TOKENS tokens each) hold whole contexts; frequent ones are dealt over several.  The parent lies in
    as many shards of words; buckets ask each for their words and are answered.  So a task's memory does not depend on the input.
    """
    with scratch() as own, small_batches(docs.sparkSession, size=BATCH_BYTES, read=READ_ROWS):
        return own.keep(_scored(docs, id_col, text_col, folds), "scored")


def _scored(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    context, kind = spark.sparkContext, id_type(docs, id_col)

    def arrow(schema: str) -> pa.Schema:
        return to_arrow_schema(spark.createDataFrame([], schema).schema)

    buckets, hot, deal = _layout(docs, id_col, text_col)
    keys = even_keys(buckets)
    shared = context.broadcast((hot, deal, keys))
    lists = f"ids array<{kind}>, held array<boolean>, n array<long>"
    blocks = map_texts(
        docs, _blocks(shared), f"b int, chunk long, piece int, data binary, {lists}", id_col, text_col, {"held_out": remainder(F.col(id_col), folds) == 0}
    )
    schema = f"b int, chunk long, {lists}, piece int, cells binary, tokens binary, more binary"
    merged = blocks.repartition(buckets, "b").sortWithinPartitions("b", "chunk").mapInArrow(_merge(shared, arrow(schema)), schema)
    table = bucketed_table(merged, "tokens", buckets, "b", WRITTEN)
    del blocks, merged
    free_shuffles(spark)

    def own_rows(**kinds: int) -> DataFrame:
        """Pieces of some of the columns of the table, which stays where it is: a union keeps buckets that have another name than the column."""
        some = table.where(" or ".join(f"{c} is not null" for c in kinds))
        kind = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for c, k in kinds.items()])
        return some.select(F.col("b").alias("bucket"), kind.alias("kind"), F.lit(-1).alias("part"), "piece", F.coalesce(*kinds).alias("data"))

    def given(*tables: DataFrame) -> DataFrame:
        return functools.reduce(DataFrame.unionAll, tables).repartition(buckets, "b")

    def came(df: DataFrame, kind: int, data: str = "data") -> DataFrame:
        piece = F.col("piece") if "piece" in df.columns else F.lit(0).alias("piece")
        return df.select("b", F.lit(kind).alias("kind"), F.coalesce("shard", F.lit(-1)).alias("part"), piece, F.col(data).alias("data"))

    def frequent(df: DataFrame, column: str) -> np.ndarray:
        """Sums over the buckets of the frequent contexts, of which there are at most four a bucket."""
        sums = df.where("hot is not null").select(F.explode("hot").alias("x")).groupBy("x.u").agg(F.sum(f"x.{column}").alias("s")).collect()
        out = np.zeros(len(hot))
        for row in sums:
            out[row.u] = row.s
        return out

    def serve(asked: DataFrame, sweep: int, gamma: float, words: int) -> tuple[DataFrame, object]:
        rows = asked.where("shard is not null").select("shard", "b", "data").repartition(buckets, "shard").sortWithinPartitions("shard", "b")
        answers = shared_table(rows.mapInArrow(_serve(sweep, gamma, words), _ANSWER), "answers", WRITTEN)
        return answers, answers.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "vnct"]).first()

    rng = np.random.default_rng(SEED)
    asked = shared_table(own_rows(cells=_CELLS).groupBy("bucket").applyInArrow(_first_requests(shared, keys), _ASKED), "asked", WRITTEN)
    customers, opened = frequent(asked, "c"), frequent(asked, "t")
    first, sums = serve(asked, 0, 0.0, 0)
    total, words, answers, seated = sums.n, sums.v, first, None
    samples = []
    for sweep in range(1, BURN + SAMPLES + 1):
        figures = {"words": words, "all_customers": sums.c, "all_tables": sums.t}
        gamma = context.broadcast(rng.standard_gamma(CONTEXT[1] / CONTEXT[0] + opened))
        before = [came(answers, 0)] + ([came(seated.where("shard is null"), 1)] if seated else [])
        rows = own_rows(more=_MORE).unionAll(given(*before))
        seated = shared_table(rows.groupBy("bucket").applyInArrow(_seat(sweep, figures, gamma, keys), _ASKED), "seated", WRITTEN)
        opened = frequent(seated, "t")
        answers, sums = serve(seated, sweep, float(rng.standard_gamma(ROOT[1] / ROOT[0] + sums.t)), words)
        if sweep > BURN:
            samples.append((seated, opened, answers, {"words": words, "all_customers": sums.c, "all_tables": sums.t}))

    before = [came(first, 0, "counts")]
    for s, (seats, _, told, _) in enumerate(samples):
        before += [came(told, 2 * s + 1), came(seats.where("shard is null"), 2 * s + 2)]
    rows = own_rows(cells=_CELLS, tokens=_TOKENS, more=_MORE).unionAll(given(*before))
    averages = context.broadcast((customers, *[x for _, x, _, _ in samples]))
    part = rows.groupBy("bucket").applyInArrow(_score([x for *_, x in samples], averages, total, words, keys), "chunk long, sums binary")
    every = part.unionByName(table.where("ids is not null").select("chunk", "ids", "held", "n"), allowMissingColumns=True)
    # The chunks of a task lie together; tasks are dealt evenly.
    parts = shuffle_partitions(spark)
    homes = F.lit(even_keys(parts).tolist())
    home = F.element_at(homes, (F.pmod(F.shiftright("chunk", 24), F.lit(parts)) + 1).cast("int")).cast("int")
    every = every.withColumn("home", home).repartition(parts, "home").sortWithinPartitions("chunk").drop("home")
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return every.mapInArrow(_add_up(arrow(schema)), schema).select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """``held_out, perplexity``: ten to the minus mean log10 probability of a token."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))

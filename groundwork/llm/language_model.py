"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one for every word and for the end token as contexts, and the root, their shared parent, whose base is
uniform over the vocabulary and one class for unknown words. A context that training never saw is an empty
restaurant and gives its parent's probability. Counts of all training documents are customers.

Seating: the state holds the size of every table. A Gibbs step draws a customer of a dish at random, takes it from its
table (an empty table leaves the restaurant, and its customer the parent), and seats it again given all tables that
are there: at a table in proportion to its size less the discount, or at a new one in proportion to the parent's
probability. A sweep makes one such step for every customer of every pair; all customers of a word in the root, or of a
large pair with few tables, are seated at once from their exact conditional. All pairs that end in one word lie
in one shard, which knows the word's seating in the root; between sweeps, shards send the tables of their contexts to
ranges of context hashes, which send back the totals, so a shard's own changes count at once and others' from the next
sweep on; only the root's two totals reach the driver. The first seating is drawn in growing blocks. A pair that occurs
once always has one table, so sweeps carry only the pairs that occur again. Probabilities are averaged over the sweeps
after burn-in; ``perplexity`` sums scores up.

Shards follow the number of training tokens and nothing depends on file layout: equal tables give equal scores.

Tokens: words between ASCII white space with A-Z lower-cased, then one end token.

Defined results: a null text counts as empty and is one end token; a null id trains the model; rows that repeat
count each; an empty table gives no rows; with no training rows every token has probability one; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocks_of, pack, shard_bounds, unpack
from .scratch import discard, release, written

DISCOUNT = (0.8, 0.7)  # of the root, of context restaurants
STRENGTH = (10.0, 5.0)
BURN_IN, SAMPLES = 2, 3
#: Characters of a block of documents.
BLOCK_CHARS = 6_000_000
#: Training tokens of a shard, about, and shards to a range of context hashes.
SHARD_TOKENS, SHARDS_A_RANGE = 1_000_000, 4
#: Dishes of a shard whose steps are made one after another: those with most, too few for arrays.
ALONE = 96
#: Random numbers that a dish alone draws at once.
_DRAWN = 4096
#: Customers and tables up to which all of a word in the root are seated at once; words beyond make steps.
SEATED, SEATED_TABLES = 1 << 16, 24
#: Customers up to which a pair that steps alone, with few tables, is seated at once.
SEATED_ALONE = 1 << 13
END = np.uint64(1)


def held_out(doc_id: Column) -> Column:
    """Documents that are scored but not learnt from. A null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _word_hash(word: bytes) -> int:
    return max(2, xxhash.xxh3_64_intdigest(word))  # 1 is the end token


_BLOCKS = "block bigint, doc_ids array<bigint>, held array<boolean>, lengths binary, tokens binary, vocabulary binary, trained bigint"


def numbered(docs: DataFrame) -> DataFrame:
    """One row per block: documents as numbers into the block's own vocabulary of word hashes."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in blocks_of(batches, "text", BLOCK_CHARS):
            # not by the dictionary's own length: it would refer to itself, and outlive its block by far in a worker
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            parts, lengths = [], []
            for batch in t.to_batches():
                for text in batch.column("text").to_pylist():
                    words = tokens(text)
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                    lengths.append(len(words) + 1)
            hashes = np.fromiter((_word_hash(w) for w in numbers), np.uint64, len(numbers))
            end = len(hashes)
            vocabulary = np.append(hashes, END)
            flat = np.concatenate([np.append(p, end) for p in parts])
            held = np.array(t["held"].to_pylist(), bool)
            counts = np.bincount(flat[np.repeat(~held, lengths)], minlength=len(vocabulary))
            order = np.argsort(-np.bincount(flat, minlength=len(vocabulary)), kind="stable")  # small numbers for frequent words
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            trained = int(counts.sum())
            row = {
                "block": [block], "doc_ids": [t["doc_id"].to_pylist()], "held": [held.tolist()], "lengths": [pack(np.array(lengths, "<i4"))],
                "tokens": [pack(place[flat].astype("<i4"))], "vocabulary": [pack(vocabulary[order])], "trained": [trained],
            }
            kinds = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "trained": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in row.items()], list(row))

    return docs.mapInArrow(number, _BLOCKS)


def _entries(row: dict) -> tuple[np.ndarray, ...]:
    """Of a block: word hashes (sorted), their training counts; pairs (word, context), their counts; the pair and the word of each token."""
    (flat,), (vocabulary,), (lengths,) = unpack(row["tokens"]), unpack(row["vocabulary"]), unpack(row["lengths"])
    learnt = np.repeat(~np.array(row["held"], bool), lengths)
    order = np.argsort(vocabulary, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    flat = place[flat]  # now numbers into the sorted hashes
    words = vocabulary[order]
    counts = np.bincount(flat[learnt], minlength=len(words))
    context = np.empty(len(flat), np.int64)
    context[1:] = flat[:-1]
    context[0] = np.searchsorted(words, END)  # a document begins after an end token
    pairs, of = np.unique(flat * len(words) + context, return_inverse=True)
    pair_counts = np.bincount(of[learnt], minlength=len(pairs))
    return words, counts, pairs // len(words), pairs % len(words), pair_counts, of, flat, lengths


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences, which pack better."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _whole(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def _to_shards(blocks: DataFrame, n: int) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                words, counts, pair_word, pair_context, pair_counts, *_ = _entries(row)
                edge = shard_bounds(words, n)
                cut = np.searchsorted(pair_word, edge)
                packed, kept = [], np.flatnonzero(np.diff(edge))
                for i, j, k, m in zip(edge[kept], edge[kept + 1], cut[kept], cut[kept + 1]):
                    contexts, of_context = np.unique(pair_context[k:m], return_inverse=True)
                    packed.append(pack(_steps(words[i:j]), counts[i:j].astype("<u4"), _steps(words[contexts]), (pair_word[k:m] - i).astype("<u4"), of_context.astype("<u4"), pair_counts[k:m].astype("<u4")))
                yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(np.full(len(kept), row["block"])), pa.array(packed, pa.binary())], ["shard", "block", "entries"])

    read = blocks.select("block", "held", "lengths", "tokens", "vocabulary")
    return read.mapInArrow(deal, "shard bigint, block bigint, entries binary")


_SHARDS = "shard bigint, contexts binary, counts binary, pairs binary, blocks array<bigint>, words_of array<binary>, types bigint"


def _gather(dealt: DataFrame) -> DataFrame:
    """One row per shard: its contexts, counts of its words and pairs over all blocks, and where each block's entries are among them."""

    def gather(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in t["entries"].to_pylist()]
        parts = [(_whole(p[0]), p[1], _whole(p[2]), *p[3:]) for p in parts]
        words, of_word = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        contexts, of_context = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        counts = np.bincount(of_word, np.concatenate([p[1] for p in parts]), len(words)).astype("<i8")
        starts, begins = (np.cumsum([0, *(len(p[k]) for p in parts)]) for k in (0, 2))
        keys = np.concatenate([of_word[p[3].astype(np.int64) + s] * len(contexts) + of_context[p[4].astype(np.int64) + c] for p, s, c in zip(parts, starts, begins)])
        pairs, of_pair = np.unique(keys, return_inverse=True)
        pair_counts = np.bincount(of_pair, np.concatenate([p[5] for p in parts]), len(pairs)).astype("<i8")
        cuts = np.cumsum([0, *(len(p[3]) for p in parts)])
        places = [pack(_steps(of_word[i:j].astype("<u4")), _steps(of_pair[k:m].astype("<u4"))) for i, j, k, m in zip(starts, starts[1:], cuts, cuts[1:])]
        wide = max(1, len(contexts))
        row = {
            "shard": [t["shard"][0].as_py()], "contexts": [pack(contexts)], "counts": [pack(counts)], "pairs": [pack((pairs // wide).astype("<u4"), (pairs % wide).astype("<u4"), pair_counts)],
            "blocks": [t["block"].to_pylist()], "words_of": [places], "types": [int((counts > 0).sum())],
        }
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64()]
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(row.items(), kinds)})

    return dealt.groupBy("shard").applyInArrow(gather, _SHARDS)


def first_tables(customers: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables to begin with: of blocks of 1, 2, 4, ... customers, each opens tables with the odds at its middle."""
    tables, seated = (customers > 0).astype(np.int64), 1
    active = np.flatnonzero(customers > 1)
    while len(active):
        block = np.minimum(customers[active] - seated, seated)
        n = seated + (block - 1) / 2
        odds = mass[active] / (mass[active] + np.maximum(n - discount * tables[active], 1e-9))
        tables[active] += rng.binomial(block, np.clip(odds, 0, 1))
        seated *= 2
        active = active[customers[active] > seated]
    return tables


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each of some slices."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def first_sizes(customers: np.ndarray, tables: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes of the tables of all dishes, one after another: one customer each, the rest by random weights."""
    of, first = np.repeat(np.arange(len(tables)), tables), np.cumsum(tables) - tables
    weight = rng.gamma(1 - discount, size=len(of)) + 1e-12
    upto = np.cumsum(weight)
    total = np.bincount(of, weight, len(tables))
    share = (upto - np.repeat((upto - weight)[first[tables > 0]], tables[tables > 0])) / total[of]
    seats = np.minimum(np.rint(share * (customers - tables)[of]), (customers - tables)[of]).astype(np.int64)
    last = (first + tables - 1)[tables > 0]
    seats[last] = (customers - tables)[tables > 0]
    begin = np.zeros(len(of), bool)
    begin[first[tables > 0]] = True
    return 1 + seats - np.where(begin, 0, np.concatenate([[0], seats[:-1]]))


def draws(customers: np.ndarray) -> np.ndarray:
    """Gibbs steps of a dish in one sweep: one for each customer; one that is alone always has the one table."""
    return np.where(customers > 1, customers, 0).astype(np.int64)


def move_one(sizes: list[int], leave: int, come: int, mass: Callable, discount: float, rng: np.random.Generator) -> list[int]:
    """Sizes of one dish's tables after its steps. ``mass(by)``: the mass of a new table when ``by`` more than at first are there."""
    seat, sizes = np.repeat(np.arange(len(sizes)), sizes).tolist(), list(sizes)
    rand, n, t, by, free = random.Random(int(rng.integers(1 << 62))).random, len(seat), len(sizes), 0, []
    both = min(leave, come) if n > 1 else 0  # a customer that is alone would open its table again
    known: dict[int, float] = {}

    def odds(by: int, t: int) -> float:
        """That one of the dish's customers, the others being seated at ``t`` tables, opens a new one."""
        if by not in known:
            new = mass(by)
            known[by] = new / (new + max(n - 1 - discount * t, 0.0))
        return known[by]

    opens = odds(0, t) if both else 0.0
    for r in range(0, both, _DRAWN):
        m = min(_DRAWN, both - r)
        who = rng.integers(0, n, m)
        other = (who + rng.integers(1, n, m)) % n  # a random one of those that stay
        for i, j, u, v in zip(who.tolist(), other.tolist(), rng.random(m).tolist(), rng.random(m).tolist()):
            k = seat[i]
            size = sizes[k]
            if size > 1:
                if u < opens:
                    sizes[k] = size - 1
                    if free:
                        seat[i] = k = free.pop()
                        sizes[k] = 1
                    else:
                        seat[i] = len(sizes)
                        sizes.append(1)
                    t, by = t + 1, by + 1
                    opens = odds(by, t)
                    continue
                sizes[k] = size - 1
            else:
                fewer = odds(by - 1, t - 1)
                if u < fewer:
                    continue
                sizes[k], opens, t, by = 0, fewer, t - 1, by - 1
                free.append(k)
            k = seat[j]  # the table of a random customer, with the odds that leave each its size less the discount
            while v * sizes[k] < discount:
                j = int(rand() * n)
                while j == i:
                    j = int(rand() * n)
                k, v = seat[j], rand()
            sizes[k] += 1
            seat[i] = k
    for _ in range(leave - min(leave, come)):
        i = int(rand() * n)
        k = seat[i]
        n -= 1
        seat[i] = seat[n]
        seat.pop()
        sizes[k] -= 1
        if not sizes[k]:
            free.append(k)
    if come > leave:
        new = mass(by)
    for _ in range(come - min(leave, come)):
        if not n or rand() * (new + n - discount * t) < new:
            if free:
                k = free.pop()
                sizes[k] = 1
            else:
                k = len(sizes)
                sizes.append(1)
            t += 1
            by += 1
            new = mass(by)
        else:
            k = seat[int(rand() * n)]
            while rand() * sizes[k] < discount:
                k = seat[int(rand() * n)]
            sizes[k] += 1
        seat.append(k)
        n += 1
    return [s for s in sizes if s]


def move(
    tables: np.ndarray, sizes: np.ndarray, leave: np.ndarray, come: np.ndarray, mass: Callable, changed: Callable, discount: float, rng: np.random.Generator, single: Callable | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Tables and sizes after ``leave`` random customers of each dish left and ``come`` were seated, step by step.

    In a step one customer leaves and one comes. ``mass(dishes, gone)`` is the mass of a new table, where ``gone``
    says that the dish has just lost one; ``changed(dishes, by)`` hears how many tables came or went. Dishes step
    side by side, but the ``ALONE`` with most steps one after another, if ``single(dish)`` gives their ``mass(by)``. Of
    these, large ones with few tables whose customers all step are seated at once.
    """
    steps = np.maximum(leave, come)
    order = np.argsort(-steps, kind="stable")
    order = order[: int((steps > 0).sum())]
    if not len(order):
        return tables, sizes
    source, after = np.cumsum(tables) - tables, tables.copy()
    alone, order = (order[:ALONE], order[ALONE:]) if single else (order[:0], order)
    apart: dict[int, list[int] | np.ndarray] = {}
    joint = {}
    for k in alone.tolist():
        own, one, t = sizes[source[k] : source[k] + tables[k]], single(k), 0
        n = int(own.sum())
        if leave[k] == come[k] == n and 2 * SEATED_TABLES <= n <= SEATED_ALONE and tables[k] <= SEATED_TABLES // 2:
            masses = np.array([[one(j - int(tables[k]))] for j in range(1, SEATED_TABLES)])
            t = int(_tables_by(np.array([n]), masses, SEATED_ALONE, discount, rng)[0])
        if t:
            joint[k], after[k] = n, t
        else:
            apart[k] = move_one(own.tolist(), int(leave[k]), int(come[k]), one, discount, rng)
            after[k] = len(apart[k])
        changed(np.array([k]), np.array([after[k] - tables[k]]))
    if joint:
        at = np.array(list(joint))
        together = seat_sizes(np.array(list(joint.values())), after[at], discount, rng, SEATED_ALONE)
        apart |= zip(joint, np.split(together, np.cumsum(after[at])[:-1]))
    steps, leave, come = steps[order], leave[order], come[order]
    held, t = tables[order], tables[order].copy()
    filled = np.repeat(np.arange(len(order)), held)  # the dish of each table
    n = np.bincount(filled, sizes[_ragged(source[order], held)], len(order)).astype(np.int64)
    start = np.cumsum(np.concatenate([[0], n + np.maximum(come - leave, 0)]))  # a place for each customer that may be there at once
    start, places = start[:-1], int(start[-1])
    # Tables of a dish have the numbers of its places; those without customers are a stack
    size, seat, spare = np.zeros(places, np.int32), np.zeros(places, np.int32), np.arange(places, dtype=np.int32)
    number = _ragged(start, held)
    size[number] = sizes[_ragged(source[order], held)]
    seat[_ragged(start, n)] = np.repeat(number, size[number])
    active = np.searchsorted(-steps, -np.arange(int(steps[0]) if len(order) else 0)).tolist()
    if np.array_equal(leave, come):  # nobody is missing after a step, so the one that comes takes the place of the one that left
        others = n - 1
        for m in active:
            was, begin, stays = t[:m].copy(), start[:m], others[:m]
            i = (rng.random(m) * n[:m]).astype(np.int64)
            at = begin + i
            k = seat[at]
            left = size[k] - 1
            size[k] = left
            gone = left == 0
            some = np.flatnonzero(gone)
            t[some] -= 1
            spare[begin[some] + t[some]] = k[some]
            new = mass(order[:m], gone)
            fresh = rng.random(m) * (new + stays - discount * t[:m]) < new
            stay, fresh = np.flatnonzero(~fresh), np.flatnonzero(fresh)
            while len(stay):  # the table of a random customer, with the odds that leave each its size less the discount
                j = i[stay] + 1 + (rng.random(len(stay)) * stays[stay]).astype(np.int64)
                j -= np.where(j >= n[stay], n[stay], 0)
                k = seat[begin[stay] + j]
                own = size[k]
                took = rng.random(len(stay)) * own >= discount
                size[k] = own + took
                seat[at[stay[took]]] = k[took]
                stay = stay[~took]
            k = spare[begin[fresh] + t[fresh]]
            size[k] = 1
            seat[at[fresh]] = k
            t[fresh] += 1
            by = t[:m] - was
            some = np.flatnonzero(by)
            changed(order[some], by[some])
        active = []
    for r, m in enumerate(active):
        gone, was = np.zeros(m, np.int64), t[:m].copy()
        out = np.flatnonzero(leave[:m] > r)
        if len(out):
            at = start[out] + (rng.random(len(out)) * n[out]).astype(np.int64)
            k = seat[at]
            n[out] -= 1
            seat[at] = seat[start[out] + n[out]]
            size[k] -= 1
            empty = size[k] == 0
            gone[out] = empty
            some = out[empty]
            t[some] -= 1
            spare[start[some] + t[some]] = k[empty]
        into = np.flatnonzero(come[:m] > r)
        if len(into):
            new, old = mass(order[into], gone[into]), n[into] - discount * t[into]
            fresh = rng.random(len(into)) * (new + old) < new
            fresh |= n[into] == 0
            stay, fresh = into[~fresh], into[fresh]
            while len(stay):  # the table of a random customer, with the odds that leave each its size less the discount
                k = seat[start[stay] + (rng.random(len(stay)) * n[stay]).astype(np.int64)]
                took = rng.random(len(stay)) * size[k] >= discount
                sat, k = stay[took], k[took]
                size[k] += 1
                seat[start[sat] + n[sat]] = k
                stay = stay[~took]
            k = spare[start[fresh] + t[fresh]]
            size[k] = 1
            seat[start[fresh] + n[fresh]] = k
            t[fresh] += 1
            n[into] += 1
        by = t[:m] - was
        at = np.flatnonzero(by)
        changed(order[at], by[at])
    after[order] = t
    place = np.cumsum(after) - after
    still = np.ones(len(tables), bool)
    still[order], still[alone] = False, False
    flat = np.empty(int(after.sum()), np.int64)
    flat[_ragged(place[still], after[still])] = sizes[_ragged(source[still], after[still])]
    flat[_ragged(place[order], t)] = size[size > 0]
    for k, own in apart.items():
        flat[place[k] : place[k] + len(own)] = own
    return after, flat


@lru_cache(maxsize=3)
def seatings(discount: float, customers: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """By tables t and customers n: seatings of n at t over those where the last n - t open no table; seatings at t over those at t - 1."""
    n = np.arange(customers + 1, dtype=np.float64)
    opened, ratio = np.zeros((2, tables + 1, customers + 1))
    opened[1, 1:] = 1
    for t in range(2, min(tables, customers) + 1):
        m = n[t:]
        # what one more table at a time weighs, step by step from the first t - 1 customers
        weight = np.cumprod(np.r_[1.0, (n[t - 1 : -1] - discount * (t - 1)) / (m - discount * t)])
        opened[t, t:] = np.cumsum(opened[t - 1, t - 1 : -1] * weight[:-1])
        ratio[t, t:] = opened[t, t:] / (opened[t - 1, t:] * (m - discount * t) * weight[1:])
    return opened, ratio


def seat_tables(customers: np.ndarray, mass: np.ndarray, more: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes, all customers of a dish drawn together from their exact conditional; 0 where it reaches beyond
    the tabulated ones. A dish's first table has ``mass``, each further one ``more`` than the one before."""
    most = min(SEATED_TABLES, int(customers.max()))
    return _tables_by(customers, mass + more * np.arange(1, most)[:, None], SEATED, discount, rng)


def _tables_by(customers: np.ndarray, mass: np.ndarray, limit: int, discount: float, rng: np.random.Generator) -> np.ndarray:
    """As ``seat_tables``, by the masses of each dish's second, third, ... table."""
    most = len(mass) + 1
    _, ratio = seatings(discount, limit, SEATED_TABLES)
    odds = ratio[2 : most + 1, customers] * mass
    upto = np.cumsum(np.concatenate([np.ones((1, len(customers))), np.cumprod(odds, axis=0)]), axis=0)
    tables = 1 + (upto < rng.random(len(customers)) * upto[-1]).sum(axis=0)
    beyond = (customers > most) & (upto[-1] - upto[-2] > 1e-15 * upto[-1]) if most > 1 else customers > most
    return np.where(beyond, 0, tables)


def seat_sizes(customers: np.ndarray, tables: np.ndarray, discount: float, rng: np.random.Generator, limit: int | None = None) -> np.ndarray:
    """Sizes of dishes' tables given their number, one dish after another: who opened each, then how the others joined."""
    opened, _ = seatings(discount, limit or SEATED, SEATED_TABLES)
    order = np.argsort(-tables, kind="stable")
    n, t, wide = customers[order], tables[order], int(tables.max(initial=0))
    first = np.zeros((len(n), wide + 2), np.int64)  # the customer, from 1, that opened each table; after the last one the end
    first[np.arange(len(n)), t + 1] = n + 1
    first[:, 1] = np.where(t > 0, 1, first[:, 1])
    for back in range(wide - 1):
        d = np.flatnonzero(t - back >= 2)
        k = t[d] - back
        low, high = k.copy(), first[d, k + 1] - 1
        sought = (1 - rng.random(len(d))) * opened[k, high]
        while (low < high).any():
            middle = (low + high) // 2
            less = opened[k, middle] < sought
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        first[d, k] = high
    size = np.zeros((len(n), wide), np.int64)
    for k in range(1, wide + 1):
        d = int(np.searchsorted(-t, -k, side="right"))
        size[:d, k - 1] = 1
        weight = rng.standard_gamma(size[:d, :k] - discount)
        size[:d, :k] += rng.multinomial(first[:d, k + 1] - first[:d, k] - 1, weight / weight.sum(axis=1, keepdims=True))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    size = size[back]
    return size[size > 0]


class Sweeps:
    """The seating of one shard; repeatable, so that a task that is run again gives the same."""

    def __init__(self, row: dict, n_contexts: int, vocabulary: int):
        (self.counts,), (self.word, self.context, self.pair_counts) = unpack(row["counts"]), unpack(row["pairs"])
        self.word, self.context = self.word.astype(np.int64), self.context.astype(np.int64)
        self.shard, self.n_contexts, self.base = row["shard"], n_contexts, 1.0 / (vocabulary + 1)
        # tokens of the root itself: those of pairs that are not here
        self.direct = self.counts - np.bincount(self.word, self.pair_counts, len(self.counts)).astype(np.int64)
        self.tables, self.sizes = np.minimum(self.pair_counts, 1).astype(np.int64), self.pair_counts[self.pair_counts > 0]
        customers = self.customers()
        self.root_tables, self.root_sizes = np.minimum(customers, 1), customers[customers > 0]

    def totals(self) -> np.ndarray:
        """Tables of every context, then the root's tables and customers."""
        by_context = np.bincount(self.context, self.tables, self.n_contexts)
        return np.concatenate([by_context, [self.root_tables.sum(), self.customers().sum()]])

    def customers(self) -> np.ndarray:
        return self.direct + np.bincount(self.word, self.tables, len(self.counts)).astype(np.int64)

    def root(self, totals: np.ndarray) -> np.ndarray:
        """The root's probability of each of the shard's words."""
        tables, customers = totals[-2:]
        d, s = DISCOUNT[0], STRENGTH[0]
        return (np.maximum(self.customers() - d * self.root_tables, 0) + (s + d * tables) * self.base) / (s + customers)

    def begin(self, totals: np.ndarray) -> None:
        """The first seating."""
        rng = np.random.default_rng([self.shard, 0])
        mass = (STRENGTH[1] + DISCOUNT[1] * totals[self.context]) * self.root(totals)[self.word]
        self.tables = first_tables(self.pair_counts, mass, DISCOUNT[1], rng)
        self.sizes = first_sizes(self.pair_counts, self.tables, DISCOUNT[1], rng)
        customers = self.customers()
        self.root_tables = first_tables(customers, np.full(len(customers), (STRENGTH[0] + DISCOUNT[0] * totals[-2]) * self.base), DISCOUNT[0], rng)
        self.root_sizes = first_sizes(customers, self.root_tables, DISCOUNT[0], rng)

    def sweep(self, number: int, totals: np.ndarray) -> None:
        rng = np.random.default_rng([self.shard, number])
        of_context, (root_tables, root_customers) = totals[:-2].copy(), totals[-2:]
        d, s, before = DISCOUNT[0], STRENGTH[0], self.customers()
        customers = before.copy()

        def mass(pairs: np.ndarray, gone: np.ndarray) -> np.ndarray:
            w = self.word[pairs]
            here = customers[w] - gone
            parent = (np.maximum(here - d * np.minimum(self.root_tables[w], here), 0) + (s + d * root_tables) * self.base) / (s + root_customers - gone)
            return (STRENGTH[1] + DISCOUNT[1] * np.maximum(of_context[self.context[pairs]] - gone, 0)) * parent

        def changed(pairs: np.ndarray, by: np.ndarray) -> None:
            np.add.at(of_context, self.context[pairs], by)
            np.add.at(customers, self.word[pairs], by)

        def pair_alone(pair: int) -> Callable:
            w = self.word[pair]
            here, tables, own = float(customers[w]), float(self.root_tables[w]), float(of_context[self.context[pair]])
            above, of_root = float((s + d * root_tables) * self.base), float(s + root_customers)

            def mass(by: int) -> float:
                n = here + by
                return (STRENGTH[1] + DISCOUNT[1] * max(own + by, 0.0)) * (max(n - d * min(tables, n), 0.0) + above) / (of_root + by)

            return mass

        steps = draws(self.pair_counts)
        self.tables, self.sizes = move(self.tables, self.sizes, steps, steps, mass, changed, DISCOUNT[1], rng, pair_alone)
        self._sweep_root(before, customers, root_tables, rng)

    def _sweep_root(self, before: np.ndarray, customers: np.ndarray, root_tables: float, rng: np.random.Generator) -> None:
        """All customers of a word are seated at once. Words beyond ``seatings`` first take in or lose those that the
        contexts sent or took, then make their steps."""
        d, s, total = DISCOUNT[0], STRENGTH[0], [float(root_tables)]
        tables = np.minimum(customers, 1)
        order = np.flatnonzero((customers > 1) & (customers <= SEATED))
        order = order[np.argsort(customers[order], kind="stable")]
        at = 0
        while at < len(order):
            # so few side by side that their tables hardly change what all share
            some = order[at : at + max(1, int(total[0]) // 1000)]
            own = self.root_tables[some]
            new = seat_tables(customers[some], (s + d * (total[0] - own)) * self.base, d * self.base, d, rng)
            tables[some] = new
            total[0] += (new - own)[new > 0].sum()
            at += len(some)
        step = (customers > SEATED) | ((customers > 0) & (tables == 0))

        def of_root(words: np.ndarray, gone: np.ndarray) -> np.ndarray:
            return np.maximum(s + d * (total[0] - gone), s) * self.base

        def root_changed(words: np.ndarray, by: np.ndarray) -> None:
            total[0] += by.sum()

        def root_alone(word: int) -> Callable:
            tables, base = float(total[0]), float(self.base)
            return lambda by: max(s + d * (tables + by), s) * base

        seated = seat_sizes(np.where(step, 0, customers), np.where(step, 0, tables), d, rng)
        if step.any():
            stepped, kept = self.root_tables[step], self.root_sizes[np.repeat(step, self.root_tables)]
            more, steps = (customers - before)[step], draws(customers[step])
            for leave, come in ((np.maximum(-more, 0), np.maximum(more, 0)), (steps, steps)):
                stepped, kept = move(stepped, kept, leave, come, of_root, root_changed, d, rng, root_alone)
            tables[step] = stepped
            sizes = np.empty(len(seated) + len(kept), np.int64)
            where = np.repeat(step, tables)
            sizes[where], sizes[~where] = kept, seated
            seated = sizes
        self.root_tables, self.root_sizes = tables, seated

    def pair(self, totals: np.ndarray, context_customers: np.ndarray) -> np.ndarray:
        """Probability of each (context, word) of the shard, seen in training or not."""
        own = np.maximum(self.pair_counts - DISCOUNT[1] * self.tables, 0)
        weight = STRENGTH[1] + DISCOUNT[1] * totals[self.context]
        return (own + weight * self.root(totals)[self.word]) / (STRENGTH[1] + context_customers[self.context])


_STATE = "shard bigint, contexts binary, own binary, counts binary, pairs binary, start binary, tables binary, history binary, root_tables double, root_customers double"
_SENT = "range bigint, shard bigint, asks boolean, part binary"


def _row(columns: str, values: dict) -> pa.Table:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    return pa.table({k: pa.array([values[k]], kinds[kind]) for k, kind in (c.split() for c in columns.split(", "))})


def _sent(rows: DataFrame, n: int, asks: bool, own: Callable[[dict, int], list[np.ndarray]]) -> DataFrame:
    """To ranges of context hashes: what the shards hold of their contexts, ``own(row, number of contexts)``. Worked out by the
    function that sends it, for Python functions that feed one another hold a Python worker each."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                (contexts,) = unpack(row["contexts"])
                held, edge = own(row, len(contexts)), shard_bounds(contexts, n)
                kept = np.flatnonzero(np.diff(edge))
                packed = [pack(_steps(contexts[i:j]), *(x[i:j] for x in held)) for i, j in zip(edge[kept], edge[kept + 1])]
                columns = [pa.array(kept), pa.array(np.full(len(kept), row["shard"])), pa.array([asks] * len(kept), pa.bool_()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["range", "shard", "asks", "part"])

    return rows.mapInArrow(send, _SENT)


def _sent_all(gathered: DataFrame, n: int, asks: bool, empty: int) -> DataFrame:
    """Of all contexts of the shards: customers, tables before the first sweep, and ``empty`` zeros each."""

    def own(row: dict, contexts: int) -> list[np.ndarray]:
        _, context, counts = unpack(row["pairs"])
        sums = [np.bincount(context, w, contexts).astype("<u4") for w in (counts, counts > 0)]
        return [*sums, *[np.zeros(contexts, "<u4")] * empty]

    return _sent(gathered.select("shard", "contexts", "pairs"), n, asks, own)


def _sent_own(states: DataFrame, n: int) -> DataFrame:
    """What the last sweep left at the contexts of the shards' states, which ask for the sums."""
    return _sent(states.select("shard", "contexts", "own"), n, True, lambda row, contexts: unpack(row["own"]))


def _sent_added(states: DataFrame, n: int) -> DataFrame:
    """What the sampled sweeps added to the tables of each context, in the columns after those of ``_sent_all``."""

    def own(row: dict, contexts: int) -> list[np.ndarray]:
        return [np.zeros(contexts, "<u4")] * 2 + unpack(row["history"])[2::3]

    return _sent(states.select("shard", "contexts", "history"), n, False, own)


def _started(gathered: DataFrame) -> DataFrame:
    """Shards with the pairs that occur more than once and their contexts; all else are the root's own tokens."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                (contexts,), (word, context, counts) = unpack(row["contexts"]), unpack(row["pairs"])
                more = counts > 1
                at, context = np.unique(context[more], return_inverse=True)
                zeros = np.zeros(len(at), "<u4")
                new = {"shard": row["shard"], "contexts": pack(contexts[at]), "own": pack(zeros, zeros), "counts": row["counts"], "pairs": pack(word[more], context.astype("<u4"), counts[more])}
                s = Sweeps(new, len(at), 0)
                new |= {"start": None, "tables": None, "history": None, "root_tables": float(s.root_tables.sum()), "root_customers": float(s.customers().sum())}
                yield from _row(_STATE, new).to_batches()

    return gathered.select("shard", "contexts", "counts", "pairs").mapInArrow(start, _STATE)


def _exchanged(sent: DataFrame) -> DataFrame:
    """By shard that asks and range of context hashes: the sums over all that was ``sent`` for each of the shard's contexts."""

    def add(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in t["part"].to_pylist()]
        contexts, of = np.unique(np.concatenate([_whole(p[0]) for p in parts]), return_inverse=True)
        totals = [np.bincount(of, np.concatenate([p[k] for p in parts]), len(contexts)).astype("<i8") for k in range(1, len(parts[0]))]
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        asked = np.flatnonzero(t["asks"].to_numpy(zero_copy_only=False))
        packed = [pack(*(x[of[cut[k] : cut[k + 1]]] for x in totals)) for k in asked.tolist()]
        return pa.table({"shard": t["shard"].take(pa.array(asked)), "range": t["range"].take(pa.array(asked)), "total": pa.array(packed, pa.binary())})

    return sent.groupBy("range").applyInArrow(add, "shard bigint, range bigint, total binary")


def _received(right: pa.Table, columns: int) -> list[np.ndarray]:
    parts = [unpack(x) for r, x in sorted((r, x) for r, x in zip(right["range"].to_pylist(), right["total"].to_pylist()) if r >= 0)]
    return [np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)]) for k in range(columns)]


def _swept(states: DataFrame, totals: DataFrame, number: int, root: list[float], vocabulary: int, sample: bool) -> DataFrame:
    """States after the first seating (number 0) or one more sweep, by the totals before; a ``sample`` joins the history."""

    def sweep(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row, got = left.to_pylist()[0], _received(right, 1 if number else 2)
        # First come all tables before the first seating, later those that were added since
        start = got[1] if number == 0 else unpack(row["start"])[0]
        total = np.concatenate([start if number == 0 else start + got[0], root])
        s = Sweeps(row, len(start), vocabulary)
        if number:
            s.tables, s.sizes, s.root_tables, s.root_sizes = (x.astype(np.int64) for x in unpack(row["tables"]))
            s.sweep(number, total)
        else:
            s.begin(total)
        added = np.bincount(s.context, s.tables - 1, len(start)).astype("<u4")
        seats = [x.astype("<u4") for x in (s.tables, s.sizes, s.root_tables, s.root_sizes)]
        history = [*(unpack(row["history"]) if row["history"] else []), seats[0], seats[2], added] if sample else []
        new = {"own": pack(added), "start": pack(start), "tables": pack(*seats), "history": pack(*history) if sample else None}
        return _row(_STATE, row | new | {"root_tables": float(s.root_tables.sum()), "root_customers": float(s.customers().sum())})

    return states.groupBy("shard").cogroup(totals.groupBy("shard")).applyInArrow(sweep, _STATE)


def _answers(gathered: DataFrame, states: DataFrame, n: int, roots: list[list[float]], vocabulary: int) -> DataFrame:
    """By block and shard: counts of the block's words and log probabilities of its pairs. ``roots``: the root's totals after each sampled sweep."""

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (row,), (customers, start, *added) = left.to_pylist(), _received(right, 2 + len(roots))
        (history,) = (unpack(x) for r, x in zip(right["range"].to_pylist(), right["total"].to_pylist()) if r < 0)
        s = Sweeps(row, len(start), vocabulary)
        more, pair = s.pair_counts > 1, np.zeros(len(s.word))
        for k, root in enumerate(roots):
            s.tables[more], s.root_tables = history[3 * k], history[3 * k + 1].astype(np.int64)
            pair += s.pair(np.concatenate([start + added[k], root]), customers)
        pair = np.log10(pair / len(roots))
        out = []
        for places in row["words_of"]:
            of_word, of_pair = (_whole(x) for x in unpack(places))
            out.append(pack(s.counts[of_word].astype("<u4"), pair[of_pair].astype("<f4")))
        return pa.table({"block": pa.array(row["blocks"], pa.int64()), "shard": pa.array([row["shard"]] * len(out), pa.int64()), "answer": pa.array(out, pa.binary())})

    totals = _exchanged(_sent_all(gathered, n, True, len(roots)).unionAll(_sent_added(states, n)))
    right = totals.unionAll(states.select("shard", F.lit(-1).cast("bigint").alias("range"), F.col("history").alias("total")))
    return gathered.drop("types", "contexts").groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(answer, "block bigint, shard bigint, answer binary")


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(blocks: DataFrame, answers: DataFrame, trained: int, types: int) -> DataFrame:
    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        parts = [unpack(x) for _, x in sorted(zip(right["shard"].to_pylist(), right["answer"].to_pylist()))]
        *_, of, flat, lengths = _entries(row)
        c = np.concatenate([p[0] for p in parts]).astype(np.float64)
        model = np.concatenate([p[1] for p in parts])[of].astype(np.float64)
        base = np.log10((c + 1) / (trained + types + 1))[flat]
        starts = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, starts)
        n = len(lengths)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": row["held"], "n_tokens": pa.array(lengths.astype(np.int64)),
                "n_known": pa.array(add((c > 0)[flat].astype(np.int64))), "train_tokens": pa.array(np.full(n, trained, np.int64)),
                "base_score": pa.array(add(base)), "score": pa.array(add(model)),
            }
        )

    left = blocks.select("block", "doc_ids", "held", "lengths", "tokens", "vocabulary")
    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCORES)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Base and model scores of every whole text of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held"))
    blocks = written(numbered(rows), "lm-blocks")
    trained = blocks.agg(F.sum("trained")).first()[0] or 0
    n = max(1, -(-trained // SHARD_TOKENS))
    ranges = -(-n // SHARDS_A_RANGE)
    gathered = written(_gather(_to_shards(blocks, n)), "lm-shards")
    types = gathered.agg(F.sum("types")).first()[0] or 0
    release(spark)  # after a query: Spark holds on to a plan until the next one has begun
    states = written(_started(gathered), "lm-state")
    roots = [_root(states)]
    for number in range(1 + burn_in + samples):
        sent = _sent_own(states, ranges) if number else _sent_all(gathered, ranges, False, 0).unionAll(_sent_own(states, ranges))
        before, states = states, written(_swept(states, _exchanged(sent), number, roots[-1], types, number > burn_in), "lm-state")
        discard(before)
        del sent, before
        roots.append(_root(states))
        release(spark)
    answers = written(_answers(gathered, states, ranges, roots[burn_in + 2 :], types), "lm-answers")
    for done in (gathered, states):
        discard(done)
    spark.range(1).collect()
    release(spark)
    return _scored(blocks, answers, trained, types)


def perplexity(scores: DataFrame) -> DataFrame:
    """By held_out: tokens, and the perplexities of the base and the model over them."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per("base_score").alias("base_perplexity"), per("score").alias("perplexity"))


def _root(states: DataFrame) -> list[float]:
    """The root's tables and customers."""
    return [float(x or 0) for x in states.agg(F.sum("root_tables"), F.sum("root_customers")).first()]

"""Mixing by iterative proportional fitting.

Token weights of the cells source x language x topic are raked until their marginals meet the targets, and every
document is kept with its cell's calibrated probability, decided by a hash of its id and text. No class is pooled and
no rate is bounded from below. ``BUDGET`` of all tokens are kept. A class that has fewer tokens than its target of them
is wanted whole, and the rest goes to the others in proportion; rates are products of the classes' factors, at most 1.
``marginals`` shows targets and what was reached.

Topics are learnt from all texts: hashed words, weighted by rarity, are clustered by direction (``TOPICS`` centres, fitted
on every distinct text by sums of whole numbers, so file layout changes nothing); every text gets the nearest centre, and
"none" where it has no word that tells topics apart. Everything else counts all documents.

Cells are raked on the driver up to ``DRIVER_CELLS`` of them, a checked number, and as a table beyond; both ways give
the same rates.

Defined results: null classes are classes of their own, apart from empty names; null and empty texts weigh one token;
rows that share id and text share one decision; targets are scaled to one over the classes that the table has, and a
class that given targets do not name is not kept; an empty table gives an empty result; other columns, whatever their
names, are kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import pack, unpack
from .joins import join_groups
from .scratch import discard, written

TEMPER, BUDGET = 0.7, 0.5
MARGINS = ("source", "lang", "topic")
TOPICS, TOPIC_DIMS, FREQUENT = 12, 4096, 0.1
POWERS, MOVES, SCALE = 3, 3, 2.0**24
DRIVER_CELLS = 100_000
ROUNDS, CLOSE = 100, 1e-6
MOST = 1e9  # of a factor, far above the 1 at which a cell is kept whole


class TopicWords(dict):
    """Word to hashed dimension; words of fewer than four letters share the last place, which is not used."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = d = xxhash.xxh3_64_intdigest(word) % TOPIC_DIMS if len(word) > 3 and word.isalpha() else TOPIC_DIMS
        return d


def word_counts(text: str | None, dims: TopicWords) -> tuple[int, np.ndarray]:
    """Words between ASCII white space, and how many fall on each dimension."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return len(words), np.bincount(np.fromiter(map(dims.__getitem__, words), np.int64, len(words)), minlength=TOPIC_DIMS + 1)[:TOPIC_DIMS]


class Texts:
    """Texts as rows of unit length (or zero): damped counts of dimensions times rarity, one after another."""

    def __init__(self, dims: list[bytes], counts: list[bytes], idf: np.ndarray):
        sizes = np.array([len(d) // 2 for d in dims], np.int64)
        self.rows, self.row, self.dim = len(dims), np.repeat(np.arange(len(dims)), sizes), np.frombuffer(b"".join(dims), "<u2").astype(np.int64)
        x = np.log1p(np.frombuffer(b"".join(counts), "<u4")) * idf[self.dim]
        norm = np.sqrt(np.bincount(self.row, x * x, self.rows))
        self.some = norm > 0  # words that tell topics apart
        self.x = np.divide(x, norm[self.row], out=np.zeros_like(x), where=x > 0)

    def dot(self, of: np.ndarray) -> np.ndarray:
        """The inner product of each row with a vector that ``of`` gives by entry."""
        return np.bincount(self.row, self.x * of, self.rows)

    def nearest(self, centres: np.ndarray) -> np.ndarray:
        return np.stack([self.dot(c[self.dim]) for c in centres]).argmax(0) if len(centres) else np.zeros(self.rows, np.int64)

    def names(self, centres: np.ndarray) -> list[str]:
        return [f"t{k:02d}" if some and len(centres) else "none" for k, some in zip(self.nearest(centres).tolist(), self.some.tolist())]


def batch_counts(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each text: tokens (words, at least one), its dimensions and their counts, as ``word_counts`` gives them."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, n = words.flatten(), len(words)
    row = np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))
    size = pc.binary_length(flat).to_numpy()
    tokens = np.maximum(np.bincount(row[size > 0], minlength=n), 1)
    used = pc.ascii_is_alpha(flat).to_numpy(zero_copy_only=False) & (size > 3)
    coded = flat.filter(pa.array(used)).dictionary_encode()
    # Letters only, so one join and split makes Python's words of all distinct ones
    distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py().encode().split()
    dim = (np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)) % np.uint64(TOPIC_DIMS)).astype(np.int64)
    counts = np.bincount(row[used] * TOPIC_DIMS + dim[coded.indices.to_numpy()], minlength=n * TOPIC_DIMS)
    held = np.flatnonzero(counts)
    cut = np.searchsorted(held, np.arange(n + 1) * TOPIC_DIMS).tolist()
    at, of = (held % TOPIC_DIMS).astype("<u2").tobytes(), counts[held].astype("<u4").tobytes()
    pieces = list(zip(cut, cut[1:]))
    return pa.array(tokens, pa.int64()), pa.array([at[2 * i : 2 * j] for i, j in pieces], pa.binary()), pa.array([of[4 * i : 4 * j] for i, j in pieces], pa.binary())


def _counted(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, tuple[pa.Array, pa.Array, pa.Array]]]:
    """Pieces of the batches with the ``batch_counts`` of their texts."""
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            yield part, batch_counts(part.column(part.schema.get_field_index(text)))


def featured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with tokens (words, at least one), a hash of the text, and its dimensions with their counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, counted in _counted(batches, text):
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in (*keep, "_hash")), *counted], [*keep, "hash", "tokens", "dims", "counts"])

    kinds = dict(docs.dtypes)
    read = docs.select(*dict.fromkeys([*keep, text]), F.when(F.length(text) > 0, F.xxhash64(text)).alias("_hash"))
    return read.mapInArrow(add, "".join(f"{c} {kinds[c]}, " for c in keep) + "hash bigint, tokens bigint, dims binary, counts binary")


def _summed(texts: DataFrame, n: int, each: Callable) -> np.ndarray:
    """(n, TOPIC_DIMS + 1) sums over all texts; ``each`` makes those of a batch from its dims and counts. Whole numbers, so the order is nothing."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, TOPIC_DIMS + 1), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                total += each(part.column("dims").to_pylist(), part.column("counts").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([pack(t) for t in total], pa.binary())], ["row", "sums"])

    def join(t: pa.Table) -> pa.Table:
        total = np.zeros(TOPIC_DIMS + 1, np.int64)
        for x in t["sums"].to_pylist():
            total += unpack(x)[0]
        return pa.table({"row": t["row"].slice(0, 1), "sums": pa.array([pack(total)], pa.binary())})

    got = texts.select("dims", "counts").mapInArrow(add, "row bigint, sums binary").groupBy("row").applyInArrow(join, "row bigint, sums binary").collect()
    out = np.zeros((n, TOPIC_DIMS + 1))
    for r in got:
        out[r.row] = unpack(r.sums)[0]
    return out


def _batch_sums(t: Texts, label: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    """Rows by label, times ``weight``, in units of 1 / SCALE; the last column counts them."""
    out = np.zeros((n, TOPIC_DIMS + 1), np.int64)
    x = t.x if weight is None else t.x * weight[t.row]
    out[:, :TOPIC_DIMS] = np.bincount(label[t.row] * TOPIC_DIMS + t.dim, np.rint(x * SCALE), n * TOPIC_DIMS).reshape(n, TOPIC_DIMS).astype(np.int64)
    out[:, TOPIC_DIMS] = np.bincount(label[t.some], minlength=n)
    return out


def _units(sums: np.ndarray) -> np.ndarray:
    c = sums[:, :TOPIC_DIMS]
    return c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)


def fit_texts(texts: DataFrame, topics: int = TOPICS) -> tuple[np.ndarray, np.ndarray]:
    """Rarity weights and centres of all distinct texts of a ``featured`` table.

    Beginning with one centre, the largest clusters are halved along their main direction (``POWERS`` rounds of its
    power iteration) and all centres moved (at most ``MOVES`` times) until there are ``topics``. Each step is a sum over all texts.
    """
    texts = written(texts.filter("hash is not null").select("hash", "dims", "counts").dropDuplicates(["hash"]), "mixing-texts")
    n = texts.count()

    def holds(dims: list[bytes], counts: list[bytes]) -> np.ndarray:
        return np.bincount(np.frombuffer(b"".join(dims), "<u2"), minlength=TOPIC_DIMS + 1).astype(np.int64)[None]

    held = _summed(texts, 1, holds)[0, :TOPIC_DIMS]
    idf = np.where((held > 1) & (held <= max(2, FREQUENT * n)), np.log((1 + n) / (1 + held)), 0.0)

    def clusters(centres: np.ndarray) -> np.ndarray:
        def each(dims: list[bytes], counts: list[bytes]) -> np.ndarray:
            t = Texts(dims, counts, idf)
            return _batch_sums(t, t.nearest(centres), None, len(centres))

        return _summed(texts, len(centres), each)

    def along(centres: np.ndarray, ways: np.ndarray, middle: np.ndarray, halves: bool) -> np.ndarray:
        """Sums of each cluster's rows times how far along its way from its middle they are, or of those on either side."""

        def each(dims: list[bytes], counts: list[bytes]) -> np.ndarray:
            t = Texts(dims, counts, idf)
            label = t.nearest(centres)
            far = t.dot(ways[label[t.row], t.dim]) - middle[label]
            return _batch_sums(t, 2 * label + (far > 1e-9), None, 2 * len(centres)) if halves else _batch_sums(t, label, far, len(centres))

        return _summed(texts, len(centres) * (2 if halves else 1), each)

    centres = np.zeros((1, TOPIC_DIMS))
    sums = clusters(centres)
    centres = _units(sums)[sums[:, TOPIC_DIMS] > 0]
    while 0 < len(centres) < topics:
        size = sums[:, TOPIC_DIMS]
        chosen = [k for k in np.argsort(-size, kind="stable")[: topics - len(centres)].tolist() if size[k] > 1]
        mean = sums[:, :TOPIC_DIMS] / SCALE / np.maximum(size, 1)[:, None]
        ways = np.zeros_like(centres)
        ways[np.arange(len(centres)), mean.argmax(1)] = 1.0
        for _ in range(POWERS):
            ways = _units(along(centres, ways, (ways * mean).sum(1), False))
        sides = along(centres, ways, (ways * mean).sum(1), True)
        split = [k for k in chosen if sides[2 * k, TOPIC_DIMS] and sides[2 * k + 1, TOPIC_DIMS]]
        if not split:  # equal rows
            break
        ends = [sides[2 * k : 2 * k + 2] if k in split else sums[k : k + 1] for k in range(len(centres))]
        before, centres = len(centres), _units(np.concatenate(ends))
        for _ in range(MOVES):
            sums = clusters(centres)
            sums = sums[sums[:, TOPIC_DIMS] > 0]
            moved = _units(sums)
            if moved.shape == centres.shape and (moved == centres).all():
                break
            centres = moved
        if len(centres) <= before:
            break
    discard(texts)
    return idf, centres


def fit_topics(docs: DataFrame, text: str, topics: int = TOPICS) -> tuple[np.ndarray, np.ndarray]:
    """Rarity weights and centres of all distinct texts of ``docs``."""
    texts = written(featured(docs, text, []), "mixing-features")
    model = fit_texts(texts, topics)
    discard(texts)
    return model


def _topics_of(features: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with topic and tokens of the rows of a ``featured`` table."""
    idf, centres = model

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                names = Texts(part.column(part.schema.get_field_index("dims")).to_pylist(), part.column(part.schema.get_field_index("counts")).to_pylist(), idf).names(centres)
                columns = [*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(names, pa.string()), part.column(part.schema.get_field_index("tokens"))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "topic", "tokens"])

    kinds = dict(features.dtypes)
    return features.select(*keep, "tokens", "dims", "counts").mapInArrow(add, "".join(f"{c} {kinds[c]}, " for c in keep) + "topic string, tokens bigint")


def with_topics(docs: DataFrame, text: str, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with topic and tokens (words, at least one) of every whole text."""
    idf, centres = model

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (tokens, dims, counts) in _counted(batches, text):
            names = Texts(dims.to_pylist(), counts.to_pylist(), idf).names(centres)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(names, pa.string()), tokens], [*keep, "topic", "tokens"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(add, "".join(f"{c} {kinds[c]}, " for c in keep) + "topic string, tokens bigint")


def _class(m: str) -> Column:
    """A class as a text that is never null."""
    return F.when(F.col(m).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(m)))


def rake(tokens: np.ndarray, at: list[np.ndarray], wanted: list[np.ndarray], rate: float, rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Keep rates of cells: products of one factor for each class ``at``, at most 1, that keep the ``wanted`` tokens of every class.

    ``rate``: the rate of all cells to begin with.
    """
    factor = np.full(len(tokens), rate)
    for _ in range(rounds):
        worst = 0.0
        for k, goal in zip(at, wanted):
            have = np.bincount(k, tokens * np.minimum(factor, 1), len(goal))
            worst = max(worst, float(np.abs(have - goal).max()))
            factor = np.minimum(factor * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[k], MOST)
        if worst < close * tokens.sum():
            break
    return np.minimum(factor, 1)


def goals_of(cells: DataFrame, targets: dict[str, dict[str, float]], power: float) -> dict[str, DataFrame]:
    """By marginal: _class, tokens, share (the target) and size (cells) of every class.

    Without given targets, sources and languages get their token shares to ``power``, and topics, most of which keep
    to one language, the share of their languages' targets that falls on them by their shares within those to ``power``.
    """
    raised = F.pow(F.col("tokens").cast("double"), power)
    out: dict[str, DataFrame] = {}
    for m in MARGINS:
        have = cells.groupBy(f"_{m}").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("size"))
        if m in targets:
            rows = [(f"={k}" if k is not None else "null", float(v)) for k, v in targets[m].items()] or [("null", 0.0)]
            given = cells.sparkSession.createDataFrame(rows, f"_{m} string, raw double")
            have = have.join(F.broadcast(given), f"_{m}", "left")  # as many as the caller wrote down
        elif m == "topic":
            within = cells.groupBy("_lang", "_topic").agg(F.sum("tokens").alias("tokens")).withColumn("part", raised / F.sum(raised).over(Window.partitionBy("_lang")))
            each = within.join(out["lang"].select("_lang", "share"), "_lang").groupBy("_topic").agg(F.sum(F.col("part") * F.col("share")).alias("raw"))
            have = have.join(each, "_topic")
        else:
            have = have.withColumn("raw", raised)
        have = have.withColumn("raw", F.coalesce("raw", F.lit(0.0)))
        total = have.agg(F.sum("raw").alias("all"))  # one row
        share = F.coalesce(F.col("raw") / F.col("all"), F.lit(0.0)).alias("share")
        out[m] = written(have.crossJoin(F.broadcast(total)).select(f"_{m}", "tokens", "size", share), "mixing-goals")
    return out


def rake_table(cells: DataFrame, wanted: dict[str, DataFrame], rate: float, n_cells: int, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """``cells`` with keep_rate by ``rake`` as joins and aggregates: factors stay in a table, only the largest error reaches the driver."""
    total = cells.agg(F.sum("tokens")).first()[0]
    kept = F.col("tokens") * F.least("factor", F.lit(1.0))
    now = written(cells.withColumn("factor", F.lit(rate)), "mixing-factors")
    for _ in range(rounds):
        worst = 0.0
        for m, goal in wanted.items():
            have = now.groupBy(f"_{m}").agg(F.sum(kept).alias("have"))
            by = have.join(goal, f"_{m}").select(f"_{m}", goal["size"].alias("cells"), F.abs(F.col("have") - F.col("goal")).alias("off"), F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("by"))
            by = written(by, "mixing-by")
            worst = max(worst, by.agg(F.max("off")).first()[0])
            before, now = now, join_groups(now, by, f"_{m}", "cells", n_cells)
            now = written(now.withColumn("factor", F.least(F.col("factor") * F.col("by"), F.lit(MOST))).select(*before.columns), "mixing-factors")
            discard(before)
            discard(by)
        if worst < close * total:
            break
    return now.withColumn("keep_rate", F.least("factor", F.lit(1.0))).drop("factor")


def wanted_tokens(goals: DataFrame, m: str, keep: float) -> DataFrame:
    """_class, goal, size: ``keep`` tokens by share, but of no class more than it has; what lacks goes to the others."""
    scale, capped = keep, -1
    while True:
        whole = F.col("share") * scale >= F.col("tokens")
        n, full, left = goals.agg(F.count_if(whole), F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("share")))).first()
        if n == capped or not left:  # the classes that are kept whole are settled
            break
        capped, scale = n, max(scale, (keep - float(full or 0)) / left)
    return goals.select(f"_{m}", F.least(F.col("share") * scale, F.col("tokens").cast("double")).alias("goal"), "size")


def calibrate(counted: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = TEMPER, budget: float = BUDGET, driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """_source, _lang, _topic, tokens, keep_rate, weight (share of what is kept) and size (rows) of every cell.

    ``counted``: source, lang, topic, tokens, and rows where its rows stand for several. ``targets``: shares by marginal and class; unset, shares to ``power``.
    ``budget``: the share of all tokens to keep.
    """
    cells = counted.groupBy(*(_class(m).alias(f"_{m}") for m in MARGINS)).agg(F.sum("tokens").alias("tokens"), (F.sum("rows") if "rows" in counted.columns else F.count("*")).alias("size"))
    cells = written(cells, "mixing-cells")
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    goals, keep = goals_of(cells, targets or {}, power), budget * (total or 0)
    wanted = {m: written(wanted_tokens(g, m, keep), "mixing-wanted") for m, g in goals.items()}
    if n > driver_cells:
        raked = rake_table(cells, wanted, budget, n, rounds)
    else:
        table = cells.orderBy(*(f"_{m}" for m in MARGINS)).toArrow()  # n was checked
        at, tokens = [], []
        for m in MARGINS:
            goal = wanted[m].toArrow()
            goal = dict(zip(goal[f"_{m}"].to_pylist(), goal["goal"].to_pylist()))
            names, place = np.unique(np.array(table[f"_{m}"].to_pylist(), object), return_inverse=True)
            at.append(place), tokens.append(np.array([goal[k] for k in names]))
        rates = rake(table["tokens"].to_numpy().astype(float), at, tokens, budget, rounds) if n else np.empty(0)
        raked = cells.sparkSession.createDataFrame(table.append_column("keep_rate", pa.array(rates, pa.float64())))
    return written(raked.withColumn("weight", F.col("tokens") * F.col("keep_rate") / keep), "mixing-rates")


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on id and text only."""
    return F.pmod(F.xxhash64(doc_id, F.length(text), text, F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _rated(counted: DataFrame, targets: dict | None, power: float, cells: DataFrame | None = None) -> DataFrame:
    """``counted`` with weight and keep_rate of each row's cell."""
    cells = calibrate(counted, targets, power) if cells is None else cells
    keyed = counted.withColumn("_cell", F.struct(*(_class(m).alias(f"_{m}") for m in MARGINS)))
    held = cells.select(F.struct(*(f"_{m}" for m in MARGINS)).alias("_cell"), F.col("size").alias("_size"), "weight", "keep_rate")
    if cells.count() <= DRIVER_CELLS:  # a checked number of short rows
        return keyed.join(F.broadcast(held), "_cell").drop("_cell", "_size")
    return join_groups(keyed, held, "_cell", "_size", counted.count()).drop("_cell", "_size")


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: dict | None = None, seed: int = 17, power: float = TEMPER) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight of its cell, keep_rate and kept for every row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"), body.alias("text"), _draw(F.col(doc_id), body, seed).alias("draw"))
    kept = ["doc_id", "source", "lang", "draw"]
    texts = written(featured(rows, "text", kept), "mixing-features")
    counted = written(_topics_of(texts, fit_texts(texts), kept), "mixing")
    discard(texts)
    out = _rated(counted, targets, power)
    return out.select("doc_id", "source", "lang", "topic", "tokens", "weight", "keep_rate", (F.col("draw") < F.col("keep_rate")).alias("kept"))


def marginals(mixed_rows: DataFrame, targets: dict | None = None, power: float = TEMPER) -> DataFrame:
    """By margin and class of a ``mixture``: share of all tokens, target, expected and drawn share of what is kept."""
    cells = mixed_rows.groupBy(*(_class(m).alias(f"_{m}") for m in MARGINS)).agg(
        F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("keep_rate")).alias("expected"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("drawn")
    )
    cells = written(cells, "mixing-reached")
    goals, everything, out = goals_of(cells, targets or {}, power), Window.partitionBy(), None  # one row a class
    for m in MARGINS:
        per = cells.groupBy(f"_{m}").agg(*(F.sum(c).alias(c) for c in ("tokens", "expected", "drawn"))).join(goals[m].select(f"_{m}", F.col("share").alias("target")), f"_{m}")
        one = per.select(F.lit(m).alias("margin"), F.col(f"_{m}").alias("name"), (F.col("tokens") / F.sum("tokens").over(everything)).alias("share"), "target", *((F.col(c) / F.sum(c).over(everything)).alias(c) for c in ("expected", "drawn")))
        out = one if out is None else out.unionByName(one)
    return out


def mixed(docs: DataFrame, targets: dict | None = None, seed: int = 17, power: float = TEMPER) -> DataFrame:
    """The rows of ``docs`` that the calibrated probabilities keep, with all their columns."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    body = F.coalesce(at["text"], F.lit(""))
    rows = plain.withColumns({"source": at["source"], "lang": at["lang"], "text": body, "draw": _draw(at["doc_id"], body, seed)})
    kept = [*(f"c{i}" for i in range(len(names))), "source", "lang", "draw"]
    texts = written(featured(rows, "text", ["source", "lang"]), "mixing-features")
    model = fit_texts(texts)
    counted = _topics_of(texts, model, ["source", "lang"]).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    cells = calibrate(written(counted, "mixing"), targets, power)
    discard(texts)
    topics = with_topics(rows, "text", model, kept)
    # Texts are read again rather than shuffled or stored
    out = _rated(topics, targets, power, cells).filter(F.col("draw") < F.col("keep_rate"))
    return out.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)

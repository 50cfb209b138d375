"""Personal data with a skip-chain conditional random field over the candidates of each document.

Base spans come from fixed patterns. Nodes of the field are the base spans and all other chunks of a text that
hold a digit or an at sign (every other chunk has the label "none" by its shape). Neighbouring nodes are linked
in a chain; nodes with the same digits, the same last digits, the same four short numbers or the same name before
an at sign are linked by skip edges: each repeat to the first base span of every kind among them, or, where none is
a base span, to the one before it. Loopy message passing over whole documents gives label marginals; a chunk whose
marginal for a kind exceeds one half is added as a span of that kind. Base spans always stay: they send their label
and take no messages.

Potentials are trained piecewise on all documents: shape against label for nodes, label against label for the
chain, agreement of repeated surfaces for skip edges.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; rows that repeat
give equal results each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .scratch import written

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0 is none
DAMPING, CLOSE, MOST_ROUNDS = 0.3, 1e-6, 500  # messages pass until they are this close
UNARY_LIMIT, CHAIN_LIMIT, SKIP_LIMIT, EVIDENCE = 3.0, 1.0, 4.0, 8.0

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match ends with its run of digits, so none can begin inside one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CHUNK = re.compile(r"[0-9@]\S*")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HAS = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, kind from 1, leftmost and without overlap in each kind."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((1, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _HAS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((2, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((3, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((4, *m.span()))
    return out


def _shape(chunk: str, digits: str) -> int:
    """A number below 4096 for the look of a chunk."""
    size = int(np.searchsorted((1, 4, 6, 8, 11, 16, 20), len(digits), side="right"))  # 0 to 7
    sure = 13 <= len(digits) <= 19 and luhn(digits)
    letters = any(c.isalpha() for c in chunk)
    return size | ("@" in chunk) << 3 | min(chunk.count("."), 3) << 4 | chunk.startswith("+") << 6 | sure << 7 | letters << 8 | ("-" in chunk) << 9 | ("(" in chunk) << 10 | (" " in chunk) << 11


def _keys(chunk: str, digits: str) -> tuple[int, int]:
    """Hashes that link a node with equal and with similar ones; 0 for none."""
    name = chunk.partition("@")[0].strip("<>()[]{}.,;:!?\"'#*%&$").lower() if "@" in chunk else ""
    if name:
        return xxhash.xxh3_64_intdigest("@" + name), 0
    if len(digits) >= 7:
        return xxhash.xxh3_64_intdigest(digits), xxhash.xxh3_64_intdigest("~" + digits[-8:]) if len(digits) >= 9 else 0
    parts = _NOT_DIGIT.sub(".", chunk).strip(".").split(".")
    if len(parts) == 4 and all(int(p) <= 255 for p in parts):  # an address of few digits
        return xxhash.xxh3_64_intdigest("." + ".".join(parts)), 0
    return 0, 0


_STRIP = "<>()[]{}.,;:!?\"'#*%&$|=/\\"


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, label, shape, key, similar key) of a text's nodes in order."""
    found = [(s, e, k) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    ends = list(np.maximum.accumulate([e for _, e in taken])) if taken else []
    for m in _CHUNK.finditer(text):
        s, e = m.span()
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        while s < e and text[s] in _STRIP:
            s += 1
        while e > s and text[e - 1] in _STRIP:
            e -= 1
        i = int(np.searchsorted(starts, e)) if starts else 0  # base spans that begin before the chunk's end
        if s < e and not (i and ends[i - 1] > s) and _HAS.search(text, s, e):
            found.append((s, e, 0))
    out = []
    for s, e, label in sorted(found):
        chunk = text[s:e]
        digits = _NOT_DIGIT.sub("", chunk)
        out.append((s, e, label, _shape(chunk, digits), *_keys(chunk, digits)))
    return out


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and nodes (packed) of every text of ``docs`` (doc_id, text)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part, base, kept = b.slice(i, 512), [], []
                for text in part.column("text").to_pylist():
                    if not text or not _HAS.search(text):
                        base.append(None), kept.append(None)
                        continue
                    spans = base_spans(text)
                    base.append(np.array(spans, "<i4").reshape(-1, 3).tobytes())
                    n = nodes(text, spans)
                    kept.append(pack(np.array([x[:4] for x in n], "<i4").reshape(-1), np.array([x[4:] for x in n], np.uint64).reshape(-1)) if n else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "base", "nodes"])

    return docs.mapInArrow(extract, "doc_id bigint, base binary, nodes binary")


class Graph:
    """The union of some documents' fields."""

    def __init__(self, packed: list[bytes | None]):
        parts = [unpack(p) if p is not None else None for p in packed]
        sizes = [0 if p is None else len(p[0]) // 4 for p in parts]
        got = [p for p in parts if p is not None]
        self.doc = np.repeat(np.arange(len(parts)), sizes)
        table = np.concatenate([p[0] for p in got]).reshape(-1, 4) if got else np.empty((0, 4), np.int32)
        keys = np.concatenate([p[1] for p in got]).reshape(-1, 2) if got else np.empty((0, 2), np.uint64)
        self.start, self.end, self.label, self.shape = table.T.astype(np.int64)
        same = self.doc[1:] == self.doc[:-1]
        at = np.flatnonzero(same)
        self.chain = np.stack([at, at + 1], 1)
        self.skip = np.unique(np.concatenate([self._links(keys[:, 0]), self._links(keys[:, 1])]), axis=0)
        self.equal = self._repeats(keys[:, 0])

    def _repeats(self, key: np.ndarray) -> np.ndarray:
        """Each node with a key and the one before it in its document with the same."""
        at = np.flatnonzero(key)
        order = at[np.lexsort((at, key[at], self.doc[at]))]
        near = (key[order][1:] == key[order][:-1]) & (self.doc[order][1:] == self.doc[order][:-1])
        return np.stack([order[:-1][near], order[1:][near]], 1) if len(order) else np.empty((0, 2), np.int64)

    def _links(self, key: np.ndarray) -> np.ndarray:
        """Each node with a key that is no base span, and the first base span of each kind in its document with the same; without any, the node before it."""
        at = np.flatnonzero(key)
        order = at[np.lexsort((at, key[at], self.doc[at]))]
        if not len(order):
            return np.empty((0, 2), np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (self.doc[order][1:] != self.doc[order][:-1])
        group, label = np.cumsum(new) - 1, self.label[order]
        based = np.bincount(group, label > 0) > 0
        out = []
        for kind in range(1, LABELS):
            of, first = np.unique(group[label == kind], return_index=True)
            base = np.full(len(based), -1)
            base[of] = order[label == kind][first]
            repeat = (label == 0) & (base[group] >= 0)
            out.append(np.stack([base[group[repeat]], order[repeat]], 1))
        near = ~new[1:] & ~based[group[1:]]
        out.append(np.stack([order[:-1][near], order[1:][near]], 1))
        return np.concatenate(out)


_CHAIN_AT, _SKIP_AT = 4096 * LABELS, 4096 * LABELS + LABELS * LABELS


def trained(fields: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log potentials: shape x label, chain label x label, skip label x label, from counts over all documents."""
    size = _SKIP_AT + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            g = Graph(b.column("nodes").to_pylist())
            total += np.bincount(g.shape * LABELS + g.label, minlength=size)
            total += np.bincount(_CHAIN_AT + g.label[g.chain[:, 0]] * LABELS + g.label[g.chain[:, 1]], minlength=size)
            total += np.bincount(_SKIP_AT + (g.label[g.equal[:, 0]] == g.label[g.equal[:, 1]]).astype(np.int64), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = fields.select("nodes").filter("nodes is not null").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size)
    total[got["at"].to_numpy()] = got["n"].to_numpy()
    return potentials(total)


def potentials(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by_shape = total[:_CHAIN_AT].reshape(-1, LABELS) + 0.1
    unary = np.log(by_shape / by_shape.sum(1, keepdims=True))
    unary = np.clip(unary - unary.max(1, keepdims=True), -UNARY_LIMIT, 0)
    pair = total[_CHAIN_AT:_SKIP_AT].reshape(LABELS, LABELS) + 1.0
    pair /= pair.sum()
    chain = np.clip(np.log(pair / np.outer(pair.sum(1), pair.sum(0))), -CHAIN_LIMIT, CHAIN_LIMIT)
    differ, agree = total[_SKIP_AT:] + 1.0
    weight = float(np.clip(np.log(agree / differ), 1.0, SKIP_LIMIT))
    return unary, chain, weight * np.eye(LABELS)


def marginals(g: Graph, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Loopy sum-product over all edges at once; base spans carry their label as evidence."""
    local = unary[g.shape].copy()
    known = g.label > 0
    local[known] = 0
    local[known, g.label[known]] = EVIDENCE
    a = np.concatenate([g.chain[:, 0], g.skip[:, 0], g.chain[:, 1], g.skip[:, 1]])
    b = np.concatenate([g.chain[:, 1], g.skip[:, 1], g.chain[:, 0], g.skip[:, 0]])
    n = len(g.chain) + len(g.skip)
    if n:
        table = np.concatenate([np.broadcast_to(chain, (len(g.chain), LABELS, LABELS)), np.broadcast_to(skip, (len(g.skip), LABELS, LABELS))])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        message = np.zeros((2 * n, LABELS))
        fixed = known[a]
        for _ in range(MOST_ROUNDS):
            belief = local.copy()
            np.add.at(belief, b, message)
            rest = np.where(fixed[:, None], local[a], belief[a] - message[back])
            rest = rest[:, :, None] + table
            top = rest.max(1, keepdims=True)
            new = np.log(np.exp(rest - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            before, message = message, DAMPING * message + (1 - DAMPING) * new
            if np.abs(message - before).max() < CLOSE:
                break
        np.add.at(local, b, np.where(known[b][:, None], 0.0, message))
    local = np.exp(local - local.max(1, keepdims=True)) if len(local) else local
    return local / local.sum(1, keepdims=True) if len(local) else local


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{s}:{e}" for k, s, e in sorted(spans))


_OUT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def labelled(fields: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                g = Graph(part.column("nodes").to_pylist())
                p = marginals(g, *model)
                added: dict[int, list] = {}
                if len(p):
                    best = p[:, 1:].argmax(1) + 1
                    for j in np.flatnonzero((g.label == 0) & (p[np.arange(len(p)), best] > 0.5)):
                        added.setdefault(int(g.doc[j]), []).append((int(best[j]), int(g.start[j]), int(g.end[j])))
                out = []
                for k, (doc_id, raw) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("base").to_pylist())):
                    base = [tuple(x) for x in np.frombuffer(raw, "<i4").reshape(-1, 3).tolist()] if raw else []
                    more = added.get(k, [])
                    n = [sum(x[0] == kind for x in base) for kind in range(1, LABELS)]
                    out.append((doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
                kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
                names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return fields.mapInArrow(label, _OUT)


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of personal data in every whole text of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    fields = written(extracted(rows), "pii")
    return labelled(fields, trained(fields))

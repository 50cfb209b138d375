"""Plain versions of what the operators compute, and small awkward tables."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    base = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen. " * 2
    near = base + "and one more"
    long = " ".join(f"w{i % 700}x{i % 13}" for i in range(40_000))
    texts = [(1, base), (2, base.upper()), (3, near), (4, None), (5, ""), (6, " \t\n"), (7, "a b"), (8, "A B"), (9, "a b c"), (10, long), (11, long + " tail"), (12, "x" * 100_000), (None, base), (None, None), (None, "lonely text with no id at all here"), (13, "Ä ä İ 😀 card 4111 1111 1111 1111 mail a.b@c.de"), (14, "<|im_start|>system"), (7, "a b"), (7, "a b")]
    rows = [(i, t, [None, "en", "de"][k % 3], [None, "s1", "s1", "s2"][k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])


def near_classes(rows):
    """By row: the smallest id that links of similarity 0.75 reach."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    has = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            has[g].append(i)
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for j in has[g]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return [least.get(find(i)) for i in range(len(rows))]

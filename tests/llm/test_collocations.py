"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cueloom.llm import collocations


def _want(rows, words=4, least=30, top=2000, covered=80):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, words + 1):
                for i in range(len(w) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(100 * b >= covered * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["alpha", "beta", "Gamma", "delta", "é", "日本", "x" * 40, "a\x00b", "\x0f", "İ", "New", "York"]
    out = []
    for i in range(160):
        told = []
        for _ in range(rng.randrange(0, 60)):
            told += rng.choice([["New", "York"], ["Gamma", "delta", "é", "beta"], [rng.choice(words)], [rng.choice(words)]])
            told.append(rng.choice(["", "", "", ".", ",", "\n", "\r\n", " \t "]))
        out.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([" ", "  "]).join(told)))
    return out + [("en", None), ("en", ""), (None, " . "), ("fr", "same words here again " * 3_000), ("en", "new york")] + [("en", "copy of one text . ok")] * 50


@pytest.mark.parametrize(("bucket", "chunk", "top"), [(8 << 20, 4 << 20, 2000), (4_000, 900, 5)])
def test_phrases(spark, rows, bucket, chunk, top):
    df = spark.createDataFrame([(i, t, g, "x", "y", 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, bucket string, f int").repartition(4)
    got = collocations.collocations(df, bucket_bytes=bucket, chunk=chunk, top=top).collect()
    assert sorted(tuple(r) for r in got) == _want(rows, top=top)


def test_no_phrases(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "en")], none.schema)).count() == 0


def test_quicksort_counts():
    rng = np.random.default_rng(4)
    for n in (0, 1, 500):
        ids = rng.zipf(1.5, (n, 4)).astype(np.int32) % 9
        for i, stop in enumerate(rng.integers(1, 5, n)):
            ids[i, stop:] = -1
        weights = rng.integers(1, 4, n).astype(np.float64)
        want = Counter()
        for row, w in zip(ids.tolist(), weights, strict=True):
            for m in range(1, 5):
                if row[m - 1] >= 0:
                    want[tuple(row[:m])] += int(w)
        got = {tuple(ids[p, :m].tolist()): int(c) for m, at, counts in collocations.sorted_counts(ids, weights, 6) for p, c in zip(at, counts, strict=True)}
        assert got == {p: c for p, c in want.items() if c >= 6}

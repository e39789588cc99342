"""Collocations: phrases whose words come together more often than their parts, by sorting suffixes of word pieces.

A suffix is the run of up to ``WORDS`` words that begins at a word and ends with its piece. Tasks combine the equal
suffixes of a stretch of text and route them by their leading words to buckets; leading words that would fill a bucket
alone are split by one word more. In a bucket, suffix pointers are sorted by multikey three-way quicksort down to the
last word: the size of an equal partition is the count of the phrase that it shares, and partitions too small for any
phrase are abandoned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm import tokens
from cueloom.llm.common import known, staged

WORDS = 4
LEAST = 30
TOP = 2000
#: Text whose suffixes make a bucket, and text that is sorted at once where they are made.
BUCKET_BYTES = 8 << 20
CHUNK = 1 << 20
#: Suffixes per bucket that are looked at to find leading words which fill a bucket; they only decide the routes.
SAMPLE = 400
_U = np.uint64

ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
KEPT = ~ENDS
KEPT[[0x20, 0x09]] = False


class Suffixes:
    """The words of a run of texts: exact ids, hashes, and how many words each one's suffix has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, most: int) -> None:
        low = tokens.LOWER[data]
        self.hashes, rows, begins, ends = tokens.words(low, offsets, KEPT)
        n = self.n = len(begins)
        # Words of one piece are of one text, with no end of a piece between them.
        piece = np.cumsum(ENDS[low])[begins] + rows if n else np.zeros(0, np.int64)
        last = np.searchsorted(piece, piece, "right")
        self.length = np.minimum(last - np.arange(n), most)
        long = ends - begins
        self.at = np.concatenate([[0], np.cumsum(long + 1)])
        # All words one after the other, each with a blank behind it.
        self.text = np.full(self.at[-1], 0x20, np.uint8)
        inside = np.ones(len(self.text), bool)
        inside[self.at[1:] - 1] = False
        packed = low[KEPT[low]]
        self.text[inside] = packed
        edges = np.concatenate([[0], np.cumsum(long)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(packed)])
        self.ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.heads = [self.hashes]
        for k in range(1, most):
            own = self.heads[-1].copy()
            on = max(0, n - k)
            own[:on] = tokens.mix(own[:on] * _U(0x9E3779B97F4A7C15) + self.hashes[n - on :])
            self.heads.append(own)

    def combined(self, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, words, times) of the different runs of ``words`` words that begin at ``first``, sorted by their words."""
        base = int(self.ids.max(initial=0)) + 2
        keys, k = [], 0
        while k < words.max(initial=0):
            key = np.zeros(len(first), np.int64)
            step = 1
            while k < words.max() and step * base < 1 << 62:
                key = key * base + np.where(words > k, self.ids[np.minimum(first + k, self.n - 1)] + 1, 0)
                step, k = step * base, k + 1
            keys.append(key)
        if not keys:
            return first, words, np.zeros(0, np.int64)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in keys:
            sorted_ = key[order]
            new[1:] |= sorted_[1:] != sorted_[:-1]
        begin = np.flatnonzero(new)
        return first[order[begin]], words[order[begin]], np.diff(np.append(begin, len(order)))

    def lines(self, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs as text lines, and where each begins."""
        low, high = self.at[first], self.at[first + words]
        long = high - low
        upto = np.cumsum(long)
        total = int(upto[-1]) if len(upto) else 0
        out = self.text[np.repeat(low - upto + long, long) + np.arange(total)]
        out[upto - 1] = 0x0A
        return out, np.concatenate([[0], upto])


def _routed(suffixes: Suffixes, hot: dict[int, np.ndarray], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(least words that are counted, begins, words) of what is routed: words, suffixes, and heads of split suffixes apart."""
    every = np.arange(suffixes.n)
    yield 1, every, np.ones(suffixes.n, np.int64)
    left = every[suffixes.length > 1]
    for depth in range(2, most + 1):
        split = np.isin(suffixes.heads[depth - 1][left], hot[depth]) if depth in hot and len(hot[depth]) else np.zeros(len(left), bool)
        yield depth, left[~split], suffixes.length[left[~split]]
        if not split.any():
            return
        yield depth, left[split], np.full(int(split.sum()), depth)
        left = left[split]
        left = left[suffixes.length[left] > depth]


def _texts(batches, size: int):
    """(language, bytes, offsets) of runs of texts of one language."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            column = batch.column(1).take(pa.array(np.flatnonzero(langs.indices.to_numpy(zero_copy_only=False) == k)))
            for _, data, offsets in tokens.text_chunks(column, size):
                yield lang, data, offsets


def _salt(lang: str) -> np.uint64:
    return tokens.mix(np.array([sum(b << 8 * (i % 7) for i, b in enumerate(lang.encode())) + 1], _U))[0]


def _route(buckets: int, hot: dict[int, np.ndarray], most: int, chunk: int):
    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for lang, data, offsets in _texts(batches, chunk):
            suffixes = Suffixes(data, offsets, most)
            rows = []
            for depth, first, words in _routed(suffixes, hot, most):
                first, words, times = suffixes.combined(first, words)
                to = ((suffixes.heads[depth - 1][first] ^ _salt(lang)) % _U(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                first, words, times, to = first[order], words[order], times[order].astype("<u4"), to[order]
                lines, at = suffixes.lines(first, words)
                edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
                rows += [(int(to[b]), lang, depth, press.compress(lines[at[b] : at[e]].tobytes()), press.compress(times[b:e].tobytes())) for b, e in zip(edges[:-1], edges[1:], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                    ["bucket", "lang", "depth", "lines", "times"])

    return run


def _heads(most: int, chunk: int):
    """Counts of the leading words of suffixes, per run of texts."""

    def run(batches):
        for lang, data, offsets in _texts(batches, chunk):
            suffixes = Suffixes(data, offsets, most)
            for depth in range(2, most):
                heads, times = np.unique(suffixes.heads[depth - 1][suffixes.length >= depth], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(heads), depth, np.int32)), pa.array(heads.view(np.int64)), pa.array(times.astype(np.int64))], ["depth", "head", "times"])

    return run


def sorted_counts(ids: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, a pointer each, counts) of the phrases that at least ``least`` suffixes begin with.

    Multikey three-way quicksort of pointers to the rows of ``ids`` (-1 behind a suffix' end). All live partitions are
    split in one round: each by the word that its middle pointer has at its depth into lower, equal and greater ones;
    only the equal one goes on to the next word.
    """
    n, most = ids.shape
    pointers = np.arange(n)[ids[:, 0] >= 0] if n else np.zeros(0, np.int64)
    starts, depths = np.array([0, len(pointers)]), np.zeros(1, np.int64)
    while len(pointers):
        long = np.diff(starts)
        part = np.repeat(np.arange(len(long)), long)
        words = ids[pointers, depths[part]]
        pivots = words[(starts[:-1] + starts[1:]) // 2]
        side = np.sign(words - pivots[part]) + 1
        label = part * 3 + side
        many = np.bincount(label, minlength=3 * len(long))
        begin = np.concatenate([[0], np.cumsum(many)])
        place = np.empty(len(pointers), np.int64)
        for s in range(3):
            own = side == s
            place[own] = begin[3 * part[own] + s] + (np.cumsum(own) - 1)[own] - np.concatenate([[0], np.cumsum(many[s::3])])[part[own]]
        moved = np.empty_like(pointers)
        moved[place] = pointers
        size = np.bincount(label, weights=weights[pointers], minlength=3 * len(long)).astype(np.int64)
        depth = np.repeat(depths, 3)
        equal = np.arange(3 * len(long)) % 3 == 1
        big = size >= least
        for d in np.unique(depth[equal & big]):
            told = np.flatnonzero(equal & big & (depth == d))
            yield int(d) + 1, moved[begin[told]], size[told]
        depth = depth + equal
        # Abandoned: partitions with too few suffixes, and suffixes that have come to their end.
        live = np.repeat(big & (depth < most), many)
        label = np.repeat(np.arange(3 * len(long)), many)[live]
        pointers = moved[live]
        on = ids[pointers, depth[label]] >= 0
        pointers, label = pointers[on], label[on]
        left, first = np.unique(label, return_index=True)
        starts, depths = np.append(first, len(pointers)), depth[left]


def _bucket_counts(lang: str, depth: int, blobs: list[tuple[bytes, bytes]], most: int, least: int) -> Iterator[pa.RecordBatch]:
    """Frequent phrases of at least ``depth`` words of a bucket; for single words also how many there are in all, as the phrase ''."""
    expand = zstandard.ZstdDecompressor()
    words, ends, weights = [], [], []
    for lines, times in blobs:
        data = np.frombuffer(expand.decompress(lines), np.uint8)
        weights.append(np.frombuffer(expand.decompress(times), "<u4"))
        blank = (data == 0x20) | (data == 0x0A)
        stops = np.flatnonzero(blank)
        edges = (stops - np.arange(len(stops))).astype(np.int64)
        words.append(pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(stops), [None, pa.py_buffer(np.concatenate([[0], edges]).astype(np.int64)), pa.py_buffer(data[~blank])]))
        ends.append(data[stops] == 0x0A)
    weights, ends = np.concatenate(weights).astype(np.float64), np.concatenate(ends)
    encoded = pa.chunked_array(words).dictionary_encode().combine_chunks()
    encoded = encoded.chunk(0) if isinstance(encoded, pa.ChunkedArray) else encoded
    flat, names = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    stop = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], stop[:-1]])
    ids = np.full((len(stop), most), -1, np.int32)
    for k in range(most):
        has = stop - start > k
        ids[has, k] = flat[start[has] + k]
    if depth == 1:
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([0], pa.int32()), pa.array([int(weights.sum())])], ["lang", "phrase", "words", "f"])
    for many, pointers, counts in sorted_counts(ids, weights, least):
        if many < depth:
            continue
        parts = [names.take(pa.array(ids[pointers, k])).to_pylist() for k in range(many)]
        phrases = [b" ".join(p).decode() for p in zip(*parts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(np.full(len(phrases), many, np.int32)), pa.array(counts)],
            ["lang", "phrase", "words", "f"])


def _count(most: int, least: int):
    """Rows sorted by (bucket, language, depth): one group after the other is counted and let go."""

    def run(batches):
        key, blobs = None, []
        for batch in batches:
            for bucket, lang, depth, lines, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, lang, depth) != key and blobs:
                    yield from _bucket_counts(key[1], key[2], blobs, most, least)
                    blobs = []
                key = bucket, lang, depth
                blobs.append((lines, times))
        if blobs:
            yield from _bucket_counts(key[1], key[2], blobs, most, least)

    return run


def phrase_counts(
    docs: DataFrame, lang: str = "lang", text: str = "text", words: int = WORDS, least: int = LEAST,
    bucket_bytes: int = BUCKET_BYTES, chunk: int = CHUNK,
) -> DataFrame:
    """Counts f of all phrases of up to ``words`` words with at least ``least`` occurrences: lang, phrase, words, f.

    The rows of no words (phrase '') hold numbers of word occurrences, to be summed up per language. Counts are exact:
    routes and buckets are by hash, words are compared themselves. Null texts are empty, null languages ``und``.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), known(text).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(n_bytes / bucket_bytes))
    hot: dict[int, np.ndarray] = {}
    if buckets > 1:
        share = min(1.0, SAMPLE * buckets * 6 / n_bytes * 4)
        seen = rows.sample(share, seed=11).mapInArrow(_heads(words, chunk), "depth int, head long, times long")
        seen = seen.groupBy("depth", "head").agg(F.sum("times").alias("times"))
        # As each holds a bucket's share of the suffixes, there are no more of them than buckets.
        seen = staged(seen, "heads")
        for depth, n in [tuple(r) for r in seen.groupBy("depth").agg(F.sum("times")).collect()]:
            found = seen.filter((F.col("depth") == depth) & (F.col("times") * buckets >= n)).select("head").collect()
            hot[depth] = np.array(sorted(r["head"] for r in found), np.int64).view(_U)
    parts = max(1, math.ceil(buckets / 4))
    routed = rows.mapInArrow(_route(buckets, hot, words, chunk), "bucket int, lang string, depth int, lines binary, times binary")
    dealt = routed.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang", "depth")
    return dealt.mapInArrow(_count(words, least), "lang string, phrase string, words int, f long")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", words: int = WORDS, least: int = LEAST, top: int = TOP,
    covered: int = 80, bucket_bytes: int = BUCKET_BYTES, chunk: int = CHUNK,
) -> DataFrame:
    """The best phrases of two to ``words`` words per language: lang, rank, phrase, a, l, r, n, score.

    Texts are lowered (A-Z), cut into pieces at punctuation and line ends, and pieces into words at blanks and tabs.
    ``a`` counts a phrase, ``l`` and ``r`` its parts at the cut with the least score, floor(2000000 a / (l + r)); ties
    of scores go to the smaller first part. A phrase inside a longer one that has ``covered`` hundredths of its
    occurrences is left out. The first ``top`` by score, a (both descending) and phrase are returned.

    Null texts are empty ones, null languages ``und``; equal texts and repeated rows count each time; a table without
    frequent phrases gives no rows. Other columns are not read. A text of any length is read as a whole; a stretch of
    equal suffixes, however large, is one row per stretch of text.
    """
    counts = staged(phrase_counts(docs, lang, text, words, least, bucket_bytes, chunk), "phrases")
    total = counts.filter("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    counts = counts.filter("words > 0")
    cut = counts.filter("words > 1").withColumn("w", F.split("phrase", " ")).select(
        "lang", "phrase", F.col("words"), F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    ).select(
        "lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("rest"))
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # Both products and sums may pass 64 bits.
    cut = staged(cut.withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(38, 0)) * a) div (CAST(l AS DECIMAL(38, 0)) + r)")), "cuts")
    # A longer phrase around this one has no more occurrences than that with one word more on either side.
    inside = cut.filter(f"words > 2 AND k = words - 1 AND CAST(100 AS DECIMAL(38, 0)) * a >= CAST({covered} AS DECIMAL(38, 0)) * l").select("lang", F.col("first").alias("phrase"))
    inside = inside.unionByName(cut.filter(f"words > 2 AND k = 1 AND CAST(100 AS DECIMAL(38, 0)) * a >= CAST({covered} AS DECIMAL(38, 0)) * r").select("lang", F.col("rest").alias("phrase")))
    best = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("at"))
    best = best.join(inside.distinct(), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).join(total, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")

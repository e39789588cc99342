"""Packing of documents into token sequences in the order of a space-filling curve."""

from __future__ import annotations

import math
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm import tokens
from cueloom.llm.common import known

LENGTH = 1024
DIMS, DEPTH = 4, 8
CELLS = 16  # bits of the curve's place by which ranges are cut
SAMPLE = 2000  # rows per range that are looked at to cut them
PART = 10_000  # pieces that are handed on at once
PARTITION_BYTES = 64 << 20  # large enough that most pieces of a task have been seen before
_U = np.uint64
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
# The code points of white space, and the contractions that are tokens of their own.
WHITE = frozenset([*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def hilbert(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Place of integer points (rows, each coordinate below 2**depth) along the Hilbert curve, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(column: pa.Array) -> np.ndarray:
    """Hilbert keys of texts: words vote +1 or -1 in each dimension by a bit of their hash; votes are scaled by length."""
    keys = np.zeros(len(column), np.int64)
    for row, data, offsets in tokens.text_chunks(column):
        n = len(offsets) - 1
        hashes, rows, _, _ = tokens.words(tokens.fold(data), offsets, tokens.LETTERS)
        many = np.maximum(np.bincount(rows, minlength=n), 1)
        votes = [np.bincount(rows, weights=((hashes >> _U(7 * d)) & _U(1)).astype(np.float64) * 2 - 1, minlength=n) / np.sqrt(many) for d in range(DIMS)]
        cells = (1 << DEPTH) / (1 + np.exp(-np.stack(votes, axis=1) * 0.8))
        keys[row : row + n] = hilbert(np.minimum(cells, (1 << DEPTH) - 1).astype(np.int64))
    return keys


def _keyed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve_keys(batch.column(1)))], ["doc_id", "text", "curve"])


def _class(c: str) -> int:
    return _SPACE if ord(c) in WHITE else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)


_UNSEEN = 255
KINDS = np.full(0x110000, _UNSEEN, np.uint8)
KINDS[:128] = [_class(chr(c)) for c in range(128)]


def _classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    kinds = KINDS[points]
    unseen = kinds == _UNSEEN
    if unseen.any():
        for c in np.unique(points[unseen]).tolist():
            KINDS[c] = _class(chr(c))
        kinds = KINDS[points]
    return kinds


def pretokens(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pieces that a byte-level tokenizer encodes one by one; ``edges`` are the starts of the texts.

    A piece is a run of letters, numbers or other signs, with a space before it if there is one; of white space before
    it, all but the last character is one piece. Contractions after a word are pieces as well.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes(points)
    first = np.zeros(n + 1, bool)
    first[edges[edges < n]] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    # White space followed by a run in the same text: its last character is apart, and joins the run if it is a space.
    ends = np.flatnonzero(run[1:] & (kind == _SPACE))
    ends = ends[~first[ends + 1]]
    start[ends] = True
    joins = ends[points[ends] == 0x20]
    start[joins + 1] = False
    quotes = np.flatnonzero(start & (points == 0x27))
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kind[quotes + 1] == _LETTER) & ~first[quotes + 1]]
    for q in quotes.tolist():
        for word in CONTRACTIONS:
            end = q + 1 + len(word)
            if end <= n and not first[q + 1 : end].any() and all(points[q + 1 + i] == ord(c) for i, c in enumerate(word)):
                start[q + 1] = False
                if end < n:
                    start[end] = True
                break
    return np.flatnonzero(start)


class Encoder:
    """Token ids of texts. The tokenizer sees each distinct piece once; the ids of up to ``most`` pieces are kept."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings that the tokenizer takes for one token wherever they stand, so that pieces don't tell a text's ids.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool, self.begin = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        for i in range(0, len(pieces), 5000):
            some = pieces[i : i + 5000]
            part = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)]
            n = len(self.place)
            ends = self.begin[n] + np.cumsum([len(ids) for ids in part])
            while ends[-1] > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while n + len(some) >= len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.pool[self.begin[n] : ends[-1]] = np.fromiter(chain.from_iterable(part), np.uint32)
            self.begin[n + 1 : n + 1 + len(some)] = ends
            self.place.update(zip(some, range(n, n + len(some)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts one after the other: their bytes, and where each begins and the last ends."""
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            texts = [raw[b:e].decode() for b, e in zip(offsets, offsets[1:], strict=False)]
            each = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(ids) for ids in each], np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        starts = heads[pretokens(points, np.searchsorted(heads, offsets[:-1]))]
        edges = np.append(starts, len(data))
        # Pieces are told apart by their bytes.
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        names, which = pieces.dictionary.to_pylist(), pieces.indices.to_numpy(zero_copy_only=False)
        new = [p for p in names if p not in self.place]
        if len(self.place) + len(new) > self.most:
            self._clear()
            new = names
        self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        low = self.begin[at]
        many = self.begin[at + 1] - low
        long = many[which]
        upto = np.cumsum(long)
        ids = self.pool[np.repeat(low[which] - upto + long, long) + np.arange(upto[-1])]
        until = np.concatenate([[0], upto])
        return ids, np.diff(until[np.searchsorted(starts, offsets)])


def _packer(path: str, length: int):
    def run(batches):
        encoder, place = Encoder(path), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            column = batch.column(1)
            for row, data, offsets in tokens.text_chunks(column):
                n = len(offsets) - 1
                ids, own = encoder.encode(data, offsets)
                # Every text ends in id 0.
                upto = np.cumsum(own + 1)
                stream = np.zeros(int(upto[-1]), np.uint32)
                keep = np.ones(len(stream), bool)
                keep[upto - 1] = False
                stream[keep] = ids
                doc_start = upto - own - 1
                breaks = np.arange(-(-place // length) * length - place, len(stream), length)
                starts = np.unique(np.concatenate([doc_start, breaks[breaks >= 0]]))
                ends = np.append(starts[1:], len(stream))
                doc = np.searchsorted(doc_start, starts, "right") - 1
                at = place + starts
                # Arrow's offsets of binary values count bytes, in 32 bits: long texts go out in parts.
                for low in range(0, len(starts), PART):
                    some = slice(low, low + PART)
                    head = starts[low]
                    pieces = pa.BinaryArray.from_buffers(
                        pa.binary(), len(starts[some]), [None, pa.py_buffer(((np.append(starts[some], ends[some][-1]) - head) * 4).astype(np.int32)), pa.py_buffer(stream[head : ends[some][-1]].astype("<u4"))])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, n).take(pa.array(doc[some])), pa.array(starts[some] - doc_start[doc[some]]), pa.array(ends[some] - starts[some]), pieces,
                         pa.array(own[doc[some]] + 1), pa.array((at[some] // length) + (part << 40)), pa.array(at[some] % length)],
                        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
                place += len(stream)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, partition_bytes: int = PARTITION_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All texts, each ended by id 0, cut into sequences of ``length`` ids along a Hilbert curve of document vectors.

    Document vectors are votes of hashed words in a few dimensions. Rows are dealt by ranges of their place on the
    curve, which hold ``partition_bytes`` of text about, and sorted by (place, id); where more text has one place, as
    with many equal texts, it is dealt further by ids. Each task fills sequence after sequence, and only its last one is
    padded.

    Returns a row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset. Null and empty texts are the one id 0; null ids and repeated rows are packed like others; an empty table
    gives no rows. Other columns are not read. Texts of any length are cut, none is dropped. ``tokenizer`` is the path
    of a byte-level tokenizer file, by default the public one of 50,257 ids; it is read on the executors.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), known(text).alias("text"))
    keyed = lambda some: some.mapInArrow(_keyed, "doc_id long, text string, curve long").withColumn(
        "cell", F.shiftright("curve", DIMS * DEPTH - CELLS).cast("int"))
    # Ranges of about equal size in bytes; a sample tells where they end, which decides nothing but the size of tasks. A
    # cell that is too large is split by ids.
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text") + F.lit(1))).first()
    share = min(1.0, SAMPLE * math.ceil((n_bytes or 0) / partition_bytes) / max(1, n_rows))
    seen = keyed(rows if share == 1.0 else rows.sample(share, seed=5)).groupBy("cell").agg(F.sum(F.octet_length("text") + F.lit(1)).alias("size"))
    sizes = {r["cell"]: r["size"] / share for r in seen.collect()}
    cuts, part, filled = [], 0, 0.0
    for cell in range(1 << CELLS):
        size = sizes.get(cell, 0.0)
        if filled and filled + size > partition_bytes:
            part, filled = part + 1, 0.0
        many = max(1, math.ceil(size / partition_bytes))
        cuts.append((cell, part, many))
        part, filled = part + many - 1, filled + size if many == 1 else float(partition_bytes)
    placed = keyed(rows)
    spark = docs.sparkSession
    range_of = spark.createDataFrame(cuts, "cell int, first int, many int")
    dealt = placed.join(F.broadcast(range_of), "cell").withColumn("part", F.expr("first + CAST(pmod(xxhash64(doc_id), many) AS INT)")).repartitionById(part + 1, "part")
    return dealt.sortWithinPartitions("curve", "doc_id").select("doc_id", "text").mapInArrow(
        _packer(tokenizer, length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

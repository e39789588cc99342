"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm import tokens
from cueloom.llm.common import known, unused, widened

SLOTS = 64
BUCKET_BYTES = 4 << 20
_U = np.uint64


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Deterministic coin tossing: twice the lowest bit in which a symbol differs from the one before, plus that bit."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = symbols[first] ^ _U(1)
    differ = symbols ^ before
    place = np.bitwise_count((differ & (~differ + _U(1))) - _U(1)).astype(_U)
    return (place << _U(1)) | ((symbols >> place) & _U(1))


def _runs(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol become one symbol that also has their length in its name."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    if len(at) == len(names):
        return names, rows
    length = np.diff(np.append(at, len(names)))
    out, many = names[at], length > 1
    out[many] = tokens.mix(out[many] ^ (length[many].astype(_U) << _U(17)))
    # A run's name could by chance equal its neighbour's: then they differ by the last bit.
    same = np.flatnonzero((out[1:] == out[:-1]) & (rows[at][1:] == rows[at][:-1])) + 1
    out[same] ^= _U(1)
    return out, rows[at]


def parse_level(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, rows) of the phrases of one level. Boundaries depend on a few neighbouring symbols only."""
    names, rows = _runs(names, rows)
    first = np.ones(len(names), bool)
    first[1:] = rows[1:] != rows[:-1]
    labels = names
    for _ in range(3):  # 64 bits, then 7, 4 and 3: few labels, so phrases are short
        labels = _toss(labels, first)
    start = first.copy()
    if len(names) > 2:
        low = (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:]) & ~first[1:-1] & ~first[2:]
        start[1:-1] |= low
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], len(names))
    return tokens.span_hash(names, begins, ends), rows[begins]


def sketch(data: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` 16-bit values per text (0: none): the least phrase name of each slot, over all levels.

    Names of level 3 and above (phrases of some words) come before those of level 2, and these before level 1, in every
    slot of every text. So long texts are told by long phrases, the slots that a short text leaves open are filled by
    shorter ones, and nothing depends on a length.
    """
    n = len(offsets) - 1
    least = np.full(n * slots, np.iinfo(np.uint64).max, _U)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    names = tokens.VALUES[data]
    level = 0
    while len(names):
        level += 1
        before = len(names)
        names, rows = parse_level(names, rows)
        name, rank = tokens.mix(names + _U(level)), _U(max(0, 3 - level))
        np.minimum.at(least, rows * slots + (name >> _U(58)).astype(np.int64) % slots, (rank << _U(62)) | (name << _U(6) >> _U(2)))
        if len(names) == before or level > 40:
            break
        many = np.bincount(rows, minlength=n)
        more = many[rows] > 1
        names, rows = names[more], rows[more]
    value = (tokens.mix(least) >> _U(48)).astype(np.uint16)
    value[value == 0] = 1
    value[least == np.iinfo(np.uint64).max] = 0
    return value.reshape(n, slots)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of slots that agree among those that either text fills; 1 for two empty texts."""
    either = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(either == 0, 1.0, same / np.maximum(either, 1))


def written(values: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in values]


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), SLOTS), np.uint16)
    for row, data, offsets in tokens.text_chunks(pa.array(texts, pa.large_string())):
        n = len(offsets) - 1
        out[row : row + n] = sketch(data, offsets)
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The table with a column ``name`` of fingerprints: 64 values of four hexadecimal digits.

    All rows and columns stay; a column that has this name already is replaced. Null texts count as empty, and empty
    texts have the fingerprint of zeros; equal texts and repeated rows have equal ones; texts of any length are parsed
    as a whole; an empty table stays empty. Ids are not read.
    """

    def run(batches):
        for batch in batches:
            values = written(fingerprint_texts(batch.column(batch.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], names=[*batch.schema.names[:-1], name])

    kept = docs.drop(name)
    return kept.withColumn(unused(kept, "passage"), known(text)).mapInArrow(run, widened(kept, **{name: "string"}))


def _edits(batches):
    """Rows come in order of (bucket, place); a row is told once the row after it is known. Guests only end a bucket."""
    held = None
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
        out = []
        for bucket, guest, doc_id, text in rows:
            if held and held[0] == bucket and not held[1]:
                n = len(held[3])
                cut = n // 4
                out.append((held[2], held[3], held[3][: n - cut] + text[:cut], text))
            if not (guest and held and held[0] == bucket and held[1]):
                held = (bucket, guest, doc_id, text)
        size, part = 0, []
        for row in out:
            part.append(row)
            size += len(row[1])
            if size > 4 << 20:
                yield _told(part)
                size, part = 0, []
        if part:
            yield _told(part)


def _told(rows: list[tuple]) -> pa.RecordBatch:
    import hashlib

    # The next document mostly is the next row: only where it isn't, its text is sketched apart.
    apart = [i for i, r in enumerate(rows) if i + 1 == len(rows) or r[3] is not rows[i + 1][1]]
    texts = fingerprint_texts([r[1] for r in rows] + [rows[i][3] for i in apart])
    own, after = texts[: len(rows)], np.roll(texts[: len(rows)], -1, axis=0)
    after[apart] = texts[len(rows) :]
    edited = fingerprint_texts([r[2] for r in rows])
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
         pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows]), pa.array(written(own)), pa.array(written(edited)),
         pa.array(likeness(own, edited)), pa.array(likeness(own, after))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def cuts_below(order: Column, cuts: list[int]) -> Column:
    """The number of sorted cuts below a value, by halving; the expression has one copy of the cuts and of the step."""
    if not cuts:
        return F.lit(0)
    place = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda below, step: F.when(F.get(place, below + step - 1) < order, below + step).otherwise(below))


def edited_fingerprints(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, most_buckets: int = 10_000) -> DataFrame:
    """Fingerprints of every text and of an edited one, whose last quarter is replaced by the start of the next document.

    The next document is that with the next larger id, after the last the first; rows of one id follow each other by
    their text, rows without id come first. Documents are dealt by ranges of their ids; the first document of a range
    also ends the range before. Null texts are empty; a single row is its own next; an empty table gives no rows.
    Repeated rows keep their rows. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), known().alias("text")).withColumn("order", F.coalesce("doc_id", F.lit(-(2**63))))
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    # Every range is a partition of its own, sorted and streamed, so that a bounded number of them may grow with the table.
    buckets = min(most_buckets, max(1, math.ceil((n_bytes or 0) / bucket_bytes)))
    # Cuts between ranges, found on the ids alone. An id lies in one range, and the ranges are numbered by their order.
    cuts = sorted({int(x) for x in rows.agg(F.percentile_approx("order", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]}) if buckets > 1 and n_rows else []
    rows = rows.withColumn("bucket", cuts_below(F.col("order"), cuts))
    heads = rows.groupBy("bucket").agg(F.min("order").alias("order")).orderBy("bucket").collect()
    guests = [(heads[i - 1].bucket, heads[i].order) for i in range(len(heads))]
    spark = docs.sparkSession
    guest = spark.createDataFrame(guests, "bucket int, order long")
    ends = rows.drop("bucket").join(F.broadcast(guest), "order").withColumn("guest", F.lit(True))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(ends.select("doc_id", "text", "order", "bucket", "guest"))
    return (
        dealt.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "guest", "order", "text")
        .select("bucket", "guest", "doc_id", "text")
        .mapInArrow(_edits, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )

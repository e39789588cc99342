"""The manifest's proofs against a plain tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cueloom.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _levels(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h(*last[i : i + fan]) for i in range(0, len(last), fan)])
    return levels


def _want(rows, fields, group, changed, fan):
    trees = {}
    for row in rows:
        told = [_h(*(_field(v[f]) for f in fields)) for v in (row, {**row, **changed(row)})]
        trees.setdefault(row[group], []).append((row["doc_id"] is not None, row["doc_id"] or 0, *told, row))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: _levels([x[2] for x in sorted(trees[g], key=lambda x: x[:4])], fan) for g in order}
    top = _levels([built[g][-1][0] for g in order], fan)
    out = []
    for k, g in enumerate(order):
        for i, (_, _, leaf, other, row) in enumerate(sorted(trees[g], key=lambda x: x[:4])):
            folded, met, at = other, [], i
            for levels, start in ((built[g], i), (top, k)):
                at = start
                for level in levels[:-1]:
                    run = level[at // fan * fan : at // fan * fan + fan]
                    own = at % fan
                    met += run[:own] + run[own + 1 :]
                    folded = _h(*run[:own], folded, *run[own + 1 :])
                    at //= fan
            out.append((row["doc_id"], leaf, built[g][-1][0], top[-1][0], _h(*met), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize(("fan", "stride", "crowd"), [(3, 6, 1024), (3, 1, 2), (2, 2, 3), (4, 1, 1)])
def test_proofs(spark, table, odd_rows, fan, stride, crowd):
    df = table(odd_rows + [(i, f"text {i % 7}\n{i}") for i in range(100, 180)])
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = [r.asDict() for r in df.collect()]
    got = merkle.proofs(
        df, fields, "doc_id", "source", {"text": F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}, fan, stride, crowd)
    hit = lambda r: r["doc_id"] is not None and r["doc_id"] % 2 == 0 and r["text"] is not None
    want = _want(rows, fields, "source", lambda r: {"text": r["text"].replace("\n", "")} if hit(r) else {}, fan)
    told = [(r.id, *(bytes(x).hex() for x in (r.leaf, r.subroot, r.root, r.proof, r.folded)), r.verified) for r in got.collect()]
    assert sorted(told, key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in told} == {True, False}


def test_one_leaf_and_none(spark, table):
    fields = ["doc_id", "text"]
    one = merkle.proofs(table([(1, "a")]), fields, "doc_id", "source").collect()
    leaf = _h("1:1", "1:a")
    assert [(bytes(r.leaf).hex(), bytes(r.root).hex(), bytes(r.proof).hex(), r.verified) for r in one] == [(leaf, leaf, _h(), True)]
    assert merkle.proofs(table([(1, "a")]).limit(0), fields, "doc_id", "source").count() == 0


def test_a_group_lies_in_many_partitions(spark):
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("source"))
    rows = rows.withColumn("text", F.lit("same"))
    got = merkle.proofs(rows, ["doc_id", "text"], "doc_id", "source", stride=2, crowd=50).collect()
    want = _want([r.asDict() for r in rows.collect()], ["doc_id", "text"], "source", lambda r: {}, 3)
    assert sorted((r.id, bytes(r.proof).hex(), bytes(r.root).hex(), r.verified) for r in got) == sorted((w[0], w[4], w[3], True) for w in want)

import random

import pytest

CLASH = ["node", "key", "hash", "bucket", "blob", "spans", "shard", "keep", "label", "file", "p_quality", "text_key"]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of (doc_id, text) rows with further columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k % 5}", None if t is None else len(t), *["x"] * len(CLASH))
             for k, (i, t) in enumerate(rows)], SHAPE).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, rows repeated whole, ids shared by different texts, copies and near copies."""
    rng = random.Random(5)
    words = [a + b for a in ("ta", "ko", "mi", "re", "Élan", "süß", "x") for b in ("lu", "no", "pe", "za", "日本", "")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, part = say(120), say(30)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, say(80) + "\n" + part + "\n" + say(50)), (5, part + say(40)), (6, None), (7, ""), (8, "   \t\n"),
        (9, "one two"), (10, "One two"), (11, "one"), (12, say(20_000)), (13, say(60)), (13, say(60)), (14, base), (14, base), (None, base), (None, None),
        (15, "a" * 400), (16, "b" + "a" * 380 + "b"), (17, "one two three four five six"), (18, "ONE two three four five six"), (-4, say(9)), (19, "A" * 49),
    ]

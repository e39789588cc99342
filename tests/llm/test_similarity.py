"""Jaccard components, benchmark leaks, suffix removal and fingerprints against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import decontaminate, fingerprints, jaccard, suffixes, tokens


def grams(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, part, whole):
    sets = [grams(t, n) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and None not in (rows[a][0], rows[b][0]) and whole * both >= part * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                up[y] = x
    return sorted((str(i), len(s), str(root(i) if i is not None else None)) for (i, _), s in zip(rows, sets, strict=True))


def told(df, *columns):
    return sorted(tuple(str(r[c]) if c in ("doc_id", "component_id") else r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("n,part,whole", [(4, 85, 100), (5, 80, 100)])
def test_components_of_odd_rows(table, odd_rows, n, part, whole):
    got = told(jaccard.link_components(table(odd_rows), n, part, whole), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(odd_rows, n, part, whole)


def test_components_of_edited_copies(table):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, passage = [], [rng.choice(words) for _ in range(30)]
    for size in (5, 6, 7, 9, 12, 15, 20, 33, 60, 150):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + size // 12)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[rng.randrange(3) :]
            rows.append((len(rows), " ".join(w)))
    # A passage in many otherwise different texts links none of them.
    rows += [(len(rows) + i, " ".join([rng.choice(words) for _ in range(20)] + passage)) for i in range(60)]
    got = told(jaccard.link_components(table(rows)), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows, 4, 85, 100)


def test_no_rows(table):
    none = table([(1, "x")]).filter("doc_id > 5")
    assert jaccard.link_components(none).count() == suffixes.remove_repeats(none).count() == fingerprints.edited_fingerprints(none).count() == 0
    assert jaccard.one_of_each(none).columns == none.columns


def test_linked_sets_share_a_key():
    """Every pair of sets at the bound shares a key, whatever is left out."""
    rng = np.random.default_rng(2)
    plan = jaccard.bands(85, 100, 1 << 31)
    for size in (1, 2, 5, 6, 7, 8, 13, 14, 40, 41, 199, 200, 700):
        for _ in range(15):
            other = rng.integers(-(-size * 85 // 100), size + 1)
            shared = min(other, -(-85 * (size + other) // 185))
            pool = rng.integers(0, 2**63, size + other - shared).astype(np.uint64)
            a, b = pool[:size], np.concatenate([pool[:shared], pool[size:]])
            values, rows = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            held = {0: set(), 1: set()}
            for owners, keys, _, _ in jaccard.segment_keys(values, rows, 2, plan, 85, 100):
                for o, k in zip(owners.tolist(), keys.tolist(), strict=True):
                    held[o].add(k)
            assert held[0] & held[1], (size, other)


def test_one_of_each_keeps_columns(table, odd_rows):
    docs = table(odd_rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[14] and ids[6] == ids[7] == 1 and ids[None] == 2 and ids[13] == 1


def brute_removed(rows, length=50):
    data = [(o if o is not None else 2**63 - 1, (t or "").encode()) for o, t in rows]
    seen = {}
    for o, t in sorted(data, key=lambda r: r[0]):
        for q in range(len(t) - length + 1):
            seen.setdefault(t[q : q + length], o)
    out = []
    for (i, _), (o, t) in zip(rows, data, strict=True):
        gone = bytearray(len(t))
        for q in range(len(t) - length + 1):
            if seen[t[q : q + length]] < o:
                gone[q : q + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [suffixes.HOT_CLASSES, 1])
def test_removed_bytes(table, odd_rows, hot):
    rng = random.Random(3)
    shared = "".join(rng.choice("ab") for _ in range(200))
    rows = odd_rows + [(100 + i, "".join(rng.choice("abc") for _ in range(rng.randrange(90))) + shared[i : 60 + 3 * i] + "".join(rng.choice("ab") for _ in range(70))) for i in range(40)]
    got = suffixes.remove_repeats(table(rows), bucket_bytes=20_000, hot_classes=hot)
    assert told(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removed(rows)


def test_blind_trie_sorts():
    rng = random.Random(4)
    for _ in range(50):
        strings = [bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randrange(1, 60))]
        trie = suffixes.BlindTrie()
        for i, s in enumerate(strings):
            trie.insert(s, i)
        leaves = list(trie.leaves())
        assert [strings[x[0]] for x in leaves] == sorted(set(strings)) and all(len({strings[i] for i in x}) == 1 for x in leaves)
        assert sorted(i for x in leaves for i in x) == list(range(len(strings)))


def brute_leaks(docs, items, least):
    """Best similarity of every window of an item's word count."""
    def cut(text):
        low = tokens.fold(np.frombuffer((text or "").encode(), np.uint8))
        _, _, b, e = tokens.words(low, np.array([0, len(low)]), tokens.LETTERS)
        return [low[x:y].tobytes() for x, y in zip(b, e, strict=True)]

    words = {i: cut(t) for i, t in items}
    seen = Counter(g for w in words.values() for g in set(decontaminate._runs(w)))
    weight = lambda g: np.log(1 + len(words) / seen[g]) if seen[g] else np.log(1 + len(words))
    out = {}
    for d, text in docs:
        w = cut(text)
        for i, item in words.items():
            mine = Counter(decontaminate._runs(item))
            for s in range(len(w) - len(item) + 1 if item else 0):
                other = Counter(decontaminate._runs(w[s : s + len(item)]))
                both = mine.keys() | other.keys()
                sim = sum(weight(g) * min(mine[g], other[g]) for g in both) / sum(weight(g) * max(mine[g], other[g]) for g in both)
                if sim >= least:
                    out[d, i] = max(out.get((d, i), 0.0), sim)
    return out


def test_leaks(spark, table, odd_rows):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("the of tion er re in on an ti es".split()) + rng.choice("abcdefgh") for _ in range(n))
    items = [(k, say(rng.randrange(14, 50))) for k in range(12)] + [(50, "tiny item"), (51, None), (52, ""), (50, "tiny item")]
    docs = list(odd_rows)
    for k, (_, text) in enumerate(items[:12]):
        near = text.split(" ")
        near[0] = "other"
        docs += [(200 + k, say(30) + " " + text.upper() + "! " + say(20)), (300 + k, say(9) + " " + " ".join(near) + " " + say(40)), (400 + k, say(60))]
    docs.append((500, "a Tiny, item here"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(table(docs), bench, block_bytes=600).collect()}
    whole = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(table(docs), bench, radius=None).collect()}
    want = brute_leaks(docs, [(i, t) for i, t in dict(items).items()], 0.8)
    assert len(set(want) & set(got)) >= 0.95 * len(want) and set(got) <= set(want) and all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    assert set(want) == set(whole) and all(abs(whole[k] - v) < 1e-9 for k, v in want.items())
    assert {(200 + k, k) for k in range(12)} | {(500, 50)} <= got.keys()
    kept = decontaminate.without_leaks(table(docs), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {d for d, _ in got})
    assert decontaminate.find_leaks(table(docs), bench.filter("item_id < 0")).count() == 0


def test_leaks_of_edited_items(spark, table):
    """Items with foreign words at an edge, up to the bound, and documents shorter than their item: the exact search finds all."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(400)}" for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([15, 25, 37, 52, 59, 90, 150] * 20)]
    docs, short = [], {}
    for k, text in items:
        w = text.split(" ")
        edge = (len(w) - 4) // 10
        docs.append((1000 + k, say(8) + " " + " ".join(w[edge:]) + " " + say(edge + 8)))
        docs.append((2000 + k, " ".join(w[edge:])))
        short[2000 + k, k] = (len(w) - 4 - edge) / (len(w) - 4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(table(docs).coalesce(1), bench, radius=None).collect()}
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(table(docs).coalesce(1), bench).collect()}
    assert found.keys() <= got.keys() and all(abs(got[k] - v) < 1e-9 for k, v in found.items())
    assert len(found) >= 0.97 * len(got) and sum(k in found for k in short) >= 0.95 * len(short)
    want = brute_leaks([d for d in docs if d[0] < 1007], items[:7], 0.8)
    assert {k for k in got if k[0] < 1007 and k[1] < 7} == set(want) and {(1000 + k, k) for k, _ in items} <= got.keys()
    assert all(abs(got[k] - v) < 1e-6 for k, v in short.items())


def test_recall_of_fingerprints(spark, table):
    """Truncated items, items with words changed anywhere, and items whose shingles differ in rarity, against the exact search."""
    rng = random.Random(14)
    say = lambda n: [f"{rng.choice('abcdefghij')}{rng.randrange(400)}" for _ in range(n)]
    common = [say(12) for _ in range(6)]
    items = [(k, say(rng.randrange(14, 60))) for k in range(150)] + [(200 + k, say(rng.randrange(4, 20)) + common[k % 6] + say(rng.randrange(10, 30))) for k in range(100)]
    docs = []
    for k, w in items:
        for turn in range(3):
            near = list(w)
            if turn == 0:
                near = near[: len(near) - rng.randrange(0, max(1, len(near) // 6))]
            elif turn == 1:
                near[rng.randrange(len(near))] = "changed"
            else:
                near = near[rng.randrange(0, 3) :] + say(3)
            docs.append((1000 * (turn + 1) + k, " ".join([*say(10), *near, *say(10)])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    exact, found = ({(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(table(docs), bench, radius=radius).collect()} for radius in (None, decontaminate.RADIUS))
    assert len(exact) > 500 and found.keys() <= exact.keys() and all(abs(exact[k] - v) < 1e-9 for k, v in found.items())
    for turn in (1, 2, 3):
        own = [k for k in exact if k[0] // 1000 == turn]
        assert sum(k in found for k in own) >= 0.98 * len(own), turn
    close = [k for k, v in exact.items() if v < 0.85]
    assert sum(k in found for k in close) >= 0.95 * len(close)


def test_similarity_does_not_depend_on_blocks(spark, table):
    """Items that share passages, in several blocks and in one: weights come from the whole benchmark."""
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("the of tion er re in on an ti es".split()) + rng.choice("abcdefgh") for _ in range(n))
    shared = say(16)
    items = [(k, shared + " " + say(10 + k)) for k in range(8)] + [(9, say(20))]
    docs = [(100 + k, say(5) + " " + " ".join(["other", *t.split(" ")[1:-1], "words"]) + " " + say(5)) for k, (_, t) in enumerate(items)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    told = [{(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(table(docs), bench, block_bytes=b).collect()} for b in (600, 1 << 20)]
    assert told[0].keys() == told[1].keys() and told[0]
    assert all(abs(t[k] - v) < 1e-12 for k, v in told[1].items() for t in told)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = decontaminate.Items(["a b c d e f g"] * 5, 7, Counter(), 5)
    items.prints[:] = rng.integers(0, 2**63, 5)
    keys, keyed = [], []
    for b, (lo, hi) in enumerate(decontaminate._cuts(7)):
        keys.append(items._keys(items.sizes, items.prints, b, lo, hi))
        keyed.append(np.arange(5))
    order = np.argsort(np.concatenate(keys), kind="stable")
    items.keys, items.keyed = np.concatenate(keys)[order], np.concatenate(keyed)[order]
    probe = []
    for i in range(200):
        x = int(items.prints[i % 5])
        for bit in rng.choice(64, rng.integers(0, 11), replace=False).tolist():
            x ^= 1 << bit
        probe.append(x)
    probe = np.array(probe, np.uint64)
    at, item, _ = items.candidates(np.full(200, 7), probe)
    far = np.bitwise_count(probe[:, None] ^ items.prints[None])
    assert set(zip(at.tolist(), item.tolist(), strict=True)) == set(zip(*[x.tolist() for x in np.nonzero(far <= 7)], strict=True))


def test_edited_texts(table, odd_rows):
    order = sorted(odd_rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    rows = fingerprints.edited_fingerprints(table(odd_rows), bucket_bytes=2_000).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == sorted(want)
    by_text = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by_text[1] == by_text[2] == by_text[14]
    alone = fingerprints.edited_fingerprints(table([(5, "abcdefgh")])).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def _plain_fingerprint(text):
    """The parsing symbol by symbol: runs, three tosses, local minima; then the least name of each slot."""
    whole = 2**64 - 1
    mix = lambda x: int(tokens.mix(np.array([x & whole], np.uint64))[0])

    def name_of(part):
        total = 0
        for i, x in enumerate(part):
            total += x * pow(0x9E3779B97F4A7C15, i, 2**64)
        return mix(total + len(part))

    symbols, level, best = [int(tokens.VALUES[b]) for b in text.encode()], 0, {}
    while symbols:
        level += 1
        before, runs = len(symbols), []
        for x in symbols:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        symbols = [x if n == 1 else mix(x ^ (n << 17)) for x, n in runs]
        symbols = [x ^ 1 if k and x == symbols[k - 1] else x for k, x in enumerate(symbols)]
        labels = symbols
        for _ in range(3):
            tossed = []
            for k, x in enumerate(labels):
                differ = x ^ (labels[k - 1] if k else x ^ 1)
                place = (differ & -differ).bit_length() - 1
                tossed.append(place << 1 | (x >> place & 1))
            labels = tossed
        n = len(labels)
        starts = [k for k in range(n) if k == 0 or (k < n - 1 and labels[k] < labels[k - 1] and labels[k] < labels[k + 1])]
        symbols = [name_of(symbols[b:e]) for b, e in zip(starts, [*starts[1:], n], strict=True)]
        for x in symbols:
            name = mix(x + level)
            key = max(0, 3 - level) << 62 | (name << 6 & whole) >> 2
            best[name >> 58] = min(best.get(name >> 58, whole), key)
        if len(symbols) == before or len(symbols) == 1:
            break
    return [(mix(best[s]) >> 48) or 1 if s in best else 0 for s in range(64)]


def test_fingerprints_equal_a_plain_parser(table, odd_rows):
    rows = [(k, t if t is None else t[:3_000]) for k, (_, t) in enumerate(odd_rows)]
    prints = {}

    def of(text):
        if text not in prints:
            prints[text] = _plain_fingerprint(text)
        return prints[text]

    def near(a, b):
        filled = [(x, y) for x, y in zip(of(a), of(b), strict=True) if x or y]
        return sum(x == y for x, y in filled) / len(filled) if filled else 1.0

    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(table(rows), bucket_bytes=2_000).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        hexed = lambda text: "".join(f"{v:04x}" for v in of(text))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (hexed(t), hexed(edited))
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((near(t, edited), near(t, after)))


def test_many_ranges_of_ids(spark, table):
    """The bucket expression doesn't grow with the number of ranges: 250 of them in the query, 10,000 in the expression."""
    rows = [(7 * i - 900, f"text number {i} of many") for i in range(250)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_fingerprints(table(rows), bucket_bytes=1, most_buckets=250).collect()}
    for k, (i, t) in enumerate(rows):
        cut = len(t) // 4
        assert got[i] == hashlib.sha256((t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]).encode()).hexdigest()
    cuts = sorted(random.Random(9).sample(range(-(10**6), 10**6), 10_000))
    held = spark.range(-(10**6) - 5, 10**6 + 5, 997).withColumn("below", fingerprints.cuts_below(F.col("id"), cuts)).toPandas()
    assert (held.below == np.searchsorted(cuts, held.id, "left")).all()
    few = spark.range(-3, 9).withColumn("below", fingerprints.cuts_below(F.col("id"), [-(2**63), 0, 4])).toPandas()
    assert (few.below == np.searchsorted([-(2**63), 0, 4], few.id, "left")).all()


def test_equal_substrings_have_equal_interiors():
    rng = random.Random(8)
    inner = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))

    def names(text, level):
        data = np.frombuffer(text.encode(), np.uint8)
        out, rows = tokens.VALUES[data], np.zeros(len(data), np.int64)
        for _ in range(level):
            out, rows = fingerprints.parse_level(out, rows)
        return out.tolist()

    for level in (1, 2, 3):
        own, one, other = names(inner, level), names(say(17) + inner + say(40), level), names(say(501) + inner, level)
        assert len(set(own[4:-4]) - set(one)) <= 2 and len(set(own[4:-4]) - set(other)) <= 2
    a, b, c = fingerprints.fingerprint_texts([inner, say(300) + inner, say(3000)])
    assert fingerprints.likeness(a[None], b[None])[0] > 0.6 and fingerprints.likeness(a[None], c[None])[0] < 0.1
    assert fingerprints.likeness(*fingerprints.fingerprint_texts(["", ""])[:, None])[0] == 1.0


@pytest.mark.parametrize("size", [100, 400])
def test_near_copies_of_any_length_are_alike(size):
    """Four characters more or less change a fingerprint as little on both sides of a length as across it."""
    rng = random.Random(10)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))[:n]

    def alike(short, long):
        texts = [say(long) for _ in range(60)]
        return fingerprints.likeness(fingerprints.fingerprint_texts([t[:short] for t in texts]), fingerprints.fingerprint_texts(texts)).mean()

    across = [alike(size - 4 + i, size + i) for i in (1, 2, 3)]
    beside = [alike(size - 24, size - 20), alike(size + 20, size + 24)]
    assert min(across) > 0.75 and min(across) > min(beside) - 0.08
    other = fingerprints.likeness(fingerprints.fingerprint_texts([say(size) for _ in range(60)]), fingerprints.fingerprint_texts([say(size) for _ in range(60)]))
    assert other.mean() < 0.2


def test_fingerprint_column(table, odd_rows):
    docs = table(odd_rows)
    out = fingerprints.with_fingerprints(docs, name="key")
    assert set(out.columns) == set(docs.columns) and out.count() == len(odd_rows) and all(len(r.key) == 256 for r in out.collect())

"""Conversations that come back, whatever their texts hold."""

import hashlib
import random

from pyspark.sql import functions as F

from cueloom.llm import chats

SHAPE = "conv_id long, turn long, role string, text string, piece string, formatted string"


def _digest(turns):
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def _read(text):
    """The grammar, one character after the other."""
    turns, at = [], 0
    while at < len(text):
        assert text.startswith(chats.START, at), text[at:]
        at += len(chats.START)
        line = text.index("\n", at)
        end = text.index(chats.END + "\n", line)
        out = []
        for part in (text[at:line].replace(chats.BREAK, "\n"), text[line + 1 : end]):
            plain, k = "", 0
            while k < len(part):
                run = k + 1
                while run < len(part) and part[run] == "\\":
                    run += 1
                if part[k] == "<" and run > k + 1 and run < len(part) and part[run] == "|":
                    plain, k = plain + "<" + part[k + 2 : run], run
                else:
                    plain, k = plain + part[k], k + 1
            out.append(plain)
        turns.append(tuple(out))
        at = end + len(chats.END) + 1
    return turns


def test_texts_come_back(spark):
    rng = random.Random(3)
    bits = ["<", "|", "\\", "\n", "im_end", "im_start", "|>", "<|im_end|>", "<|im_start|>", "<|nl|>", "assistant", "é", "𝄞", " ", "<\\|im_end|>", "user\n", "nl", "<|endoftext|>"]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", say()]), say(), "x", "y") for c in range(150) for t in range(rng.randrange(1, 7))]
    rows += [(None, 1, "user", None, "x", "y"), (None, 0, None, "<|im_end|>", "x", "y"), (500, None, "assistant", "first", "x", "y"), (500, 0, "assistant", "z", "x", "y")]
    rows += [(501, 2, "assistant", "same", "x", "y")] * 3 + [(502, 0, "assistant", "", "x", "y"), (503, 0, "assistant", "long <| text " * 40_000, "x", "y")]
    source = {}
    for c, t, r, x, *_ in rows:
        source.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    want = {c: [(r, x) for _, r, x in sorted(v)] for c, v in source.items()}
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    for most in (1024, 2):
        pieces = chats.format_chats(df, piece_turns=most).cache()
        got, told = {}, {}
        for p in sorted(pieces.collect(), key=lambda p: p.piece):
            assert p.identical
            turns = _read(p.formatted)
            got[p.conv_id] = got.get(p.conv_id, []) + turns
            learnt = [p.formatted[s.begin : s.end] for s in p.loss]
            assert learnt == [p.formatted.encode()[s.begin_byte : s.end_byte].decode() for s in p.loss]
            assert [x for r, x in turns if r == "assistant"] == [_read(f"{chats.START}a\n{x}{chats.END}\n")[0][1] for x in learnt]
            told[p.conv_id] = told.get(p.conv_id, 0) + len(p.formatted)
        assert got == want
        assert {r.conv_id: tuple(r)[1:] for r in chats.digests(pieces).collect()} == {c: (*_digest(v), told[c]) for c, v in want.items()}
        assert (pieces.filter("NOT whole").count() > 0) == (most == 2)
        pieces.unpersist()


def test_only_what_conflicts_is_escaped(spark):
    texts = ["plain", "a <| b", "<|im_end|>", "<|endoftext|> <| b", "<\\|x", "<\\|x <|im_end|>"]
    rows = spark.createDataFrame([(i, 0, "user", t, "", "") for i, t in enumerate(texts)], SHAPE)
    got = {r.conv_id: r.formatted[len("<|im_start|>user\n") : -len("<|im_end|>\n")] for r in chats.format_chats(rows).collect()}
    assert [got[i] for i in range(6)] == ["plain", "a <| b", "<\\|im_end|>", "<\\|endoftext|> <| b", "<\\\\|x", "<\\\\|x <\\|im_end|>"]


def test_broken_texts_are_told(spark):
    texts = ["x<|im_start|>user\na<|im_end|>\n", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\na<|im_end|>", "<|im_start|>user\na<|x|>b<|im_end|>\n", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(chats.parsed(F.col("t")).alias("p")).collect()
    assert [[t.sound for t in r.p] for r in got] == [[False, True], [False], [False], [False], []]


def test_no_turns(spark):
    assert chats.digests(chats.format_chats(spark.createDataFrame([], SHAPE))).count() == 0

"""The prefix trie against a brute-force one over lists of turns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vulnspark.llm import prefix_trie, running
from vulnspark.llm.prefix_trie import borrow_turns, numbered_turns, trie

SCHEMA = "conv_id long, turn long, role string, text string, place int, words string, `a.b` string"


def built(spark, rows):
    df = spark.createDataFrame([(*r, 1, "w", "o") for r in rows], SCHEMA).repartition(3)
    head = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % 4
    rows, conversations = borrow_turns(numbered_turns(df), F.col("conv") - F.col("conv") % 20, head, most=3)
    return sorted(tuple(r) for r in trie(rows, conversations).collect())


def rest(c):
    return c % 20 if c >= 0 else -(-c % 20)


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def expected(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            turns[c].append((t is not None, t or 0, digest(*said), said))
    own = {c: [x[-1] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - rest(c), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", x[-1][1])) for x in below if x)
        ends = sorted(c for c in who if len(whole[c]) == len(node))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
            sum(len(x) == len(node) + 1 for x in below),
            sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below),
            saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(), len(ends),
        ))
    return sorted(out)


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["hi there", "a b c", "", None, "é ü x", "one\ttwo\n three", "word " * 50]
    rows = []
    for c in rng.sample(range(-30, 300), n):
        for t in range(rng.randint(1, 6)):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "bot", None]), rng.choice(texts[: rng.randint(1, 7)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    rows = conversations(seed, 60)
    assert built(spark, rows) == expected(rows)


def test_long_conversations_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(running, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "_ID_BITS", 3)
    monkeypatch.setattr(running, "HOT_KEYS", 5)
    long = [(c, t, "user", f"turn {t if t < 40 else t * c}") for c in (40, 47, 59) for t in range(45)]
    same = [(c, t, "user", f"common {t}") for c in range(100, 160) for t in range(9)]
    rows = long + same + conversations(3, 40)
    assert built(spark, rows) == expected(rows)


def test_repeated_turns_turnless_and_missing(spark):
    rows = [
        (1, 0, "user", "x"), (1, 0, "user", "x"),  # repeated rows are turns of their own
        (2, 0, "user", "y"),  # base 0 is absent
        (None, 0, "user", "lost"), (20, None, None, None), (23, 5, "user", "z"), (23, 5, "bot", "z"),
    ]
    assert built(spark, rows) == expected(rows)
    assert built(spark, []) == []


def test_very_long_text(spark):
    rows = [(20, 0, "user", "word " * 1_000_000), (40, 0, "user", "word " * 1_000_000)]
    assert built(spark, rows) == expected(rows)

"""Operator 13 against a trie built prefix by prefix in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from tallyspark.llm import op13_prefix_trie as op13
from tallyspark.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = turns.get(base, [])[:h] + mine[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children, out = defaultdict(int), []
    for key in members:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(own) - 1) * words
    for key, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(key))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), children[key], leaves[key], saved[key],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)


def test_whole_table(spark):
    conversations = table(spark, "/root/testdata/sf0.01", "conversations")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert result(op13.trie(conversations)) == want
    assert any(r[3] > 1 and r[1] > 0 for r in want)


def test_shared_prefixes_of_all_depths(spark):
    """A long chain, a comb, bushy levels and copies, so that cuts of all levels have forests below them."""
    rnd = random.Random(13)
    rows, word = [], lambda: rnd.choice(["a b", "c", "", "d  e\tf"])
    for c in range(0, 2000, 20):
        n = rnd.choice([1, 2, 3, 5, 9, 17, 40])
        rows += [(c, t, "user" if t % 2 else "assistant", f"same {t}" if t < n - rnd.randint(0, 3) else word()) for t in range(n)]
    rows += [(c, t, "user", word()) for c in range(5, 400, 20) for t in range(rnd.randint(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in (7, 8, 9, 10, 11, 31, 32) for t in range(4)]
    assert result(op13.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "user", "x"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "user", "x"), (1, 0, "user", "x"), (-7, 2, "user", "x"), (-7, 2, "u", "serx"),
            (-20, 1, "q", "base"), (-20, 2, "q", "base"), (-20, 3, "q", "base"), (None, 1, "user", "nobody"), (0, 5, "user", "long " * 300_000),
            (2, 1, "a", "y"), (22, 1, "a", "y"), (2**62, 1, "a", "y"), (3, None, None, None)]
    plain = spark.createDataFrame(rows, SCHEMA)
    assert result(op13.trie(plain)) == brute(rows)
    extra = plain
    for c in ("conv", "pos", "size", "words", "depth", "name", "tie_", "Length", "a.b"):
        extra = extra.withColumn(c, op13.F.lit("x"))
    assert result(op13.trie(extra)) == brute(rows)


def test_empty_and_turnless(spark):
    assert result(op13.trie(spark.createDataFrame([], SCHEMA))) == []
    turnless = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:2]
    rows = [(c, 0, "user", "only") for c in turnless]
    got = result(op13.trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 2

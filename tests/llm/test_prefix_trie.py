import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from courtflow.llm import prefix_trie as P
from courtflow.llm.prefix_trie import narrow, prefix_trie
from courtflow.llm.queries import with_shared_heads

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def sequences(rows):
    """Each conversation's turns in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    """Nodes by the contract, from a dictionary of prefixes."""
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)

    def sums(node):
        leaves, saved = (0 if below[node] else 1), (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for child in below[node]:
            a, b = sums(child)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for node, own in members.items():
        ended = ",".join(str(c) for c in own if len(convs[c]) == len(node))
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), len(below[node]), *sums(node), hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


ODD = [
    (0, 0, "user", "a"), (0, None, None, None), (0, 1, "", "a"), (1, 5, "use", "ra"), (1, 5, "use", "ra"), (1, 5, "user", "a"), (None, 0, "user", "lost"), (7, None, None, "é" * 400),
    (-3, 0, "user", "a"), (-3, 1, "user", "b"), (12, 0, "user", "a"), (13, 0, "user", "a"), (2**62, 0, "user", "a"),
]


def conversations(seed, n):
    rnd = random.Random(seed)
    rows = list(ODD)
    for c in range(20, 20 + n):
        if rnd.random() < 0.15:
            continue
        start = rnd.choice(["x", "x", "x", "y", f"z{c}"])
        for turn in range(rnd.randrange(1, 12)):
            rows.append((c, turn, rnd.choice(["user", "assistant", None]) if turn > 3 else "user", start if turn < 2 else rnd.choice(["a", "b", "ü", None])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [40, 100_000])
def test_like_plain(spark, shard_turns, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 3)
    rows = conversations(3, 120)
    turns = narrow(spark.createDataFrame(rows, KIND).repartition(5))
    assert of(prefix_trie(turns, shard_turns)) == plain(sequences(rows))
    assert of(prefix_trie(with_shared_heads(turns), shard_turns)) == plain(rebuilt(sequences(rows)))


def test_one_conversation_told_by_most(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 50)
    rows = [(c, t, "user", f"the same {t}") for c in range(600) for t in range(3)] + [(1000 + c, 0, "user", f"own {c}") for c in range(200)]
    rows += [(5000, t, "user", str(t)) for t in range(3000)]  # a long one
    got = prefix_trie(narrow(spark.createDataFrame(rows, KIND)), 300)
    want = plain({c: v for c, v in sequences(rows).items() if c < 5000})
    short = [r for r in of(got) if r[0] < 5000 and r[1]]
    assert short == [r for r in want if r[1]]
    root = got.where("depth = 0").first()
    assert (root.n_convs, root.n_children, root.n_leaves) == (801, 202, 202) and got.where("conv_id = 5000").count() == 3000


def test_odd_tables(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], KIND)
    assert prefix_trie(narrow(empty)).count() == 0 and prefix_trie(with_shared_heads(narrow(empty))).count() == 0
    df = spark.createDataFrame(ODD, KIND)
    more = df
    for name in ("shard", "key", "at", "up", "digest", "n_bytes", "family", "pos", "members", "lent", "first"):
        more = more.withColumn(name, F.lit("x"))
    assert of(prefix_trie(with_shared_heads(narrow(more)))) == plain(rebuilt(sequences(ODD)))
    alone = prefix_trie(with_shared_heads(narrow(spark.createDataFrame([(8, 0, "user", "a")], KIND))))
    assert of(alone) == plain(rebuilt(sequences([(8, 0, "user", "a")])))  # left without turns: a member of the root only

"""The prefix trie against a trie of nested dictionaries."""

import hashlib
import random
import zlib

import pytest

from kinpanel.llm import prefixtrie

SCHEMA = "conv_id long, turn int, role string, text string, block int, depth int, conv string, id string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, prefix_digest(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    nodes, lengths = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - (abs(c) // 5) * 5 * (1 if c >= 0 else -1))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        lengths[c] = len(path)
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if lengths[c] == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def prefix_digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16] + len(text.encode()).to_bytes(8, "big")


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, "c", "i") for r in rows], SCHEMA)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in prefixtrie.trie(df, **more).select(*names).collect()), key=str)


def conversations(rng, ids, most, alphabet):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(alphabet)) for c in ids for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("most, stretch", [(7, 4096), (40, 4096), (60, 2)])
def test_nodes_are_those_of_a_brute_force_trie(spark, monkeypatch, most, stretch):
    rng = random.Random(most)
    monkeypatch.setattr(prefixtrie, "STRETCH", stretch)
    monkeypatch.setattr(prefixtrie, "JOINED", 3)
    rows = conversations(rng, range(-7, 30), most, ["é", "b", "longer text"])
    copy = conversations(rng, [50], most, ["x"])
    rows += [(c, *r[1:]) for c in range(50, 90) for r in copy]  # one large group of copies
    rows += [(c, *r[1:]) for c in range(90, 110) for r in copy[:2]]
    rng.shuffle(rows)
    assert found(spark, rows, hot_rows=5) == brute(rows)


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "no conversation"), (0, None, None, None), (0, None, "", ""), (0, 1, "user", "a"), (0, 1, "user", "a"),
            (4, 2, "user", ""), (8, 0, "user", "own"), (9, 0, "u" * 300, "ab" * 200_000), (12, 3, "user", "ü")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(3, 1, "user", "gone")]) == brute([(3, 1, "user", "gone")])
    assert found(spark, []) == []


def test_role_and_text_do_not_run_together(spark):
    rows = [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, "abc", ""), (15, 0, "", "abc")]
    assert found(spark, rows) == brute(rows)

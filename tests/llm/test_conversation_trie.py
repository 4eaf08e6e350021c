from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from clauseweave.llm.conversation_trie import DIGEST, SHARED_HEAD, _common, build, child, pack, prefix_trie, sequences, tries
from clauseweave.llm.storage import Workspace

SCHEMA = "conv_id long, turn long, role string, text string, n long, path string, part int, key string, depth int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "k", 3) for r in rows], SCHEMA)


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))

    def place(t):
        digest = hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()[: 2 * DIGEST]
        return (t[0] is not None, t[0] or 0, digest)

    turns = {c: [(r, x) for _, r, x in sorted(v, key=place)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % SHARED_HEAD
        group = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(turns.get(group, [])[:h] + v[h:])
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[:-1] == p for q in below if q) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode().split()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == path)
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def random_rows(seed, convs, turns=4, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, turns)):
            rows.append((c, t, rng.choice(["user", "bot"]), f"say {'word ' * rng.randint(0, 2)}{rng.randint(0, texts)}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 40, 100_000])
def test_against_plain_tree(spark, shard_turns):
    """Small shards put most upper nodes on borders; the sums must not change."""
    rows = random_rows(shard_turns, 120)
    assert found(prefix_trie(frame(spark, rows), shard_turns)) == plain(rows)


def test_copies_and_a_common_first_turn(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 1200, 2) for t in range(3)]
    rows += [(c, t, "user", "same 0" if t == 0 else f"own {c} {t}") for c in range(1, 200, 2) for t in range(3)]
    assert found(prefix_trie(frame(spark, rows), 50)) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "nobody"),
        (5, None, "user", "null turn"), (5, 0, None, None), (5, 0, "user", ""), (5, 0, "user", "tie"), (5, 0, "user", "tie"),
        (-7, 1, "user", "below zero"), (-7, 2, "bot", "ünï  wörd x\n y"),
        (3, 9, "user", "only one"), (2, 1, "user", "short"), (1, 1, "a", "bc"), (4, 1, "ab", "c"),
        (40, 0, "user", "w " * 50_000), (41, 0, "user", "w " * 50_000),
    ]
    assert found(prefix_trie(frame(spark, rows))) == plain(rows)
    assert found(prefix_trie(frame(spark, []))) == []


def test_a_conversation_of_many_turns(spark):
    rows = [(60, t, "user", f"turn {t % 50} {t}") for t in range(5000)]
    got = found(prefix_trie(frame(spark, rows), 1000))
    assert len(got) == 5001
    assert {r[4] for r in got if r[1] < 5000} == {1}
    assert all(r[5] == 1 and r[6] == 0 for r in got)


def test_double_array_holds_every_path(spark):
    rows = random_rows(9, 300, turns=6, texts=12)
    with Workspace(spark) as space:
        stored = space.store(sequences(frame(spark, rows)))
        paths = [(bytes(r.path), r.words) for r in stored.collect()]
        for trie in tries(stored, 200).collect():
            base, check = np.frombuffer(trie.base, "<i4"), np.frombuffer(trie.check, "<i4")
            turns = [bytes(trie.turns)[i : i + DIGEST] for i in range(0, len(trie.turns), DIGEST)]
            assert len(set(turns)) == len(turns)
            number = {t: i + 1 for i, t in enumerate(turns)}
            own = [p for p, _ in paths if bytes(trie.first) <= p <= bytes(trie.last)]
            assert len(own) == len(trie.ends)
            for path, end in zip(sorted(own), np.frombuffer(trie.end_state, "<i4"), strict=True):
                state = 0
                for i in range(0, len(path), DIGEST):
                    state = child(base, check, state, number[path[i : i + DIGEST]])
                    assert state > 0
                assert state == end


def test_pack_places_wide_and_clashing_nodes():
    rng = random.Random(5)
    parent, code, seen = [0], [0], set()
    for _ in range(3000):
        edge = (rng.choice([0, 0, 1, 2, len(parent) - 1]) % len(parent), rng.randint(1, 2500))
        if edge not in seen:
            seen.add(edge)
            parent.append(edge[0])
            code.append(edge[1])
    base, check, state = pack(np.array(parent), np.array(code))
    assert len(set(state.tolist())) == len(parent)
    for node in range(1, len(parent)):
        assert child(base, check, int(state[parent[node]]), code[node]) == state[node]
    assert (check >= 0).sum() == len(parent) - 1


def test_common_and_empty_paths():
    a, b = bytes(range(16)), bytes(range(16, 32))
    assert [_common(a + b, a), _common(b"", a), _common(a, b)] == [1, 0, 0]
    trie = build([{"path": b"", "words": [], "n": 2, "least": 1, "ends": "x"}])
    assert np.frombuffer(trie["end_state"], "<i4").tolist() == [0]

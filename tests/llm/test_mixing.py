from __future__ import annotations

import collections
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseweave.llm.mixing import OTHER, dealt, deadline_template, mix_sources, mixture, phases, whole_shares


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12))
def test_template_keeps_every_prefix_within_one_block(shares):
    shares = {f"s{i}": k for i, k in enumerate(shares)}
    cycle = sum(shares.values())
    template = deadline_template(shares)
    assert sorted(x for slots in template.values() for x in slots) == list(range(cycle))
    for source, slots in template.items():
        for j, slot in enumerate(slots):
            assert j * cycle // shares[source] <= slot < -(-(j + 1) * cycle // shares[source])
        for t in range(cycle + 1):
            assert abs(sum(x < t for x in slots) - Fraction(t * shares[source], cycle)) < 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 70), st.floats(0.01, 9)), min_size=1, max_size=7))
def test_phases_place_each_block_once(sources):
    blocks = {f"s{i}": n for i, (n, _) in enumerate(sources)}
    weights = {f"s{i}": w for i, (_, w) in enumerate(sources)}
    plan = phases(blocks, weights, 50)
    taken = []
    for p in plan:
        for source, share in p.shares.items():
            for j in range(p.length):
                turn, k = divmod(j, share)
                slot = turn * p.cycle + p.template[source][k]
                if slot >= p.length:
                    break
                taken.append((p.first_slot + slot, source, p.first_block[source] + j))
    assert sorted(x for x, _, _ in taken) == list(range(sum(blocks.values())))
    assert collections.Counter(s for _, s, _ in taken) == collections.Counter({s: n for s, n in blocks.items() if n})


def brute_positions(found, block_rows):
    """Blocks in the order of their slots, rows in the order of their places within."""
    rows = sorted(found, key=lambda r: (r.slot, r.position))
    return [r.position for r in rows], rows


def test_whole_mixture(frame):
    docs = frame([f"t{i}" for i in range(500)], source=lambda i: "hot" if i % 3 == 0 else [None, "a", "b", "c"][i % 4])
    found = mix_sources(docs, block_rows=4, cycle=60).collect()
    places, rows = brute_positions(found, 4)
    assert places == list(range(500))
    assert len({r.doc_id for r in rows}) == 500
    assert {r.stream for r in found if r.source is None} == {OTHER}
    of = collections.defaultdict(set)
    for r in found:
        of[r.slot].add((r.stream, r.block))
        assert r.release < r.deadline
    assert sorted(of) == list(range(len(of))) and all(len(x) == 1 for x in of.values())


def test_given_weights_hold_until_a_source_ends(frame):
    docs = frame([f"t{i}" for i in range(900)], source=lambda i: "ab"[i % 2])
    found = mix_sources(docs, weights={"a": 3.0, "b": 1.0}, block_rows=1, cycle=40).collect()
    order = [r.source for r in sorted(found, key=lambda r: r.position)]
    for t in range(1, 600):
        assert abs(order[:t].count("a") - 0.75 * t) <= 1
    assert order[600:].count("b") == 300
    assert whole_shares({"a": 3.0, "b": 1.0}, 40) == {"a": 30, "b": 10} or abs(whole_shares({"a": 3.0, "b": 1.0}, 40)["a"] - 30) <= 1


def test_odd_rows(odd, nothing):
    found = mix_sources(odd, block_rows=2).collect()
    assert sorted(r.position for r in found) == list(range(odd.count()))
    assert mix_sources(nothing).collect() == []
    with pytest.raises(ValueError):
        mix_sources(odd, weights={"a": 0.0})


def deviations(order, weights, slots):
    """The largest distance of any source from its target weight at any of the first slots."""
    got, total, worst = dict.fromkeys(weights, 0), sum(weights.values()), 0.0
    for t, (source, *_) in enumerate(order, 1):
        if t > slots:
            break
        got[source] += 1
        worst = max(worst, max(abs(got[s] - w / total * t) for s, w in weights.items()))
    return worst


@pytest.mark.parametrize("hot", [19.0, 5.0, (1 / 3 / (2 / 3 / 19)) ** 0.5, 0.001])
def test_targets_hold_over_many_cycles(hot):
    weights = {"hot": hot} | {f"s{i}": 1.0 + i * 1e-3 for i in range(19)}
    blocks = dict.fromkeys(weights, 60_000)
    # Shares are rounded to 2^-40, which adds 3e-8 in so many slots.
    assert deviations(dealt(blocks, weights), weights, 30_000) < 1 + 1e-6


def test_every_source_has_its_own_windows(frame):
    docs = frame([f"t{i}" for i in range(1500)], source=lambda i: f"s{i % 600}")
    for weights in (None, {f"s{i}": 1.0 + i for i in range(600)}):
        found = mix_sources(docs, weights=weights, block_rows=1).collect()
        assert sorted(r.position for r in found) == list(range(1500))
        assert {r.stream for r in found} == {f"s{i}" for i in range(600)}
        assert all(r.stream == r.source and r.release < r.deadline for r in found)


def test_groups_keep_their_bound():
    weights = {f"s{i:02}": 1.0 + i for i in range(60)}
    blocks = dict.fromkeys(weights, 300)
    order = list(mixture(blocks, weights, most=6))
    assert sorted((s, b) for s, b, *_ in order) == [(s, b) for s in sorted(weights) for b in range(300)]
    names = sorted(weights, key=lambda s: -weights[s])
    tail = names[6:]
    top = {s: weights[s] for s in names[:6]} | {"rest": sum(weights[s] for s in tail)}
    assert deviations([("rest" if s in tail else s,) for s, *_ in order], top, 1500) < 1 + 1e-6
    groups = {s: i // 9 for i, s in enumerate(tail)}
    sums = {g: sum(weights[s] for s in tail if groups[s] == g) for g in range(6)}
    assert deviations([(groups[s],) for s, *_ in order if s in groups], sums, 1000) < 1 + 1e-6

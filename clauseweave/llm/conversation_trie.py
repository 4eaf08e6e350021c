"""Prefix tree of conversations as double-array tries, one for each shard of sorted sequences.

Conversations are sequences of turn digests. Equal ones become one sequence with
counts; sequences are sorted, so that all that share a prefix stand together, and
cut into shards. A shard numbers its turns densely and packs its nodes into the
arrays BASE and CHECK: the child of state s by turn c is state t = BASE[s] + c if
CHECK[t] = s. A node that only one shard holds is finished by walking its trie.
The few nodes on the border of two shards add up over the shards: every measure
is counted where a node, child or leaf begins, so sums are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauseweave.llm.storage import Workspace

#: Bytes of a turn's digest; conversations in a chunk of ids; turns in a shard.
DIGEST, CHUNK_BITS, SHARD_TURNS = 16, 8, 50_000
GROUP, SHARED_HEAD = 20, 4
NOBODY = hashlib.sha256(b"").hexdigest()

SEQUENCE = "path binary, words array<int>, n long, least long, ends string"
TRIE = (
    "part int, shard int, first binary, last binary, base binary, check binary, turns binary, words binary, "
    "end_state binary, end_n binary, end_least binary, ends array<string>"
)
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
OPEN = "part int, shard int, key binary, parent_key binary, depth long, n long, least long, children long, leaves long, saved long, ends string"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (hexadecimal, of role and text) and words of each turn. Null roles and texts are empty; rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.substring(F.sha2(whole, 256), 1, 2 * DIGEST).alias("digest"), words.alias("words")
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digests of its turns, joined), words: each conversation with the head of the first of its group of twenty.

    Turns of one conversation come in order of ``turn``, null first, equal ones by
    digest. A conversation is one row of 20 bytes a turn; no text is shuffled.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", "words")
    whole = turn_rows(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_own"))
    heads = whole.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("_group"), F.slice("_own", 1, SHARED_HEAD - 1).alias("_head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_HEAD).cast("int")
    joined = whole.join(heads, F.col("conv_id") - F.col("conv_id") % GROUP == F.col("_group"), "left").withColumn("_h", shared)
    head = F.when(F.col("_head").isNull(), F.slice("_own", 1, 0)).otherwise(F.slice("_head", F.lit(1), F.col("_h")))
    turns = F.concat(head, F.slice("_own", F.col("_h") + 1, F.greatest(F.size("_own"), F.lit(1))))
    return joined.withColumn("_turns", turns).select("conv_id", F.unhex(F.array_join("_turns.digest", "")).alias("path"), F.col("_turns.words").alias("words"))


def sequences(conversations: DataFrame) -> DataFrame:
    """The distinct sequences: path, words, n (conversations), least (smallest id), ends (hash of their ids, ascending).

    Ids meet in chunks of at most 256 neighbours, joined before the next shuffle.
    A hash is sequential, so one task reads all chunks of a sequence, in order,
    and keeps only the state of the hash.
    """
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    ids = rebuilt(conversations).withColumn("_key", F.sha2("path", 256)).groupBy("_key", chunk.alias("_chunk")).agg(
        F.first("path").alias("path"), F.first("words").alias("words"), F.sort_array(F.collect_list("conv_id")).alias("_ids")
    )
    listed = ids.select("_key", "_chunk", "path", "words", F.size("_ids").cast("long").alias("n"), F.element_at("_ids", 1).alias("least"), F.array_join(F.col("_ids").cast("array<string>"), ",").alias("list"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.binary()), ("words", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())]))

        for batch in batches:
            for row in batch.to_pylist():
                if row["_key"] != now:
                    if now is not None:
                        out.append(held | {"ends": state.hexdigest()})
                        if len(out) == 1000:
                            yield batch_of(out)
                            out = []
                    now, state = row["_key"], hashlib.sha256(row["list"].encode())
                    held = {"path": row["path"], "words": row["words"], "n": row["n"], "least": row["least"]}
                else:
                    state.update(b"," + row["list"].encode())
                    held["n"] += row["n"]
        if now is not None:
            out.append(held | {"ends": state.hexdigest()})
        yield batch_of(out)

    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "_key").sortWithinPartitions("_key", "_chunk").mapInArrow(join, SEQUENCE)


def pack(parent: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK and the state of each node; node 0 is the root, state 0. CHECK is -1 where no state is.

    Nodes with most children are placed first, each where all its children fall
    on free states; nodes with one child take the states left over.
    """
    nodes = len(parent)
    order = np.lexsort((code[1:], parent[1:])) + 1
    owner = parent[order]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(order)))
    used = np.zeros(max(2 * nodes, 64), bool)
    used[0] = True
    base_of = np.zeros(nodes, np.int64)
    lowest = 1
    for g in np.argsort(-size, kind="stable"):
        if size[g] < 2:
            break
        members = order[first[g] : first[g] + size[g]]
        reach = code[members] - code[members[0]]
        while lowest < len(used) and used[lowest]:
            lowest += 1
        at, found = lowest, -1
        while found < 0:
            if at + reach[-1] + 4096 >= len(used):
                used = np.concatenate((used, np.zeros(max(len(used), int(reach[-1]) + 8192), bool)))
            tries = at + np.flatnonzero(~used[at : at + 4096])
            for step in reach if len(reach) <= 64 else reach[:64]:
                tries = tries[~used[tries + step]]
                if not len(tries):
                    break
            for t in tries if len(reach) > 64 else tries[:1]:
                if not used[t + reach].any():
                    found = int(t)
                    break
            at += 4096
        used[found + reach] = True
        base_of[owner[first[g]]] = found - code[members[0]]
    single = first[size == 1]
    free = np.flatnonzero(~used)
    if len(free) < len(single):
        free = np.concatenate((free, np.arange(len(used), len(used) + len(single) - len(free))))
    places = free[: len(single)]
    base_of[owner[single]] = places - code[order[single]]
    state = np.zeros(nodes, np.int64)
    state[1:] = base_of[parent[1:]] + code[1:]
    top = int(state.max()) + 1
    base, check = np.zeros(top, np.int64), np.full(top, -1, np.int64)
    base[state] = base_of
    check[state[1:]] = state[parent[1:]]
    return base, check, state


def child(base: np.ndarray, check: np.ndarray, state: int, code: int) -> int:
    """The state that a turn leads to, or -1."""
    to = int(base[state]) + code
    return to if 0 < to < len(check) and check[to] == state else -1


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(p, np.uint8)[: n * DIGEST].reshape(n, DIGEST) for p in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


def build(rows: list[dict]) -> dict[str, object]:
    """The trie of sorted distinct sequences."""
    parent, depth, turn, words, ends, stack, before = [0], [0], [b""], [0], [], [0], b""
    for row in rows:
        path = row["path"]
        shared = _common(before, path)
        del stack[shared + 1 :]
        for d in range(shared, len(path) // DIGEST):
            parent.append(stack[-1])
            depth.append(d + 1)
            turn.append(path[d * DIGEST : (d + 1) * DIGEST])
            words.append(row["words"][d])
            stack.append(len(parent) - 1)
        ends.append(stack[-1])
        before = path
    # Dense numbers from 1 in order of depth: turns that follow the same node are close.
    numbers: dict[bytes, int] = {}
    size: list[int] = []
    by_depth = np.lexsort((np.array(parent), np.array(depth)))
    for node in by_depth[1:].tolist():
        if numbers.setdefault(turn[node], len(numbers) + 1) > len(size):
            size.append(words[node])
    code = np.array([numbers.get(t, 0) for t in turn], np.int64)
    base, check, state = pack(np.array(parent, np.int64), code)
    return {
        "first": rows[0]["path"],
        "last": rows[-1]["path"],
        "base": base.astype("<i4").tobytes(),
        "check": check.astype("<i4").tobytes(),
        "turns": b"".join(numbers),
        "words": np.array(size, "<i4").tobytes(),
        "end_state": state[ends].astype("<i4").tobytes(),
        "end_n": np.array([r["n"] for r in rows], "<i8").tobytes(),
        "end_least": np.array([r["least"] for r in rows], "<i8").tobytes(),
        "ends": [r["ends"] for r in rows],
    }


def tries(stored: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Double-array tries of stored sequences: one row a shard, ``shard_turns`` turns or one longer sequence each."""
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, rows, turns = TaskContext.get().partitionId(), 0, [], 0
        kinds = {"part": pa.int32(), "shard": pa.int32(), "ends": pa.list_(pa.string())}
        names = [c.split()[0] for c in TRIE.split(", ")]
        schema = pa.schema([(n, kinds.get(n, pa.binary())) for n in names])
        for batch in batches:
            for row in batch.to_pylist():
                length = len(row["path"]) // DIGEST
                if rows and turns + length > shard_turns:
                    yield pa.RecordBatch.from_pylist([build(rows) | {"part": part, "shard": shard}], schema)
                    shard, rows, turns = shard + 1, [], 0
                rows.append(row)
                turns += length + 1
        if rows:
            yield pa.RecordBatch.from_pylist([build(rows) | {"part": part, "shard": shard}], schema)

    return stored.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(cut, TRIE)


def bordered(shards: DataFrame) -> DataFrame:
    """Each shard with the last path before it and the first path after it.

    Neighbours in one partition are found there; across partitions only the
    outermost paths meet, one row a partition.
    """
    edges = shards.select("part", "shard", "first", "last")
    inside = Window.partitionBy("part").orderBy("shard")
    near = edges.select("part", "shard", F.lag("last").over(inside).alias("_before"), F.lead("first").over(inside).alias("_after"))
    outer = edges.groupBy("part").agg(F.min_by("first", "shard").alias("first"), F.max_by("last", "shard").alias("last"))
    across = Window.orderBy("part")
    far = outer.select("part", F.lag("last").over(across).alias("_part_before"), F.lead("first").over(across).alias("_part_after"))
    found = near.join(far, "part").select("part", "shard", F.coalesce("_before", "_part_before").alias("before"), F.coalesce("_after", "_part_after").alias("after"))
    return shards.join(found, ["part", "shard"])


class Walk:
    """One trie walked from the root: depth, parent, members, children, leaves and savings of every state."""

    def __init__(self, row: dict):
        base, check = np.frombuffer(row["base"], "<i4").astype(np.int64), np.frombuffer(row["check"], "<i4").astype(np.int64)
        self.turns, words = row["turns"], np.concatenate(([0], np.frombuffer(row["words"], "<i4")))
        self.numbers = {self.turns[i : i + DIGEST]: i // DIGEST + 1 for i in range(0, len(self.turns), DIGEST)}
        self.base, self.parent = base, check
        size = len(check)
        order = np.argsort(check, kind="stable")
        order = order[np.searchsorted(check[order], 0) :]
        bounds = np.searchsorted(check[order], np.arange(size + 1))
        levels, level = [np.zeros(1, np.int64)], np.zeros(1, np.int64)
        self.depth = np.full(size, -1, np.int64)
        self.depth[0] = 0
        while True:
            counts = bounds[level + 1] - bounds[level]
            total = int(counts.sum())
            if not total:
                break
            at = np.repeat(bounds[level] - np.cumsum(counts) + counts, counts) + np.arange(total)
            level = order[at]
            self.depth[level] = len(levels)
            levels.append(level)
        self.states = np.concatenate(levels)
        self.code = np.zeros(size, np.int64)
        below = self.states[1:]
        self.code[below] = below - base[check[below]]
        ends = np.frombuffer(row["end_state"], "<i4")
        self.first, self.last = self.path(row["first"]), self.path(row["last"])
        held_before = -1 if row["before"] is None else _common(row["before"], row["first"])
        held_after = -1 if row["after"] is None else _common(row["last"], row["after"])
        self.begun = np.ones(size, bool)
        self.begun[self.first[: held_before + 1]] = False
        self.open = np.zeros(size, bool)
        self.open[self.first[: held_before + 1]] = True
        self.open[self.last[: held_after + 1]] = True
        self.n = np.zeros(size, np.int64)
        self.n[ends] = np.frombuffer(row["end_n"], "<i8")
        self.least = np.full(size, np.iinfo(np.int64).max, np.int64)
        self.least[ends] = np.frombuffer(row["end_least"], "<i8")
        self.children = np.bincount(check[below], weights=self.begun[below], minlength=size).astype(np.int64)
        self.leaves = np.zeros(size, np.int64)
        tips = ends[bounds[ends + 1] == bounds[ends]]
        self.leaves[tips] = 1
        if row["after"] is not None and held_after == len(row["last"]) // DIGEST:
            self.leaves[self.last[-1]] = 0  # goes on in the next shard
        for level in reversed(levels[1:]):
            np.add.at(self.n, check[level], self.n[level])
            np.minimum.at(self.least, check[level], self.least[level])
            np.add.at(self.leaves, check[level], self.leaves[level])
        self.saved = np.zeros(size, np.int64)
        self.saved[self.states] = (self.n[self.states] - self.begun[self.states]) * words[self.code[self.states]]
        for level in reversed(levels[1:]):
            np.add.at(self.saved, check[level], self.saved[level])
        self.ends = dict(zip(ends.tolist(), row["ends"], strict=True))

    def path(self, path: bytes) -> list[int]:
        """The states from the root along a path."""
        states = [0]
        for i in range(0, len(path), DIGEST):
            states.append(child(self.base, self.parent, states[-1], self.numbers[path[i : i + DIGEST]]))
        return states

    def keys(self) -> dict[int, bytes]:
        """Of every open state a name that all shards give it: digests chained along its path."""
        found: dict[int, bytes] = {}
        for states in (self.first, self.last):
            name = b""
            for state in states:
                if not self.open[state]:
                    break
                if state:
                    at = (int(self.code[state]) - 1) * DIGEST
                    name = hashlib.sha256(name + self.turns[at : at + DIGEST]).digest()[:DIGEST]
                found[state] = name
        return found


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Walk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, Walk(row)


def _open_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"part": pa.int32(), "shard": pa.int32(), "key": pa.binary(), "parent_key": pa.binary(), "ends": pa.string()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in OPEN.split(", ")])
    for row, walk in _walks(batches):
        keys = walk.keys()
        out = [
            {
                "part": row["part"],
                "shard": row["shard"],
                "key": key,
                "parent_key": keys[int(walk.parent[s])] if s else None,
                "depth": int(walk.depth[s]),
                "n": int(walk.n[s]),
                "least": int(walk.least[s]),
                "children": int(walk.children[s]),
                "leaves": int(walk.leaves[s]),
                "saved": int(walk.saved[s]),
                "ends": walk.ends.get(s),
            }
            for s, key in keys.items()
        ]
        yield pa.RecordBatch.from_pylist(out, schema)


def _closed_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, walk in _walks(batches):
        least = walk.least.copy()
        known = {bytes(x["key"]): x["least"] for x in row["known"] or []}
        for state, key in walk.keys().items():
            least[state] = known[key]
        own = walk.states[~walk.open[walk.states]]
        parents = pa.array(np.where(own > 0, least[walk.parent[own]], 0), mask=own == 0)
        ends = pa.array([walk.ends.get(s, NOBODY) for s in own.tolist()], pa.string())
        columns = [pa.array(least[own]), pa.array(walk.depth[own]), parents, *[pa.array(x[own]) for x in (walk.n, walk.children, walk.leaves, walk.saved)], ends]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODE.split(", ")])


def trie_nodes(space: Workspace, shards: DataFrame) -> DataFrame:
    """The nodes of stored tries. A shard has at most two open nodes a depth; all shards' are added up by name."""
    walked = space.store(bordered(shards))
    opened = space.store(walked.mapInArrow(_open_nodes, OPEN))
    merged = space.store(
        opened.groupBy("key").agg(
            F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.min("least").alias("least"),
            F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"),
        )
    )
    least = merged.select("key", F.col("least").alias("_least"))
    known = opened.select("part", "shard", "key").join(least, "key").groupBy("part", "shard").agg(F.collect_list(F.struct("key", F.col("_least").alias("least"))).alias("known"))
    closed = walked.join(known, ["part", "shard"], "left").mapInArrow(_closed_nodes, NODE)
    above = least.select(F.col("key").alias("parent_key"), F.col("_least").alias("parent_conv_id"))
    shared = merged.join(above, "parent_key", "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )
    return closed.unionByName(shared)


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty, null turns come first, repeated rows are
    turns of their own. Rows without conv_id belong to no conversation. A
    conversation whose turns all give way to an absent head has none and is a
    member of the root. A long conversation is a deep path; its texts are read
    once, for digest and words. No conversations: no nodes. Other columns are not read.
    """
    spark = conversations.sparkSession
    out = Workspace(spark)
    with Workspace(spark) as space:
        stored = space.store(sequences(conversations))
        return out.store(trie_nodes(space, space.store(tries(stored, shard_turns))))

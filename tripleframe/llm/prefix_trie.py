"""The trie of conversation prefixes, from adaptive radix trees over fixed-width turn ids.

A conversation is the concatenation of its turn ids, 16 big-endian bytes each (a digest of role and text). Conversations with equal
keys are folded into one before anything else. The distinct keys are sorted into ranges; each task builds one adaptive
radix tree over its range: inner nodes grow from 4 to 16, 48 and 256 children, runs of single children are compressed
into a path. Only byte depths at a multiple of 16 are turns and give nodes; a branch inside a turn id gives none.

A node's totals over its subtree are sums of what each range holds, so ranges are merged by adding, with one
correction. Neighbouring ranges may share the first turns of the last key of one and the first key of the other: these
nodes were counted in both, once too often each, and the last key is no leaf if the next key continues it. Every pair of neighbours gives that many
rows of corrections at most, one for each shared depth.

So no task holds the members of a prefix: a first turn that a third of all conversations share spreads over ranges, and
a conversation that is repeated is one key. A key of a conversation, 16 bytes a turn, has to fit a task.

Defined results: null role or text is empty. Turns that tie are ordered by role, then text. Rows without ``conv_id``
belong to no conversation. A conversation without turns belongs to the root only. An empty table has no nodes, not even
a root. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.common import written
from tripleframe.llm.digests import EMPTY, ordered_sha256

ID_BYTES = 16
# Turns that one task's tree may hold: the number of ranges follows the table.
TURNS_PER_RANGE = 250_000


class _Leaf:
    """The end of one key; ``below`` tells whether the key also has longer ones under it."""

    __slots__ = ("key", "n", "least")

    def __init__(self, key: bytes, n: int, least: int) -> None:
        self.key, self.n, self.least = key, n, least


class _Inner:
    """An inner node: the compressed path that leads to it, the key that ends here, and its children by next byte.

    The layout follows the number of children: two short parallel arrays up to 4 and 16, an index of 256 bytes into 48
    slots, then 256 slots.
    """

    __slots__ = ("path", "end", "limit", "bytes", "slots")

    def __init__(self, path: bytes) -> None:
        self.path = path
        self.end: _Leaf | None = None
        self.limit = 4
        self.bytes: bytearray | None = bytearray()
        self.slots: list = []

    def child(self, byte: int):
        if self.limit <= 16:
            at = self.bytes.find(byte)
            return None if at < 0 else self.slots[at]
        if self.limit == 48:
            at = self.bytes[byte]
            return None if at == 255 else self.slots[at]
        return self.slots[byte]

    def put(self, byte: int, node) -> None:
        """Set or replace the child under ``byte``."""
        if self.limit <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.slots[at] = node
                return
            if len(self.slots) == self.limit:
                self._grow()
                self.put(byte, node)
                return
            self.bytes.append(byte)
            self.slots.append(node)
        elif self.limit == 48:
            if self.bytes[byte] == 255:
                if len(self.slots) == 48:
                    self._grow()
                    self.slots[byte] = node
                    return
                self.bytes[byte] = len(self.slots)
                self.slots.append(node)
            else:
                self.slots[self.bytes[byte]] = node
        else:
            self.slots[byte] = node

    def _grow(self) -> None:
        if self.limit == 4:
            self.limit = 16
        elif self.limit == 16:
            index = bytearray(b"\xff" * 256)
            for at, byte in enumerate(self.bytes):
                index[byte] = at
            self.bytes, self.limit = index, 48
        else:
            full: list = [None] * 256
            for byte in range(256):
                if self.bytes[byte] != 255:
                    full[byte] = self.slots[self.bytes[byte]]
            self.bytes, self.slots, self.limit = None, full, 256

    def children(self) -> list:
        return [c for c in self.slots if c is not None]


def _common(a: bytes, b: bytes, start: int) -> int:
    """How many bytes of ``a`` agree with ``b`` from ``start`` on."""
    most = min(len(a), len(b) - start)
    if a[:most] == b[start : start + most]:
        return most
    low, high = 0, most
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[start + low : start + mid] else (low, mid)
    return low


class RadixTree:
    """Keys with how many members each has and the smallest of them."""

    def __init__(self) -> None:
        self.root = _Inner(b"")

    def add(self, key: bytes, n: int, least: int) -> None:
        leaf = _Leaf(key, n, least)
        node, depth = self.root, 0
        while True:
            if depth == len(key):
                node.end = leaf
                return
            byte = key[depth]
            child = node.child(byte)
            if child is None:
                node.put(byte, leaf)
                return
            rest = child.key[depth:] if isinstance(child, _Leaf) else child.path
            shared = _common(rest, key, depth)
            if isinstance(child, _Inner) and shared == len(rest):
                node, depth = child, depth + shared
                continue
            # The paths part, or one key ends on the way: a new inner node takes what they share.
            split = _Inner(rest[:shared])
            node.put(byte, split)
            if isinstance(child, _Leaf):
                if shared == len(rest):
                    split.end = child
                else:
                    split.put(rest[shared], child)
            else:
                child.path = rest[shared:]
                split.put(rest[shared], child)
            node, depth = split, depth + shared

    def walk(self) -> Iterator[tuple]:
        """(node, byte depth at its top, byte depth at its end), children before their parents."""
        stack = [(self.root, 0, False)]
        while stack:
            node, top, seen = stack.pop()
            if isinstance(node, _Leaf):
                yield node, top, len(node.key)
                continue
            if seen:
                yield node, top, top + len(node.path)
                continue
            stack.append((node, top, True))
            stack += [(child, top + len(node.path), False) for child in node.children()]


def _digests(key: bytes, depth: int) -> list[bytes]:
    """Digest of every prefix of a key up to ``depth`` turns; the root's is that of no bytes."""
    hasher = hashlib.blake2b(digest_size=16)
    out = [hasher.digest()]
    for i in range(depth):
        hasher.update(key[i * ID_BYTES : (i + 1) * ID_BYTES])
        out.append(hasher.copy().digest())
    return out


_PART = "kind int, path binary, depth int, parent binary, above long, n long, least long, children long, leaves long, all_bytes long, once long"
_PART_FIELDS = [
    ("kind", pa.int32()), ("path", pa.binary()), ("depth", pa.int32()), ("parent", pa.binary()), ("above", pa.int64()), ("n", pa.int64()),
    ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("all_bytes", pa.int64()), ("once", pa.int64()),
]
_EDGE = ", part long, key binary, sizes array<int>, last boolean"
_EDGE_FIELDS = [("part", pa.int64()), ("key", pa.binary()), ("sizes", pa.list_(pa.int32())), ("last", pa.bool_())]
_SCHEMA = pa.schema(_PART_FIELDS + _EDGE_FIELDS)


def _emit(tree: RadixTree, sizes: dict[bytes, list[int]], edges: list[tuple]) -> Iterator[tuple]:
    """One row for each turn-aligned depth of the tree, then the first and the last key of the range."""
    totals: dict[int, list] = {}
    rows: list[tuple] = []
    least_of: dict[bytes, int] = {}
    for node, top, bottom in tree.walk():
        if isinstance(node, _Leaf):
            n, least, children, leaves, all_bytes, once = node.n, node.least, 0, 1, 0, 0
            sample = node.key
        else:
            below = [totals.pop(id(c)) for c in node.children()]
            ends = [node.end] if node.end is not None else []
            n = sum(b[0] for b in below) + sum(e.n for e in ends)
            leasts = [b[1] for b in below] + [e.least for e in ends]
            if not leasts:
                return
            least = min(leasts)
            children, leaves, all_bytes, once = (sum(b[i] for b in below) for i in (2, 3, 4, 5))
            sample = ends[0].key if ends else below[0][6]
            leaves = leaves or 1  # a key that ends here with nothing under it
        # Every turn that ends on the way from the top of this edge to its bottom is a node of the trie.
        first, last = top // ID_BYTES + 1, bottom // ID_BYTES
        if node is tree.root:
            first = 0
        if first <= last:
            digests = _digests(sample, last)
            for depth in range(last, first - 1, -1):
                if depth:
                    size = sizes[sample][depth - 1]
                    all_bytes, once = all_bytes + n * size, once + size
                least_of[digests[depth]] = least
                parent = digests[depth - 1] if depth else None
                rows.append((digests[depth], depth, parent, n, least, children, leaves, all_bytes, once))
                children = 1
        # What the edge hands up: under a branch inside a turn id the children are those of all its branches.
        handed = 1 if first <= last else children
        totals[id(node)] = [n, least, handed, leaves, all_bytes, once, sample]
    for path, depth, parent, *values in rows:
        yield 0, path, depth, parent, least_of.get(parent), *values, None, None, None, None
    for part, key, last in edges:
        yield 1, *10 * (None,), part, key, sizes[key], last


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, sizes, part, first, key = RadixTree(), {}, None, None, None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("part", "key", "sizes", "n", "least"))
        for part, key, lengths, n, least in zip(*columns, strict=True):
            tree.add(key, n, least)
            sizes[key] = lengths
            first = key if first is None else first
    if first is None:
        return
    rows = _emit(tree, sizes, [(part, first, False), (part, key, True)])
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA
    )


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key of one range's end, key and sizes of the next range's start) -> what the two counted twice."""
    for batch in batches:
        rows = []
        for last, key, sizes in zip(*(batch.column(c).to_pylist() for c in ("last_key", "key", "sizes")), strict=True):
            shared = _common(last, key, 0) // ID_BYTES
            digests = _digests(key, shared)
            continued = shared * ID_BYTES == len(last)
            once = 0
            for depth in range(shared, -1, -1):
                once += sizes[depth - 1] if depth else 0
                parent, children = (digests[depth - 1] if depth else None), -1 if depth < shared else 0
                rows.append((0, digests[depth], depth, parent, None, 0, None, children, -int(continued), 0, -once) + 4 * (None,))
        if rows:
            yield _batch(rows)


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes for a turn."""
    return F.unhex(F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text)))


def nodes(keys: DataFrame) -> DataFrame:
    """The trie of (conv_id, key, sizes): turn ids and the bytes of each turn's text, one row for each conversation.

    Returns path (the digest of the node's prefix), depth, parent, conv_id (smallest member), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.
    """
    marked = keys.select("conv_id", "key", "sizes", F.unhex(F.md5("key")).alias("end"))
    marked = written(marked)
    # Members that end at a key, in pieces of neighbouring ids, so that a hot key has few rows to hash.
    piece = F.shiftright("conv_id", 12)
    pieces = (
        marked.groupBy("end", piece.alias("piece"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select(
            "end", "piece", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("least"),
            F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"),
        )
    )
    pieces = written(pieces)
    ends = ordered_sha256(pieces, "end", "piece", "text", ",")
    counts = pieces.groupBy("end").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    texts = marked.groupBy("end").agg(F.max(F.struct("key", "sizes")).alias("one")).select("end", "one.*")
    distinct = written(texts.join(counts, "end"))
    turns = distinct.agg(F.sum(F.size("sizes") + 1)).first()[0] or 1
    ranged = distinct.repartitionByRange(-(-turns // TURNS_PER_RANGE), "key").sortWithinPartitions("key")
    tree = written(
        ranged.select(F.spark_partition_id().cast("long").alias("part"), "key", "sizes", "n", "least").mapInArrow(_trees, _PART + _EDGE)
    )
    parts = tree.filter("kind = 0").select(*[c for c, _ in _PART_FIELDS])
    # Two rows for each range at most, so one task orders them.
    neighbours = (
        tree.filter("kind = 1")
        .withColumn("last_key", F.expr("lag(key) OVER (ORDER BY part, last)"))
        .filter("NOT last AND last_key IS NOT NULL")
        .select("last_key", "key", "sizes")
    )
    twice = neighbours.mapInArrow(_corrections, _PART + _EDGE).select(*[c for c, _ in _PART_FIELDS])
    merged = written(
        parts.unionByName(twice)
        .groupBy("path", "depth", "parent")
        .agg(
            *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "all_bytes", "once")],
            *[F.min(c).alias(c) for c in ("least", "above")],
            F.count("least").alias("ranges"),
        )
    )
    last = texts.join(ends, F.col("end") == F.col("k")).mapInArrow(_paths, "p binary, sha256 string")
    found = merged.join(last, F.col("path") == F.col("p"), "left")
    # A parent that lies in one range told its children its smallest member there. Those in several are few: the ends of ranges.
    split = written(merged.filter("ranges > 1").select(F.col("path").alias("q"), F.col("least").alias("parent_least")))
    joined = found.join(split, F.col("parent") == F.col("q"), "left")
    return joined.select(
        "path",
        "parent",
        F.col("least").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.coalesce("parent_least", "above").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("all_bytes") - F.col("once")).alias("saved_tokens"),
        F.coalesce("sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_pylist()
        paths = [hashlib.blake2b(k, digest_size=16).digest() for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), batch.column("sha256")], names=["p", "sha256"])


def turn_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, key, sizes) of rows (conv_id, at, id, size), ordered by ``at``; ``id`` null stands for no turn."""
    some = F.filter(F.array_sort(F.collect_list(F.struct("at", "id", "size"))), lambda t: t["id"].isNotNull())
    return turns.groupBy("conv_id").agg(some.alias("t")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["id"])), "")).alias("key"),
        F.col("t.size").alias("sizes"),
    )

"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn is the 16-byte digest of its (role, text), a conversation the
concatenation of its turns' ids. Equal conversations are counted before the
shuffle; the distinct keys are range partitioned and sorted, so that all keys under one
prefix lie side by side, however many there are. A task reads its range in chunks of a
fixed number of keys and inserts each chunk into one adaptive radix tree (node layouts of
4, 16, 48 and 256 children, compressed paths). Walking the tree in key order, only the byte
depths that are multiples of the id width are trie nodes.

A node off the paths of its chunk's first and last key lies in that chunk alone and
is finished there (closed). The nodes on these two paths may go on in a
neighbour (open): their parts are added up by node, and the sums over their
subtrees are folded from the deepest level up. There are at most two paths a
chunk, so that this last step reads a number of rows set by chunks times depth, not by conversations.

A conversation's key is one value of 16 bytes a turn (2 GB hold 134 million turns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import materialize, require, text_of

WIDTH = 16
LENGTH_BYTES = 8
CHUNK_KEYS = 50_000
#: The node of no turns.
ROOT = hashlib.md5(b"").digest()


# ------------------------------------------------------------------ the adaptive radix tree

class Node:
    """An inner node with a compressed path; ``value`` belongs to the key that ends here.

    Up to 16 children: sorted bytes beside a list. Up to 48: a 256-entry index into
    a list. Beyond: 256 places. ``layout`` names the present form.
    """

    __slots__ = ("path", "value", "layout", "bytes", "children")
    GROWN = {4: 16, 16: 48, 48: 256}

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.layout = path, value, 4
        self.bytes, self.children = bytearray(), []

    def child(self, byte: int):
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, child) -> None:
        """Set the child under a byte, growing to the next layout when this one is full."""
        if self.layout <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.children[at] = child
                return
            if len(self.children) < self.layout:
                at = next((i for i, b in enumerate(self.bytes) if b > byte), len(self.bytes))
                self.bytes.insert(at, byte)
                self.children.insert(at, child)
                return
        elif self.layout == 48:
            at = self.bytes[byte]
            if at:
                self.children[at - 1] = child
                return
            if len(self.children) < 48:
                self.children.append(child)
                self.bytes[byte] = len(self.children)
                return
        else:
            self.children[byte] = child
            return
        self.grow()
        self.put(byte, child)

    def grow(self) -> None:
        held = list(self.items())
        self.layout = self.GROWN[self.layout]
        if self.layout == 48:
            self.bytes, self.children = bytearray(256), [c for _, c in held]
            for at, (byte, _) in enumerate(held):
                self.bytes[byte] = at + 1
        elif self.layout == 256:
            self.bytes, self.children = bytearray(), [None] * 256
            for byte, child in held:
                self.children[byte] = child

    def items(self):
        """(byte, child) in byte order."""
        if self.layout <= 16:
            return zip(self.bytes, self.children)
        if self.layout == 48:
            return ((b, self.children[at - 1]) for b, at in enumerate(self.bytes) if at)
        return ((b, c) for b, c in enumerate(self.children) if c is not None)


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTree:
    """Adaptive radix tree; a key may be a prefix of another. ``insert`` keeps the last value of a key."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, depth, above = self.root, 0, None
        while True:
            same = shared(node.path, key[depth:depth + len(node.path)])
            if same < len(node.path):  # the path parts within this node
                fork = Node(node.path[:same])
                byte, node.path = node.path[same], node.path[same + 1:]
                fork.put(byte, node)
                above[0].put(above[1], fork)
                node = fork
            depth += same
            if depth == len(key):
                node.value = value
                return
            byte, depth = key[depth], depth + 1
            below = node.child(byte)
            if below is None:
                node.put(byte, Node(key[depth:], value))
                return
            above, node = (node, byte), below

    def walk(self) -> Iterator[tuple[int, bytes, object]]:
        """(bytes shared with the node above, whole path, value or None) of every node, in key order."""
        stack = [(self.root, 0, self.root.path)]
        while stack:
            node, kept, key = stack.pop()
            yield kept, key, node.value
            if node.layout <= 16:
                stack.extend((child, len(key), key + bytes((byte,)) + child.path)
                             for byte, child in zip(reversed(node.bytes), reversed(node.children)))
            else:
                stack.extend((child, len(key), key + bytes((byte,)) + child.path)
                             for byte, child in reversed(list(node.items())))


# ------------------------------------------------------------------ trie nodes of one chunk

class Level:
    """A trie node while the walk is below it."""

    __slots__ = ("hash", "node", "conv", "convs", "children", "leaves", "saved", "length", "open", "kids")

    def __init__(self, hash_):
        self.hash, self.node = hash_, hash_.digest()
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.length, self.open, self.kids = 0, False, []

    def add(self, conv: int, convs: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += convs


PARTS = ("node binary, depth long, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, length long, open boolean")
COLUMNS = [c.split()[0] for c in PARTS.split(", ")]


def chunk_nodes(tree: RadixTree) -> Iterator[tuple]:
    """The trie nodes of one chunk's tree as ``PARTS`` rows: turn-aligned byte depths only.

    Closed nodes are whole. Open ones hold this chunk's part: conversations, and the
    number, leaves and savings of their closed children. ``parent_conv_id`` is NULL below an open node.
    """
    levels: list[Level] = []
    first = True

    def close() -> Iterator[tuple]:
        level, depth = levels.pop(), len(levels)
        above = levels[-1] if levels else None
        conv = None if level.open else level.conv
        for kid in level.kids:
            yield (*kid[:4], conv, *kid[4:])
        if above is not None:
            above.add(level.conv, level.convs)
        parent = above.node if above is not None else None
        if level.open:
            yield (level.node, depth, parent, level.conv, None, level.convs, level.children, level.leaves, level.saved,
                   level.length, True)
            return
        leaves = level.leaves if level.children else 1
        saved = level.saved + (level.convs - 1) * level.length
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        above.kids.append((level.node, depth, parent, level.conv, level.convs, level.children, leaves, saved, level.length, False))

    for kept, key, value in tree.walk():
        while len(levels) > kept // WIDTH + 1:
            yield from close()
        for depth in range(len(levels), len(key) // WIDTH + 1):
            digest = levels[-1].hash.copy() if levels else hashlib.md5()
            if depth:
                digest.update(key[(depth - 1) * WIDTH:depth * WIDTH])
            levels.append(Level(digest))
        if value is None:
            continue
        conv, convs, lengths = value
        levels[-1].add(conv, convs)
        for depth in range(len(levels) - 1, 0, -1):
            if levels[depth].length:
                break
            levels[depth].length = int.from_bytes(lengths[(depth - 1) * LENGTH_BYTES:depth * LENGTH_BYTES], "big")
        if first:
            first = False
            for level in levels:
                level.open = True
    for level in levels:
        level.open = True
    while levels:
        yield from close()


def _nodes_of_range(chunk_keys: int):
    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted distinct keys of one range, a chunk at a time."""
        tree, held = RadixTree(), 0
        for batch in batches:
            for key, conv, convs, lengths in zip(batch["key"], batch["conv_id"], batch["n_convs"], batch["lengths"]):
                tree.insert(key, (conv, convs, lengths))
                held += 1
                if held >= chunk_keys:
                    yield from _frames(chunk_nodes(tree))
                    tree, held = RadixTree(), 0
        if held:
            yield from _frames(chunk_nodes(tree))
    return nodes


def _frames(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pd.DataFrame]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield _frame(part)
            part = []
    if part:
        yield _frame(part)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
    whole = {c: "int64" for c in COLUMNS if c.startswith("n_") or c in ("depth", "conv_id", "saved_tokens", "length")}
    return frame.astype(whole | {"parent_conv_id": "Int64", "open": bool})


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open nodes (merged, one row each): sums over their subtrees, from the deepest level up."""
    rows = [row for batch in batches for row in batch.itertuples(index=False)]
    rows.sort(key=lambda r: r.depth, reverse=True)
    conv_of = {r.node: r.conv_id for r in rows}
    below: dict[bytes, list[int]] = {}
    out = []
    for r in rows:
        children, leaves, saved = below.pop(r.node, (0, 0, 0))
        children += r.n_children
        leaves = leaves + r.n_leaves if children else 1
        saved += r.saved_tokens + (r.n_convs - 1) * r.length
        if r.parent is not None:
            sums = below.setdefault(r.parent, [0, 0, 0])
            sums[0] += 1
            sums[1] += leaves
            sums[2] += saved
        out.append((r.node, r.depth, r.parent, r.conv_id, conv_of.get(r.parent), r.n_convs, children, leaves, saved, r.length, True))
    yield from _frames(iter(out))


# ------------------------------------------------------------------ over Spark

def turn_id(role: str | Column, text: str | Column) -> Column:
    """The 16-byte id of a turn (NULL role or text: empty)."""
    r, t = text_of(role), text_of(text)
    whole = F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * WIDTH))


def conversation_keys(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, key, lengths) of every conversation: its turn ids and the code points of its texts, in turn order.

    Turns are ordered by ``turn`` (NULL first), ties by role, then text (by its first 64
    code points, then by id); repeated rows are turns of their own. Rows without a
    conversation id belong to none. Texts do not travel: a row is reduced to its id before the shuffle.
    """
    require(turns, id_col, "turn", "role", "text")
    role, text = text_of("role"), text_of("text")
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.substring(text, 1, 64).alias("head"), turn_id("role", "text").alias("id"),
        F.char_length(text).cast("long").alias("length"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "head", "id"]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, ids, lengths = None, [], []

        def done():
            return pd.DataFrame({"conv_id": [conv], "key": [b"".join(ids)], "lengths": [b"".join(lengths)]})

        for batch in batches:
            convs = batch["conv_id"].to_numpy()
            cuts = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), len(convs)]
            packed = batch["length"].to_numpy().astype(">i8").tobytes()
            keys = batch["id"].tolist()
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if conv is not None and convs[a] != conv:
                    out.append((conv, b"".join(ids), b"".join(lengths)))
                    ids, lengths = [], []
                conv = int(convs[a])
                ids.append(b"".join(keys[a:b]))
                lengths.append(packed[a * LENGTH_BYTES:b * LENGTH_BYTES])
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "key", "lengths"])
        if conv is not None:
            yield done()

    return (rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "id", "length")
            .mapInPandas(join, "conv_id long, key binary, lengths binary"))


def first_turns(column: str, turns: Column, width: int) -> Column:
    return F.substring(F.col(column), F.lit(1), turns * width)


def later_turns(column: str, turns: Column, width: int) -> Column:
    return F.substring(F.col(column), turns * width + 1, F.length(F.col(column)))


def with_shared_heads(keys: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin like the first of their family.

    The first h turns of conversation c come from c - c % ``family`` (all of its turns if it has
    fewer, none if there is no such conversation), the others are c's own after its first h; h is the
    unsigned crc32 of the decimal c, modulo ``most``.
    """
    heads = keys.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("donor"), F.substring("key", 1, most * WIDTH).alias("head"),
        F.substring("lengths", 1, most * LENGTH_BYTES).alias("head_lengths"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = keys.withColumns({"h": taken, "donor": F.col("conv_id") - F.col("conv_id") % family}).join(heads, "donor", "left")
    none, h = F.expr("X''"), F.col("h")
    return joined.select(
        "conv_id", F.concat(F.coalesce(first_turns("head", h, WIDTH), none), later_turns("key", h, WIDTH)).alias("key"),
        F.concat(F.coalesce(first_turns("head_lengths", h, LENGTH_BYTES), none),
                 later_turns("lengths", h, LENGTH_BYTES)).alias("lengths"))


def members(keys: DataFrame) -> DataFrame:
    """(conv_id, node): the node at which each conversation ends."""
    return keys.select("conv_id", F.unhex(F.md5("key")).alias("node"))


def trie(keys: DataFrame, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """One row per node of the trie over ``conversation_keys``: (node, conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens).

    ``conv_id`` is the smallest member, ``n_leaves`` the childless nodes of the subtree,
    ``saved_tokens`` the sum over it of (members - 1) times the code points of the node's
    last text. Repeated conversation ids count once each. An empty table gives no rows.
    """
    distinct = materialize(
        keys.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                F.min("lengths").alias("lengths")), "trie-keys")
    # Keys that agree in their first 64 turns stay in one range; a range is read in chunks.
    ranged = (distinct.repartitionByRange(F.substring("key", 1, 64 * WIDTH)).sortWithinPartitions("key")
              .select("key", "conv_id", "n_convs", "lengths"))
    parts = materialize(ranged.mapInPandas(_nodes_of_range(chunk_keys), PARTS), "trie-parts")
    merged = (parts.filter("open").groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.first("length").alias("length"), F.lit(True).alias("open")))
    opened = materialize(merged.repartition(1).mapInPandas(_fold, PARTS), "trie-open")
    closed = parts.filter("not open")
    salts = 16
    parents = opened.select(F.col("node").alias("parent"), F.col("conv_id").alias("open_conv"),
                            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    under = (closed.filter("parent_conv_id is null")
             .withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
             .join(parents, ["parent", "salt"]).withColumn("parent_conv_id", F.col("open_conv")))
    out = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return (opened.select(*out).union(closed.filter("parent_conv_id is not null").select(*out)).union(under.select(*out)))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the decimal ids of the conversations that end at a node, ascending, comma-joined.

    A node's ids pass through one task in order, eight bytes each, as the digest demands; none are held.
    """
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for batch in batches:
            out = []
            for key, conv in zip(batch["node"], batch["conv_id"]):
                if key != node:
                    if sha is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(b",%d" % conv)
            if out:
                yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if sha is not None:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])

    return (ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
            .mapInPandas(digest, "node binary, ends_sha256 string"))


def trie_with_ends(keys: DataFrame) -> DataFrame:
    """``trie`` with ``ends_sha256`` (no conversation ends there: the digest of the empty string)."""
    ends = ends_digest(members(keys))
    nothing = hashlib.sha256(b"").hexdigest()
    return (trie(keys).join(ends, "node", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


# CRC-32 bit by bit (polynomial 0xEDB88320) over the bytes of a decimal number.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
  list_transform(string_split(cast(c.conv_id as varchar), ''), lambda x: ascii(x)::bigint)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)))"""

ORACLE = f"""
with own as (
  select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
                       order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as seq
  from conversations where conv_id is not null group by conv_id),
rebuilt as (
  select c.conv_id, list_concat(coalesce(list_slice(d.seq, 1, c.h), []), list_slice(c.seq, c.h + 1, len(c.seq))) as seq
  from (select conv_id, seq, {_CRC} % 6 as h from own c) c left join own d on d.conv_id = c.conv_id - c.conv_id % 100),
prefix as (
  select conv_id, d, list_slice(seq, 1, d) as p, len(seq) = d as last
  from (select conv_id, seq, unnest(range(0, len(seq) + 1)) as d from rebuilt)),
node as (
  select p, d, min(conv_id) as conv_id, count(*) as n_convs,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '') as ends,
         (count(*) - 1) * case when d = 0 then 0 else length(p[d].t) end as own_saved
  from prefix group by p, d),
child as (
  select list_slice(p, 1, d - 1) as p, d - 1 as d, count(*) as n from node where d > 0 group by all),
counted as (
  select node.*, coalesce(child.n, 0) as n_children from node left join child on child.p = node.p and child.d = node.d),
above as (
  select list_slice(p, 1, a) as p, a as d, own_saved, n_children
  from (select *, unnest(range(0, d + 1)) as a from counted)),
subtree as (
  select p, d, count(*) filter (n_children = 0) as n_leaves, sum(own_saved) as saved from above group by p, d)
select n.conv_id, n.d as depth, q.conv_id::double as parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       s.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from counted n join subtree s on s.p = n.p and s.d = n.d
left join counted q on q.d = n.d - 1 and q.p = list_slice(n.p, 1, n.d - 1)
"""

"""Prefix trie: the radix tree, brute force over prefixes, chunk and range edges, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from oracle_compare import duck
from revlens.llm import prefix_trie as pt
from revlens.llm import queries
from revlens.llm.common import materialize

ROWS = "conv_id long, turn long, role string, text string"


def sequences(rows, shared=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, v in own.items()}
    if not shared:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def corpus(rng, convs, first=0):
    """Few different turns, so that prefixes are shared; every third conversation starts with one hot turn."""
    rows = []
    for c in range(first, first + convs):
        n = rng.randrange(1, 7)
        for t in range(n):
            text = "hot" if t == 0 and c % 3 == 0 else rng.choice(["a", "bb", "ccc", "", "é😀"])
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "user", text))
    return rows


def test_radix_tree_layouts_and_paths():
    rng = random.Random(1)
    for width, n in ((1, 200), (2, 400), (3, 3000)):
        keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(width + 1))) for _ in range(n)}
        keys |= {b"same long path" + k for k in list(keys)[:50]}
        tree = pt.RadixTree()
        for k in rng.sample(sorted(keys), len(keys)):
            tree.insert(k, k)
        found = [(key, value) for _, key, value in tree.walk() if value is not None]
        assert found == [(k, k) for k in sorted(keys)]
    layouts, todo = set(), [tree.root]
    while todo:
        node = todo.pop()
        layouts.add(node.layout)
        todo += [c for _, c in node.items()]
    assert layouts == {4, 16, 48, 256}


def test_node_layouts_grow_and_keep_order():
    node = pt.Node(b"")
    order = random.Random(2).sample(range(256), 256)
    seen = []
    for i, byte in enumerate(order):
        node.put(byte, byte)
        seen.append(node.layout)
        assert [b for b, _ in node.items()] == sorted(order[:i + 1])
        assert node.child(byte) == byte
    assert [seen[3], seen[4], seen[15], seen[16], seen[47], seen[48]] == [4, 16, 16, 48, 48, 256]
    node.put(7, "again")
    assert node.child(7) == "again" and pt.Node(b"").child(3) is None


@pytest.mark.parametrize("chunk", [1, 2, 7, 50_000])
def test_trie_equals_brute_force_whatever_the_chunks(spark, chunk):
    rows = corpus(random.Random(chunk), 230)
    keys = materialize(pt.conversation_keys(spark.createDataFrame(rows, ROWS)), "test-keys")
    found = pt.trie(keys, chunk_keys=chunk).join(pt.ends_digest(pt.members(keys)), "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(found.fillna({"ends_sha256": nothing})) == brute(sequences(rows, shared=False))


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in duck(SF_SMALL).execute("select conv_id, turn, role, text from conversations").fetchall()]
    assert got(queries.op13_prefix_trie(spark, SF_SMALL)) == brute(sequences(rows))


def test_shared_heads_odd_rows_and_clashing_columns(spark):
    rows = corpus(random.Random(5), 60, 80) + corpus(random.Random(6), 30, 290)
    rows += [(0, None, None, None), (0, 3, "user", "x"), (0, 3, "user", "x"), (0, 3, "user", "w"), (1, 0, "u", "long " * 40_000),
             (None, 0, "user", "no id"), (5, 0, None, ""), (5, 0, "", None), (6, -1, "a", "neg"), (6, None, "a", "b\x00c"),
             (2 ** 60 + 1, 1, "user", "big"), (7, 0, "user:", "x"), (8, 0, "user", ":x")]
    frame = spark.createDataFrame(rows, ROWS)
    for c in ("key", "lengths", "node", "h", "donor", "head", "head_lengths", "id", "length", "salt", "depth"):
        frame = frame.withColumn(c, F.lit("clash"))
    keys = materialize(pt.with_shared_heads(materialize(pt.conversation_keys(frame), "test-own")), "test-rebuilt")
    assert got(pt.trie_with_ends(keys)) == brute(sequences(rows))


def test_empty_table_and_turnless_conversations(spark):
    none = spark.createDataFrame([], ROWS)
    assert got(pt.trie_with_ends(pt.with_shared_heads(pt.conversation_keys(none)))) == []
    lone = [(c, 0, "user", "x") for c in range(1, 60)]  # without a first of the family, most lose all turns
    keys = materialize(pt.with_shared_heads(pt.conversation_keys(spark.createDataFrame(lone, ROWS))), "test-lone")
    assert keys.filter(F.length("key") == 0).count() > 0
    assert got(pt.trie_with_ends(keys)) == brute(sequences(lone))

"""The training-data operators on small frames: brute force, edge cases, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL
from revlens.llm import (ann, common, fingerprints, language, mixing, packing, quality, queries, simhash, toxicity,
                         url_reputation, warc)
from revlens.sources.tables import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{i % 4 if i is not None else 0}", len(t or "")) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one two"), (6, "x" * 5000), (7, "*** !!! 123"),
       (8, "one two"), (8, "one two"), (None, "no id here at all today"), (9, "é\u2028ß \u00a0 z"),
       (10, "long " * 30_000), (11, "a\x00b c")]


@pytest.fixture(scope="module")
def odd(spark):
    # Columns whose names clash with those that the operators use inside.
    return (docs_frame(spark, ODD).withColumns({c: F.lit("clash") for c in (
        "fp", "id", "block", "bucket", "rank", "length", "start", "score", "hash", "node", "root", "tokens", "pieces",
        "component_id", "sequence_id", "place", "halo", "mix", "epochs", "rest", "odds", "s")}))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ helpers

def test_connected_components_match_union_find(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3), (7, None)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    mine, theirs = defaultdict(set), defaultdict(set)
    for r in got:
        mine[r["root"]].add(r["node"])
    for x in list(parent):
        theirs[find(x)].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ simhash

def slow_simhash(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_definition(spark):
    for _, text in ODD:
        if len(text or "") < 10_000:
            assert simhash.simhash(text) == slow_simhash(text)
    row = spark.sql("select xxhash64('one two three') h").first()
    assert simhash.simhash("One  two\nthree") == row["h"] % (1 << 64)


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("bucket", [2, 1000])
def test_simhash_links_connect_exactly_the_close_fingerprints(spark, distance, bucket):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(40)}
    fps |= {rng.getrandbits(64) for _ in range(50)} | {0, 1 << 63, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in common.connected_components(simhash.links(frame, distance, bucket)).collect()}
    group = {f: roots.get(f, f) for f in signed}
    near = [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) % (1 << 64)).count("1") <= distance]
    assert all(group[a] == group[b] for a, b in near)
    part = {f: f for f in signed}
    for _ in range(len(signed)):
        changed = False
        for a, b in near:
            low = min(part[a], part[b])
            changed |= part[a] != low or part[b] != low
            part[a] = part[b] = low
        if not changed:
            break
    assert len(set(group.values())) == len(set(part.values()))
    for a, b in simhash.links(frame, distance, bucket).collect():
        assert bin((a ^ b) % (1 << 64)).count("1") <= max(distance, 1)


def test_near_duplicates_edges(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[8] == 5 and by[4] == 4
    assert simhash.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd.drop("text"))


# ------------------------------------------------------------------ packing

def test_encoder_equals_tokenizers_on_every_character():
    enc = packing.Encoder(*packing.tokenizer_paths())
    rng = random.Random(0)
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + [0xFEFF, 0xFFFD, 0x1F600, 0x2028, 0x2029, 0x10FFFF]
    texts = [f"ab{chr(c)}cd {chr(c)} e{chr(c)}{chr(c)} {chr(c)}f 12{chr(c)}3" for c in points]
    texts += ["".join(rng.choice(" ab'sT1.,\n\t!é") for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["x <|endoftext|> y", "<|endoftext|>", " a", "a ", "a  b", "I'll we've 'd", "\r\n"]
    for t in texts:
        want = np.array(enc.whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert enc.encode(t) == want, ascii(t)


def test_encoder_groups_and_sections_equal_tokenizers(monkeypatch):
    enc = packing.Encoder(*packing.tokenizer_paths())
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "12", "'s", "!", "..", packing.END_TEXT, "\u3000", "\x1c", "\u0301", "日本",
            "word", "\u00a0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(1000)]
    texts += ["", "a" * 20_000, "x " + "é" * 5000 + " z", " " * 3000 + "b", "\n\n".join(["foo bar"] * 50)]
    want = [enc.whole.encode(t, add_special_tokens=False).ids for t in texts]
    for chars in (1, 7, 1 << 20):  # long texts go by sections, short ones share a group
        monkeypatch.setattr(packing, "_GROUP_CHARS", chars)
        got = [ids.tolist() for ids in enc.encode_all(texts)]
        assert got == want
    assert list(enc.encode_all([])) == []


def test_shortest_pack_first_places_everything():
    rng = random.Random(1)
    for top in (8, 64, 1024):
        hist = {rng.randint(1, top): rng.randint(1, 50) for _ in range(40)}
        patterns = packing.shortest_pack_first(hist, top)
        used = defaultdict(int)
        for n, pack in patterns:
            assert n > 0 and sum(pack) <= top and list(pack) == sorted(pack, reverse=True)
            for x in pack:
                used[x] += n
        assert dict(used) == hist
    # The plain algorithm, item by item: each to the open pack with most room.
    hist = {5: 4, 3: 7, 2: 9, 1: 3}
    packs = []
    for length in sorted(hist, reverse=True):
        for _ in range(hist[length]):
            best = min((p for p in packs if sum(p) + length <= 8), key=sum, default=None)
            if best is None:
                packs.append([length])
            else:
                best.append(length)
    mine = sorted(sum(p) for n, p in packing.shortest_pack_first(hist, 8) for _ in range(n))
    assert mine == sorted(map(sum, packs))
    assert packing.shortest_pack_first({}, 8) == []
    with pytest.raises(ValueError):
        packing.shortest_pack_first({9: 1}, 8)


def check_packing(rows, texts, max_len):
    enc = packing.Encoder(*packing.tokenizer_paths())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= max_len
    assert sorted(sequences) == list(range(len(sequences)))
    for doc, text in texts:
        ids = enc.encode(text or "") + b"\0\0\0\0"
        copies = sum(d == doc for d, _ in texts)
        want = [(s, min(max_len, len(ids) // 4 - s), zlib.crc32(ids[4 * s:4 * (s + max_len)]), len(ids) // 4)
                for s in range(0, len(ids) // 4, max_len)] * copies
        assert sorted(pieces[doc]) == sorted(want)


def test_pack_edges(spark, odd, empty):
    check_packing(packing.pack(odd, max_len=64).collect(), ODD, 64)
    assert packing.pack(empty).count() == 0
    same = docs_frame(spark, [(i, "one two three") for i in range(300)])  # one length holds all rows
    check_packing(packing.pack(same, max_len=16).collect(), [(i, "one two three") for i in range(300)], 16)


# ------------------------------------------------------------- fingerprints

def slow_shingle_hashes(text, width=fingerprints.WIDTH):
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31
    w = text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    byte = [mix((b + 1) * 0x9E3779B97F4A7C15 & mask) for b in range(256)]
    hashed = [mix((sum(byte[c] * pow(0xD1342543DE82EF95, i, 1 << 64) for i, c in enumerate(x)) + len(x)) & mask) for x in w]
    groups = [hashed[i:i + width] for i in range(len(w) - width + 1)] or ([hashed] if w else [])
    return [mix((sum(h * pow(0xDA942042E4DD58B5, k, 1 << 64) for k, h in enumerate(g)) + len(g) * 0x9E3779B97F4A7C15) & mask)
            for g in groups]


def test_shingle_hashes_match_plain_arithmetic():
    rng = random.Random(5)
    texts = ["", " ", "one", "One two", words(rng, 5), words(rng, 40), "a  b\tc\nd e f", "é ß ü ö ä"]
    got, owner = fingerprints.shingle_hashes([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert got[owner == k].tolist() == slow_shingle_hashes(t)


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_fingerprint_likeness_follows_resemblance(bits):
    rng = random.Random(bits)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(1200)]
    errors = []
    for keep in (0, 200, 600, 900, 1200):
        other = base[:keep] + [f"v{rng.randrange(10 ** 6)}" for _ in range(1200 - keep)]
        a, b = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (base, other))
        p, q = fingerprints.fingerprints([" ".join(base), " ".join(other)], bits=bits)
        errors.append(abs(fingerprints.likeness(p, q, bits=bits) - len(a & b) / len(a | b)))
        assert len(p) == 256 * bits // 8
    assert max(errors) < (0.15 if bits == 1 else 0.1)


def test_densified_bins_come_from_full_ones():
    values = np.full((2, 16), fingerprints._EMPTY, dtype=np.uint64)
    values[0, 3], values[0, 9] = 7, 8
    out = fingerprints.densify(values)
    assert set(out[0].tolist()) == {7, 8} and out[0, 3] == 7 and (out[1] == fingerprints._EMPTY).all()


def test_compare_with_edited_edges(spark, odd, empty):
    got = fingerprints.compare_with_edited(odd).collect()
    assert len(got) == len(ODD)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    by = {r["doc_id"]: r for r in got}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        if doc == 8:
            continue
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = by[doc]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        assert bytes.fromhex(r["fingerprint"]) == fingerprints.fingerprints([text])[0]
        assert bytes.fromhex(r["edited_fingerprint"]) == fingerprints.fingerprints([edited])[0]
    assert fingerprints.compare_with_edited(empty).count() == 0
    one = fingerprints.compare_with_edited(docs_frame(spark, [(5, "a b c d e f g h")])).first()
    assert one["near_next"] == 1.0
    many = docs_frame(spark, [(i * 37 % 1009, f"t{i} " + "x y z " * (i % 7)) for i in range(500)])
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_edited(many).collect()}
    texts = dict(many.select("doc_id", "text").collect())
    ids = sorted(texts)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[a]) // 2
        want = texts[a][:len(texts[a]) - half] + texts[b][:half]
        assert rows[a]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()


# ------------------------------------------------------------------ language

def toy_language(rng, lang, n):
    parts = {"xx": ["ba", "be", "lo", "mi"], "yy": ["stra", "cht", "ung", "zw"], "zz": ["éa", "oué", "ñi", "ção"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_learns_held_out_texts(spark, empty):
    rng = random.Random(2)
    rows = [(i, toy_language(rng, lang, rng.randint(20, 200)), lang, "s", 0)
            for i, lang in enumerate(["xx", "yy", "zz"] * 60)] + [(900, None, "xx", "s", 0), (901, "123 !", "yy", "s", 0),
                                                                 (902, "baba lolo", None, "s", 0)]
    got = language.identify(spark.createDataFrame(rows, DOCS)).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert held and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und" and by[902]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert language.identify(empty).count() == 0


def test_language_learns_every_language(spark):
    rows = [(i, f"words of a text {i}", f"l{i % 90}" if i < 900 else "l0", "s", 0) for i in range(2000)]
    sample = language.training_sample(spark.createDataFrame(rows, DOCS), per_language=20)
    assert {lang for _, lang in sample} == {f"l{k}" for k in range(90)}
    assert language.train(sample, epochs=1).languages == sorted(f"l{k}" for k in range(90))
    assert sum(lang == "l1" for _, lang in sample) == 10 and sum(lang == "l0" for _, lang in sample) < 120


def test_language_gradients_match_differences():
    rng = np.random.default_rng(0)
    samples = [(bytes(rng.integers(97, 110, 100).tolist()), "ab"[i % 2]) for i in range(6)]
    net = language.train(samples, epochs=1)
    x = np.zeros((6, language.WINDOW), dtype=np.uint8)
    for row, (data, _) in zip(x, samples):
        row[:100] = np.frombuffer(data, dtype=np.uint8)
    y = np.array([0, 1] * 3)
    for p in (net.embedding, *net.filters, net.dense):
        p[...] = p.astype(np.float64)
    loss = lambda: -np.log(language._softmax(net.pooled(x).astype(np.float64) @ net.dense + net.offset)[np.arange(6), y]).mean()
    grads = language._gradients(net, x, y)
    for p, g in ((net.dense, grads[-2]), (net.filters[0], grads[1])):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, eps = p[at], 1e-2
        p[at] = keep + eps
        up = loss()
        p[at] = keep - eps
        down = loss()
        p[at] = keep
        assert abs((up - down) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_language_windows_cover_every_ngram():
    for n in (0, 1, 250, 256, 257, 509, 1000, 5000):
        data = bytes(1 + i % 255 for i in range(n))
        view, size = language.windows_of(data)
        seen = {w[i:i + 4].tobytes() for w in view for i in range(language.WINDOW - 3)}
        assert all(data[i:i + 4] in seen for i in range(max(0, n - 3))) and size.sum() == max(1, n)
    assert language.train([]) is None and language.predict(None, ["abc", None]) [0] == ["und", "und"]


# ------------------------------------------------------------------ toxicity

def slow_kernel(a, b):
    """Common triples by their definition."""
    total = 0.0
    for i in itertools.combinations(range(len(a)), 3):
        for j in itertools.combinations(range(len(b)), 3):
            if all(a[x] and a[x] == b[y] for x, y in zip(i, j)):
                total += toxicity.LAMBDA ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
    return total


def test_string_kernel_matches_definition():
    rng = random.Random(4)
    units = [tuple(rng.randrange(0, 6) for _ in range(rng.randint(3, 7))) for _ in range(12)]
    for u in units:
        k = slow_kernel(u, u)
        assert toxicity.self_kernel(np.array([u], dtype=np.int32))[0] == pytest.approx(k, rel=1e-4, abs=1e-6)
        for v in units:
            norm = (k * slow_kernel(v, v)) ** 0.5
            want = slow_kernel(u, v) / norm if norm else 0.0
            assert toxicity.kernel([toxicity.features(u)], [toxicity.features(v)])[0, 0] == pytest.approx(want, abs=1e-6)


def test_units_join_inner_symbols_and_spelled_words():
    def units(t):
        points = toxicity._lower_points(t)
        return [t[a:b] for a, b in zip(*toxicity.unit_spans(points))]
    assert units("an id-iot, i d i o t! is ab cd") == ["an", "id-iot", "i d i o t", "is", "ab", "cd"]
    assert units("") == [] and units("***") == []


def toxic_rows(n=400, seed=8):
    rng = random.Random(seed)
    parts = ["the", "an", "in", "or", "er", "on", "re", "at", "es", "ing", "tion", "ble"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grumbok", "fizwad", "snarkel"]))
        rows.append((i, " ".join(w) + ".", int(bad)))
    return rows


def test_toxicity_finds_held_out_and_gapped_insults(spark, empty):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    model = toxicity.train([(t, y) for _, t, y in rows], 0.2)
    clean = "the another inthe eration ering onthe " * 10
    plain, *gapped = toxicity.evidence(model, [clean + w for w in (
        "", "grumbok", "grum-bok", "g r u m b o k", "g.r.u.m.b.o.k", "gru*mbok")])[:, 0]
    assert plain < 0 and min(gapped) > 0.2
    long = clean * 15_000
    assert len(long) > 2 * toxicity._CHUNK
    assert toxicity.evidence(model, [long, long + " fizwad"])[:, 0].tolist()[1] > 0.2 > toxicity.evidence(model, [long])[0, 0]
    assert toxicity.score_documents(empty, labels).count() == 0


def test_spelled_out_insults_of_any_gap_and_offset():
    insults = ["pathetic", "worthless", "disgusting", "grumbok"]
    rows = [(re.sub("grumbok|fizwad|snarkel", insults[i // 5 % 4], t), y) for i, t, y in toxic_rows()]
    model = toxicity.train(rows, 0.2)
    clean = "the another inthe eration ering onthe " * 10
    seen = lambda texts: toxicity.evidence(model, [clean + t for t in texts])[:, 0]
    gaps = ["--", "---", "  ", "   ", " . ", "*_*", "-" * 9]
    for insult in insults:
        assert min(seen([g.join(insult) for g in gaps] + [insult[:2] + g + insult[2:] for g in ("--", "***")])) > 0.2
        # The parts that long gaps hold apart are still read alone.
        assert min(seen([f"the--{insult}...another"])) > 0.2
        # At every offset in a longer spelled-out run.
        assert min(seen([g.join("ontherein"[:k] * 2 + insult + "ation" * 3) for k in range(10) for g in ("--", " . ")])) > 0
    assert max(seen([g.join("theanotherintheerationering"[k:]) for k in range(8) for g in gaps]
                    + ["the--another...eration", "a - b -- c"])) < 0
    # A text's last letter and the next one's first are not one run.
    assert [len(x) for x in toxicity.units(toxicity._lower_points("a\n\nb"), np.array([0, 3]))] == [2, 2, 2, 2]


def slow_evidence(model, text):
    """Every unit window of a text by the definition: its normalised feature map times the weights."""
    letters, gap, starts, ends = toxicity.units(toxicity._lower_points(text))
    codes = toxicity.encode(toxicity._lower_points(text)[letters], model.codes)
    best, many = -1.0, 0
    for a, b, u in zip(*toxicity.windows(starts, ends, gap)):
        unit = [toxicity.BEGIN if a == starts[u] else 0]
        for k in range(a, b):
            unit += ([0] if k > a and gap[k] else []) + [int(codes[k])]
        map_ = toxicity.features((*unit, toxicity.END if b == ends[u] else 0))
        f = sum(v * float(model.weights[key >> 20, key >> 10 & 1023, key & 1023]) for key, v in map_.items())
        if f > 0:
            best, many = max(best, f + model.bias), many + (f + model.bias > 0)
    return best, np.log1p(many)


def test_evidence_equals_the_definition_window_by_window():
    rows = toxic_rows(150)
    model = toxicity.train([(t, y) for _, t, y in rows], 0.2)
    texts = [t[:400] for _, t, _ in rows[:12]] + ["", "f-i-z w a d, grum--bok a b c", "x" * 60 + " fizwad" * 3, "g.r u.m b.o k" * 4]
    got = toxicity.evidence(model, texts)
    assert got == pytest.approx(np.array([slow_evidence(model, t) for t in texts]), rel=1e-3, abs=1e-4)


def test_slices_of_a_long_text_end_between_units(monkeypatch):
    rows = toxic_rows(150)
    model = toxicity.train([(t, y) for _, t, y in rows], 0.2)
    clean = "the another inthe eration ering onthe " * 10
    for insult in ("f i z w a d", "f--i . z--w..a d", "fiz--wad", "fizwad"):
        for offset in range(0, 40):
            text = clean + "on " * (offset // 3) + "a" * (offset % 3) + " - " + insult + " " + clean
            whole = toxicity.evidence(model, [text])
            for size in (len(clean) + 20, len(clean) + 21, 60):
                with monkeypatch.context() as m:
                    m.setattr(toxicity, "_CHUNK", size)
                    assert "".join(toxicity.slices(text.lower(), size)) == text.lower()
                    assert (toxicity.evidence(model, [text]) == whole).all(), (insult, offset, size)
    spelled = "a b " * 500 + "f i z w a d " + "c d " * 500  # one unit, longer than a slice: read whole
    whole = toxicity.evidence(model, [spelled])
    with monkeypatch.context() as m:
        m.setattr(toxicity, "_CHUNK", 100)
        assert (toxicity.evidence(model, [spelled]) == whole).all()
    assert list(toxicity.slices(" . - " * 100, 50)) and list(toxicity.slices("", 50)) == []


def test_distinct_rows_tell_codes_and_gaps_apart():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 64, (3000, 16)).astype(np.int8)[rng.integers(0, 200, 3000)]
    inner = rng.integers(0, 2, (3000, 13)).astype(bool)[rng.integers(0, 5, 3000)]
    for gaps in (None, inner):
        first, which = toxicity.distinct_rows(rows, gaps)
        both = rows if gaps is None else np.hstack([rows, gaps])
        assert (both[first[which]] == both).all() and len(first) == len(np.unique(both, axis=0))


def test_gapped_rows_weigh_as_rows_with_gap_codes():
    rng = np.random.default_rng(5)
    weights = rng.normal(0, 1, (9, 9, 9)).astype(np.float32)
    weights[0], weights[:, 0], weights[:, :, 0] = 0, 0, 0
    rows = rng.integers(0, 9, (40, 8)).astype(np.int32)
    place = np.cumsum(rng.integers(1, 3, (40, 8)), axis=1, dtype=np.int32)
    place -= place[:, :1] - 1
    wide = np.zeros((40, 16), dtype=np.int32)
    np.put_along_axis(wide, place - 1, rows, axis=1)
    assert toxicity.numerators(rows, weights, place) == pytest.approx(toxicity.numerators(wide, weights), rel=1e-4, abs=1e-5)
    assert toxicity.self_kernel(rows, place) == pytest.approx(toxicity.self_kernel(wide), rel=1e-4, abs=1e-6)


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    odd = odd.withColumns({c: F.lit("clash") for c in ("toxic", "held_out", "predicted", "quality")})
    got = toxicity.score_documents(odd, labels).collect()  # one class: nothing to learn
    both = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (8, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(odd, both).count() == len(ODD)
    assert len(got) == len(ODD) and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    model = toxicity.train([(t, y) for _, t, y in toxic_rows(150)], 0.2)
    scores = toxicity.score(model, [t or "" for _, t in ODD])
    assert ((0 <= scores) & (scores < 0.5)).all()


# ------------------------------------------------------------------- quality

def quality_rows(n=500):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        good = i % 4 > 0
        text = words(rng, rng.randint(20, 90)) if good else " ".join(w + "###" for w in words(rng, 40).split())
        rows.append((i, text, "en", f"src{i % 7 if good else 9}", len(text), int(good)))
    return rows


def test_quality_learns_and_keeps_edges(spark, odd, empty):
    rows = quality_rows()
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows if r[0] % 3], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(i, f"https://h{i % 3}.example.com/en/{i}") for i in range(0, 500, 3)]
                                  + [(900, None), (901, "no url")], "page_id long, url string")
    got = quality.score_documents(docs, labels, pages).collect()
    truth = {r[0]: r[5] for r in rows}
    assert len(got) == len(rows)
    unseen = [r for r in got if r["held_out"] or not r["doc_id"] % 3]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) > 0.95
    assert all(0 <= r[c] <= 1 for r in got for c in ("content_score", "meta_score", "score"))
    assert len(quality.score_documents(odd, labels, None, train_on=docs).collect()) == len(ODD)
    assert all(r["predicted"] == 1 for r in quality.score_documents(odd, labels.filter("quality = 1")).collect())
    assert quality.score_documents(empty, labels, pages).count() == 0


def test_co_training_exchanges_labels():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600)
    content = rng.normal(0, 1, (600, 4)) + 2.5 * y[:, None]
    meta = np.zeros((600, 8))
    meta[np.arange(600), np.where(rng.random(600) < 0.95, y * 4, (1 - y) * 4)] = 1
    label = np.where(np.arange(600) < 40, y, -1)
    views = quality.co_train(content, meta, label)
    x = np.clip((content - views.center) / views.scale, -8, 8)
    both = quality.combined(views, quality._calibrated(quality._ones(x) @ views.content, views.platt[0]),
                            quality._calibrated(quality._ones(meta) @ views.meta, views.platt[1]))
    assert ((both > 0.5) == y)[40:].mean() > 0.95
    assert quality.co_train(content, meta, np.full(600, -1)) is None


def test_pool_of_a_table_gives_what_the_pool_at_hand_gives(spark):
    """The same rounds by brute force over arrays; rare kinds far behind any first thousands are exchanged."""
    rng = np.random.default_rng(4)
    n = 6000
    y = rng.integers(0, 2, n)
    content = rng.normal(0, 1, (n, quality.CONTENT)) + 1.2 * y[:, None]
    content[5990:] += 9 * (2 * y[5990:, None] - 1)   # the surest stand at the end
    rows = [{"id": i, "lang": "en" if y[i] else "de", "source": f"s{i % 5}", "n_chars": int(i % 900), "n_pages": i % 3,
             "domain": None if i % 2 else "a.org", "suffix": None if i % 2 else "org", "form": None} for i in range(n)]
    meta = quality.meta_features(rows)
    frame = spark.createDataFrame([(r["id"], content[i].tolist(), *[r[c] for c in quality.META]) for i, r in enumerate(rows)],
                                  "id long, content array<double>, lang string, source string, n_chars long, n_pages long, "
                                  "domain string, suffix string, form string")
    label = np.where(np.arange(n) < 200, y, -1)
    table_pool = quality.TablePool(frame.filter("id >= 200").repartition(7))
    array_pool = quality.ArrayPool(list(range(200, n)), content[200:], meta[200:])
    center, scale = content[:200].mean(axis=0), content[:200].std(axis=0)
    weights = [rng.normal(0, 1, quality.CONTENT + 1), rng.normal(0, 1, quality.META_SLOTS + 1)]
    for taken in (set(), set(range(300, 500))):
        got, want = (pool.strongest(weights, center, scale, 40, taken) for pool in (table_pool, array_pool))
        key = lambda picked: sorted((v, g, i) for v, g, i, *_ in picked)
        assert key(got) == key(want) and len(got) > 50
        features = {(v, i): (c, m) for v, g, i, c, m in want}
        assert all(np.allclose(c, features[v, i][0]) and (m == features[v, i][1]).all() for v, g, i, c, m in got)
    views = quality.co_train(content[:200], meta[:200], label[:200], pool=table_pool)
    other = quality.co_train(content, meta, label)
    assert np.allclose(views.content, other.content, atol=1e-6) and np.allclose(views.combine, other.combine, atol=1e-6)
    moved = []
    real = table_pool.strongest
    table_pool.strongest = lambda *a: moved.append(real(*a)) or moved[-1]
    quality.co_train(content[:200], meta[:200], label[:200], pool=table_pool)
    assert {i for picked in moved for _, _, i, *_ in picked} & set(range(5990, n))


# ------------------------------------------------------------- url reputation

URLS = ["https://www.Example.ORG/es/1", "http://a.example.org/en/12?x", "http://example.org/en/2", "https://site.com/fr/3",
        "https://site.com/de/4", "https://bad.site.net/en/5", "x://host.net", "//no.scheme/1", None, "", "http://?q",
        "HTTPS://org/", "http://notexample.org/es/", "http://a.b.co.uk/9#f", "http://h.com:80/fr/7/http://z"]


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls_rules_and_edges(spark):
    rows = [(i, u, "clash", 1) for i, u in enumerate(URLS + URLS[:2])] + [(None, URLS[0], "clash", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, n int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = url_reputation.judge(pages, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is None:
            continue
        host, path = slow_url(rows[r["page_id"]][1])
        fits = [(t, v) for t, v in url_reputation.RULES
                if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/"):])]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[0])
        assert r["verdict"] == rule[1] or (rule[1] is None and r["verdict"] in ("allow", "block"))
    assert url_reputation.judge(pages.limit(0), labels).count() == 0
    assert url_reputation.judge(pages, labels.limit(0)).count() == len(rows)


def test_reputation_shrinks_and_blocks(spark):
    counts = ([("good%d.aa.net" % i, 200, 190) for i in range(6)] + [("bad.bb.net", 300, 30), ("new.bb.net", 0, 0),
              ("few.aa.net", 2, 0), ("other.org", 0, 0)])
    got = {r["host"]: r for r in url_reputation.reputations(spark.createDataFrame(counts, "host string, n long, s long")).collect()}
    assert got["good0.aa.net"]["posterior_bound"] > 0.8 and got["bad.bb.net"]["posterior_bound"] < 0.3
    assert got["new.bb.net"]["posterior_mean"] < got["other.org"]["posterior_mean"]   # its domain's record counts
    assert 0 < got["few.aa.net"]["posterior_mean"] < 0.95                             # shrunk, not zero
    assert all(0 < r["posterior_mean"] < 1 and r["posterior_bound"] < r["posterior_mean"] for r in got.values())


# ---------------------------------------------------------------------- warc

def record(i, url, ts, kind, etag=None, modified=None, digest=None, headers=None):
    return (i, url, ts, kind, etag, modified, digest, 10 if kind == "response" else None, headers)


WARC = ("record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, length long, "
        "headers map<string,string>")


def test_revisits_resolve_against_the_latest_earlier_response(spark):
    rows = [
        record(1, "http://www.a.com/x/", 10, "response", '"e1"', "d1", "p1", {"ETag": '"e1"', "Content-Length": "10", "Date": "1"}),
        record(2, "https://a.com/x#f", 20, "response", '"e2"', "d2", "p2", {"etag": '"e2"', "date": "2"}),
        record(3, "http://a.com:80/x?utm_source=q", 15, "revisit", 'W/"e1"', None, None, {"Date": "9", "Content-Length": "0", "X": "y"}),
        record(4, "http://a.com/x", 20, "revisit", '"e2"'),               # the response of the same time is not earlier
        record(5, "http://a.com/x", 21, "revisit", None, "d2"), record(6, "http://a.com/x", 22, "revisit", None, None, "p2"),
        record(7, "http://a.com/x", 5, "revisit", '"e1"'), record(8, "http://a.com/x", 30, "revisit"),
        record(9, None, 30, "revisit", '"e1"'), record(10, "http://a.com/x", None, "revisit", '"e1"'),
        record(5, "http://a.com/x", 21, "revisit", None, "d2"),
        record(11, "http://a.com/y", 1, "response", None, None, None, {"A": "1", "a": "2"}),
        record(12, "http://a.com/y", 2, "revisit", None, None, None, None)]
    frame = spark.createDataFrame(rows, WARC).withColumns({c: F.lit(1) for c in ("canonical", "found", "range", "near")})
    for ranges in (2, 64):
        got = warc.resolve_revisits(frame, ranges).collect()
        assert len(got) == 10
        by = {r["record_id"]: r for r in got}
        said = {k: (r["response_id"], r["outcome"]) for k, r in by.items()}
        assert said == {3: (1, "resolved"), 4: (1, "mismatch"), 5: (2, "resolved"), 6: (2, "resolved"), 7: (None, "no_response"),
                        8: (2, "mismatch"), 9: (None, "no_response"), 10: (None, "no_response"), 12: (11, "mismatch")}
        assert by[3]["headers"] == {"etag": '"e1"', "content-length": "10", "date": "9", "x": "y"} and by[3]["digest"] == "p1"
        assert by[4]["digest"] is None and by[4]["headers"] is None
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def test_revisits_match_brute_force(spark):
    rng = random.Random(9)
    rows = [record(i, f"http://h.com/{min(rng.randrange(6), 2)}", rng.randrange(80), rng.choice(["response", "revisit"]),
                   f'"{rng.randrange(3)}"', None, f"p{i}", {"k": str(i)}) for i in range(400)]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, WARC), 8).collect()}
    for i, url, ts, kind, etag, *_ in rows:
        if kind == "revisit":
            before = [(r[2], r[0]) for r in rows if r[3] == "response" and r[1] == url and r[2] < ts]
            want = max(before)[1] if before else None
            assert got[i]["response_id"] == want
            if want is not None:
                assert got[i]["outcome"] == ("resolved" if rows[want][4] == etag else "mismatch")


# --------------------------------------------------------------------- mixing

def slow_shares(leaves, weights, budget, epochs):
    def share(prefix, total, depth):
        if depth == 3:
            return {prefix: total}
        kids = sorted({p[depth] for p in leaves if p[:depth] == prefix and leaves[p]})
        room = {k: epochs * sum(v for p, v in leaves.items() if p[:depth + 1] == prefix + (k,)) for k in kids}
        w = {k: weights.get(("domain", "lang", "source")[depth], {}).get(k, 1.0) for k in kids}
        kids = [k for k in kids if w[k] > 0]
        got, left, rest = {}, list(kids), total
        while left:
            full = [k for k in left if room[k] < rest * w[k] / sum(w[x] for x in left)]
            if not full:
                got |= {k: rest * w[k] / sum(w[x] for x in left) for k in left}
                break
            got |= {k: room[k] for k in full}
            rest -= sum(room[k] for k in full)
            left = [k for k in left if k not in full]
        return {p: b for k in kids for p, b in share(prefix + (k,), got[k], depth + 1).items()}
    return share((), budget, 0)


@pytest.mark.parametrize("budget_share, epochs", [(0.1, 1), (0.6, 2), (1.0, 2), (5.0, 3)])
def test_mixing_matches_brute_force(spark, budget_share, epochs):
    rng = random.Random(epochs)
    rows = []
    for i in range(300):
        source = "src0" if rng.random() < 0.4 else f"src{rng.randrange(6)}"
        rows.append((i, words(rng, rng.randrange(0, 60)), rng.choice(["en", "en", "de", None]), source, 0))
    rows += [(5, words(rng, 9), "en", "src1", 0), (5, words(rng, 9), "en", "src1", 0), (None, "a b", "en", "src2", 0),
             (600, None, "en", None, 0)]
    weights = {"domain": {"family0": 3.0}, "lang": {"en": 2.0}, "source": {"src4": 0.0}}
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("tokens", "bucket", "epochs", "edge", "rest")})
    got = mixing.mix(docs, weights, budget_share, epochs)
    assert got.columns == docs.columns + ["mix_domain", "mix_epoch", "mix_tokens"]
    leaf = defaultdict(lambda: defaultdict(int))
    copies = defaultdict(int)
    for i, text, lang, source, _ in rows:
        number = re.search(r"([0-9]{1,9})$", source or "")
        path = (f"family{int(number[1]) % 3}" if number else "(none)", lang or "(none)", source or "(none)")
        leaf[path][i] += len(re.findall(r"[^\x09-\x0D\x20]+", text or ""))
        copies[path, i] += 1
    sizes = {p: sum(v.values()) for p, v in leaf.items()}
    # The root's total counts what can be used: leaves of weight 0 are outside.
    usable = sum(v for p, v in sizes.items() if p[2] != "src4")
    want = defaultdict(int)
    for p, b in slow_shares({p: v for p, v in sizes.items() if p[2] != "src4"}, weights, usable * budget_share, epochs).items():
        b = int(b + 1e-9)
        whole = min(epochs, b // sizes[p])
        rest = b - whole * sizes[p] if whole < epochs else 0
        used = 0
        for i in leaf[p]:
            for k in range(whole):
                want[i, k] += copies[p, i]
        for i in sorted(leaf[p], key=lambda i: (hashlib.md5(f"42:{whole}:{'' if i is None else i}".encode()).hexdigest())):
            used += leaf[p][i]
            if rest <= 0 or used > rest:
                break
            want[i, whole] += copies[p, i]
    mine = defaultdict(int)
    for r in got.collect():
        mine[r["doc_id"], r["mix_epoch"]] += 1
    assert dict(mine) == dict(want)


def test_registered_mixing_matches_brute_force(spark):
    weights = queries.MIX_WEIGHTS
    leaf = defaultdict(lambda: defaultdict(int))
    copies = defaultdict(int)
    for r in table(spark, SF_SMALL, "documents").collect():
        number = re.search(r"([0-9]{1,9})$", r["source"] or "")
        path = (f"family{int(number[1]) % 3}" if number else "(none)", r["lang"] or "(none)", r["source"] or "(none)")
        leaf[path][r["doc_id"]] += len(re.findall(r"[^\x09-\x0D\x20]+", r["text"] or ""))
        copies[path, r["doc_id"]] += 1
    sizes = {p: sum(v.values()) for p, v in leaf.items()}
    want = defaultdict(int)
    for p, b in slow_shares(sizes, weights, 0.6 * sum(sizes.values()), 2).items():
        b = int(b + 1e-9)
        whole = min(2, b // sizes[p])
        rest = b - whole * sizes[p] if whole < 2 else 0
        used = 0
        for i in leaf[p]:
            for k in range(whole):
                want[i, k] += copies[p, i]
        for i in sorted(leaf[p], key=lambda i: hashlib.md5(f"42:{whole}:{'' if i is None else i}".encode()).hexdigest()):
            used += leaf[p][i]
            if rest <= 0 or used > rest:
                break
            want[i, whole] += copies[p, i]
    mine = defaultdict(int)
    for r in queries.QUERIES["op8_hierarchical_mixing"](spark, SF_SMALL).collect():
        mine[r["doc_id"], r["mix_epoch"]] += 1
    assert len(want) > 20 and dict(mine) == dict(want)


def test_mixing_empty(spark, empty):
    assert mixing.mix(empty).count() == 0


# ------------------------------------------------------------------------ ann

def test_nearest_match_brute_force_on_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (700, 12)) * rng.uniform(0.2, 3, (700, 1))
    x[100:300] = x[100]                       # equal vectors
    rows = [(i, [float(np.float32(v)) for v in r], "clash", 1) for i, r in enumerate(x)]
    rows += [(900, None, "", 1), (901, [0.0] * 12, "", 1), (902, [float("nan")] * 12, "", 1), (903, [1.0, None] * 6, "", 1),
             (904, [float("inf")] * 12, "", 1), (905, [1.0, 2.0], "", 1), (None, rows[0][1], "", 1), (20, rows[20][1], "", 1), (906, [], "", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, v int")
    got = defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, block=128, query_block=16, share=0.4, listed=16, pivots=64).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v, dtype=np.float64) for i, v, *_ in rows[:700]}
    assert set(got) == {i for i in good if i % 20 == 0}
    found = total = 0
    for q, rs in got.items():
        rs.sort()
        assert [r for r, *_ in rs] == list(range(1, 21)) and q not in [i for _, i, _ in rs]
        assert [(s, i) for _, i, s in rs] == sorted(((s, i) for _, i, s in rs), key=lambda e: (-e[0], e[1]))
        assert all(s == pytest.approx(good[q] @ good[i], rel=1e-12) for _, i, s in rs)
        best = sorted(good, key=lambda i: (-(good[q] @ good[i]), i))
        best = [i for i in best if i != q][:20]
        found += len(set(best) & {i for _, i, _ in rs})
        total += 20
    assert found / total > 0.9
    few = ann.search(frame.filter("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4
    assert ann.search(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(frame.filter("vec_id = 900"), F.lit(True)).count() == 0


def test_recall_at_the_registered_settings(spark, monkeypatch):
    """2000 vectors: every result comes through the inverted files, a quarter of a block is reranked."""
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    found = defaultdict(list)
    for r in queries.QUERIES["op9_permutation_index"](spark, "/root/testdata/sf0.1").collect():
        found[r["query_id"]].append(r["vec_id"])
    hits = total = 0
    for row in np.flatnonzero(ids % 20 == 0):
        best = [i for i in ids[np.lexsort((ids, -(x @ x[row])))][:21] if i != ids[row]][:20]
        hits += len(set(best) & set(found[ids[row]]))
        total += 20
    assert total == 2000 and 0.95 <= hits / total < 1


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(2)
    lists = np.stack([rng.permutation(30)[:8] for _ in range(50)]).astype(np.int16)
    query = rng.permutation(30)[:8].astype(np.int16)

    def footrule(a, b):
        place = lambda x, p: x.tolist().index(p) if p in x else 8
        return sum(abs(place(a, p) - place(b, p)) for p in set(a.tolist()) | set(b.tolist()))
    want = np.array([footrule(query, x) for x in lists])
    got = ann.closest_by_footrule(query, ann.inverted_files(lists, 30), 50, 8, 10)
    assert sorted(want[got]) == sorted(want)[:10]

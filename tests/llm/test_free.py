"""op2, op5, op8, op9, op10 and the pipeline: brute force, round trips, held-out accuracy, edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from docdelta.llm import exprs, graph, jaccard, pieces, quality_mil, simhash, toxicity, warc
from pyspark.sql import functions as F

from tests.llm.test_native import docs, items, prose

# ---- SimHash --------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance=4):
    part = {i: {i} for i in fps}
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance and part[a] is not part[b]:
                part[a] |= part[b]
                for x in part[b]:
                    part[x] = part[a]
    return {i: min(p) for i, p in part.items()}


def test_fingerprints():
    for t in [None, "", " \n", "One", "a b c", "a b c d", "A B C D e", "x " * 9000, "é 🎉 ß Ä ä b c", "\x0ba\x0cb\x1cc d e"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


def test_near_duplicate_groups_match_brute_force(spark):
    rng = random.Random(1)
    texts = {}
    for g in range(12):
        base = prose(rng, 400)
        for k in range(rng.randint(1, 6)):
            words = list(base)
            for at in rng.sample(range(400), 2 * k):
                words[at] = "changed"
            texts[len(texts) + 10] = " ".join(words)
    texts |= {1: None, 2: "", 3: "one two", 4: "one two", 5: "ONE two"}
    rows = [*texts.items(), (7, "one two"), (7, "one two"), (None, "one two")]
    got = simhash.groups(docs(spark, rows)).collect()
    fps = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    want = plain_components(fps)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == Counter((i, f"{fps[i]:016x}", want[i]) for i, _ in rows if i is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [3]
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*set(want.values()), None])
    assert simhash.groups(docs(spark, [])).count() == 0


def test_jaccard_groups_match_brute_force_in_every_tiling(spark):
    rng = random.Random(8)
    texts, sets = {}, {}
    for g in range(6):
        base = prose(rng, 300)
        for k in range(14):
            words = list(base)
            for at in rng.sample(range(300), rng.randint(0, 14)):
                words[at] = f"w{rng.randrange(10**6)}"
            texts[100 * g + k] = " ".join(words)
    rows = [*texts.items(), (7007, None), (7008, " "), (7009, "one Two"), (7050, "One two"), (7050, "One two"), (None, "one two")]
    for i, t in rows:
        w = (t or "").lower().split()
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    near = [(i, j) for i in sets for j in sets if None not in (i, j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {i: i for i in sets if i is not None}
    while any(want[i] > want[j] for i, j in near):
        for i, j in near:
            want[i] = min(want[i], want[j])
    far = sum((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 4 for i, j in near if i in texts and j in texts and i < j)
    assert far > 20  # op5's contract distance would miss these
    for tile in (256, 5):
        got = jaccard.groups(docs(spark, rows), tile=tile).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, want[7009 if i is None else i]) for i, _ in rows)
    assert jaccard.groups(docs(spark, [])).count() == 0


def test_links_for_every_block_count_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in centre for _ in range(60)}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = plain_components({f: f & (2**64 - 1) for f in signed})
    for k, tile in [(6, 2048), (8, 16), (12, 7)]:
        monkeypatch.setattr(simhash, "choose_blocks", lambda n, d, k=k: k)
        stars = {r.node: r.root for r in graph.components(simhash.links(df, tile=tile)).collect()}
        assert {f: stars.get(f, f) for f in signed} == want


def test_blocks_grow_with_the_corpus():
    ks = [simhash.choose_blocks(10**e, 4) for e in range(2, 13)]
    assert ks == sorted(ks) and ks[0] >= 6 and ks[-1] <= 14


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([*chain, *hub, (5, 5)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 300)}  # the hub has more links than are shuffled
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(-5, 1000 + i) for i in range(300)]
    part = {}
    for a, b in pairs:
        joint = part.get(a, {a}) | part.get(b, {b})
        part.update(dict.fromkeys(joint, joint))
    want = {i: min(of) for i, of in part.items() if min(of) != i}
    for at_once in (0, 100_000):
        got = graph.components(spark.createDataFrame(pairs, "a long, b long"), at_once=at_once)
        assert {r.node: r.root for r in got.collect()} == want


def test_hot_keys_join_as_others_do(spark):
    rows = [(k, i) for k, n in [(1, 900), (2, 30), (3, 1)] for i in range(n)]
    big, small = spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame([(1, "a", 900), (2, "b", 30), (4, "d", 1)], "k long, v string, n long")
    for total, joins in ((10_001, 3), (931, 1)):
        got = exprs.joined_hot(big, small, ["k"], "n", total)
        assert Counter(map(tuple, got.collect())) == Counter((k, i, "ab"[k - 1]) for k, i in rows if k < 3)
        assert str(got._jdf.queryExecution().optimizedPlan()).count("Join ") == joins  # few rows: one plain join


def test_near_duplicate_stage_links_by_fingerprints(spark):
    rng = random.Random(9)
    base = [prose(rng, 400) for _ in range(3)]
    texts = [" ".join([*of[:at], "changed", *of[at + 1 :]]) for of in base for at in (0, 100, 399)]
    sets = [jaccard.shingles(t) for t in texts]
    rows = [(k, simhash.folded(s)) for k, s in enumerate(sets)]
    signed = [(k, f - (1 << 64) if f >= 1 << 63 else f) for k, f in [*rows, (50, rows[0][1]), (51, 0)]]
    links = jaccard._close_prints(spark.createDataFrame(signed, "node long, fp long"))
    stars = {r.node: r.root for r in graph.components(links).collect()}
    want = plain_components(dict([*rows, (50, rows[0][1]), (51, 0)]))
    same = lambda of: {frozenset(k for k in want if of(k) == of(i)) for i in want}
    assert same(lambda k: stars.get(k, k)) == same(want.get) and len(same(want.get)) < len(want)


# ---- WARC -----------------------------------------------------------------


def page_table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("refers_to", F.lit("x"))


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/ b\r\nX: y", "same"), (1, "http://b", "same"), (2, None, None), (4, "u", ""), (9, "u", "é🎉\r\n\r\nWARC/1.1\r\n" * 50), (None, "n", "same"), (3, "http://a2", "same")]
    path = f"file://{tmp_path}/w"
    warc.write(page_table(spark, rows), path, records_per_file=2)
    read = warc.read(spark, path, pattern="part-*")
    got = Counter(tuple(r) for r in warc.page_rows(read).collect())
    dig = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"same": 1, "": 2}
    want = Counter()
    for i, _, t in rows:
        t = t or ""
        to = first.get(t) if i is not None and first.get(t, i) != i else None
        want[i, len(t.encode()), dig(t), "revisit" if to is not None else "response", to] += 1
    assert got == want
    payload = {r.record_id: bytes(r.payload).decode() for r in read.collect() if r.record_type == "response"}
    assert payload["urn:docdelta:page:9"] == rows[4][2]
    warc.write(page_table(spark, rows), f"{path}-bytes", records_per_file=4, file_bytes=400)  # one page is large
    assert Counter(tuple(r) for r in warc.page_rows(warc.read(spark, f"{path}-bytes", pattern="part-*")).collect()) == want
    warc.write(page_table(spark, []), f"{path}-empty")
    assert warc.page_rows(warc.read(spark, f"{path}-empty", pattern="part-*")).count() == 0


def test_warc_members_are_plain_gzip():
    import gzip

    one = warc.gzip_member(warc.record_bytes(1, "u", b"x", None))
    assert gzip.decompress(one + warc.EMPTY_MEMBER + one) == 2 * warc.record_bytes(1, "u", b"x", None)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_loses_only_damaged_records(packed):
    rng = random.Random(3)
    plain = [warc.record_bytes(i, "u", bytes(rng.randrange(256) for _ in range(rng.randint(0, 400))), None) for i in range(40)]
    parts = [warc.gzip_member(p) + warc.EMPTY_MEMBER if packed else p for p in plain]
    starts = np.r_[0, np.cumsum([len(p) for p in parts])]
    for trial in range(12):
        data = bytearray(b"".join(parts))
        at = rng.randrange(len(data))
        hit = int(np.searchsorted(starts, at, side="right")) - 1
        kind = trial % 3
        if kind == 0:
            data[at] ^= 0xFF
        elif kind == 1:
            del data[at : at + 5]
        else:
            data[at:at] = b"junk WARC/1.1\r\nbroken"
        found = list(warc.salvage(bytes(data)))
        said = [f[3]["head"]["warc-record-id"].rsplit(":", 1)[1].strip(">") for f in found if f[0] == "record"]
        ids = {int(i) for i in said if i.isascii() and i.isdigit()}  # a plain header has no checksum
        assert set(range(40)) - ids <= {hit - 1, hit, hit + 1}
        spans = sorted({(f[1], f[2]) for f in found})
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= len(data)
        if len(said) < 40:
            assert any(f[0] == "gap" for f in found)
    assert [f[0] for f in warc.salvage(b"nothing here")] == ["gap"] and list(warc.salvage(b"")) == []
    assert [f[0] for f in warc.salvage(b"".join(parts)[:-10])].count("record") >= 39


def test_salvage_inside_members_and_long_headers():
    plain = [warc.record_bytes(i, "u" * (70_000 if i == 3 else 5), random.Random(i).randbytes(900), None) for i in range(30)]
    bad = bytearray(plain[11])
    bad[-100] ^= 0xFF

    def ids(data):
        found = list(warc.salvage(data))
        assert any(f[0] == "gap" for f in found)
        return [int(f[3]["head"]["warc-record-id"].rsplit(":", 1)[1].strip(">")) for f in found if f[0] == "record"]

    assert warc.parse_record(plain[3], 0)[1] == len(plain[3])
    assert ids(warc.gzip_member(b"".join([*plain[:11], bytes(bad), *plain[12:]]))) == [*range(11), *range(12, 30)]
    plain[3] = warc.record_bytes(3, "u", b"x" * 900, None)
    for level in (6, 0):
        whole = warc.gzip_member(b"".join(plain[:20]), level)
        cut = ids(whole[: len(whole) // 2] + warc.gzip_member(plain[29]))
        assert cut[0] == 0 and cut[-1] == 29 and 5 < len(cut) < 20 and cut == sorted(set(cut))
        assert ids(whole[:-6] + b"zzzzzz") == list(range(20))


def test_salvage_of_a_damaged_member_against_every_byte():
    """Three records in one member, any one byte of the second one changed: the others come back."""
    plain = [warc.record_bytes(i, "u", random.Random(i).randbytes(40), None) for i in range(3)]
    for at in range(len(plain[1])):
        bad = bytearray(plain[1])
        bad[at] ^= 0x15
        said = [f[3]["head"]["warc-record-id"] for f in warc.salvage(warc.gzip_member(plain[0] + bytes(bad) + plain[2])) if f[0] == "record"]
        assert said[0].endswith(":0>") and said[-1].endswith(":2>")


def test_reading_is_linear_and_members_may_be_large():
    import time

    took = []
    for n in (500, 2000):
        data = b"".join(warc.gzip_member(warc.record_bytes(i, "u", random.Random(i).randbytes(4000), None)) for i in range(n))
        began = time.process_time()
        assert sum(f[0] == "record" for f in warc.salvage(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]
    big = warc.record_bytes(1, "u" * 70_000, b"x" * (40 << 20), None)
    found = list(warc.salvage(warc.gzip_member(big, 1)))
    assert [f[0] for f in found] == ["record"] and len(found[0][3]["payload"]) == 40 << 20


# ---- classifiers ----------------------------------------------------------


def labelled(spark, rng, n, bad, name):
    rows, marks = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rng, rng.randint(60, 150))
        for k in range(9, len(words), 10):
            words[k] += "."
        if toxic:
            bad(words, rng)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic != (rng.random() < 0.03))))
    return rows, spark.createDataFrame(marks, f"doc_id long, {name} int").withColumn("text", F.lit("clash"))


def insult(words, rng):
    for _ in range(3):
        words[rng.randrange(len(words))] = rng.choice(["vile", "fool", "rotten"])


def test_toxicity_held_out_and_located(spark):
    rows, labels = labelled(spark, random.Random(4), 600, insult, "toxic")
    rows += [(10_000, None), (10_001, ""), (10_002, "calm. " * 30000), (10_003, "Fine day. You vile fool! Bye.")]
    got = {r.doc_id: r for r in toxicity.classify(docs(spark, rows), labels).collect()}
    test = [(got[i].predicted, int(i % 4 == 0)) for i, _ in rows[:600] if got[i].held_out]
    assert len(test) > 60 and sum(p == y for p, y in test) / len(test) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert [got[10_000 + k].predicted for k in range(4)] == [0, 0, 0, 1] and got[10_000].score == 0
    spans = got[10_003].offending
    assert len(spans) == 1 and rows[-1][1][spans[0].start : spans[0].stop] == " You vile fool"
    model = toxicity.fit(docs(spark, rows), labels)
    kept = toxicity.keep_clean(docs(spark, rows), model)
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs(spark, [(1, "x"), (1, "x")]), none).collect()
    assert [r.score for r in got] == [0.0, 0.0] and toxicity.classify(docs(spark, []), none).count() == 0


def test_share_of_the_most_frequent_word_counts_all_words():
    rare = [f"w{i}" for i in range(40)]
    assert all(quality_mil.encode(" ".join([*rare, *[w] * 20]))[0][-3] == 21 / 60 for w in rare)


def test_quality_held_out(spark):
    def junk(words, rng):
        words[:] = [w.upper() + "!!" for w in words[:8]] * 12

    rows, labels = labelled(spark, random.Random(5), 500, junk, "bad")
    labels = labels.select("doc_id", (1 - F.col("bad")).cast("int").alias("quality"))
    rows += [(10_000, None), (10_001, ""), (10_002, "w " * 20000)]
    got = {r.doc_id: r for r in quality_mil.classify(docs(spark, rows), labels).collect()}
    test = [(got[i].predicted, int(i % 4 != 0)) for i, _ in rows[:500] if got[i].held_out]
    assert sum(p == y for p, y in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r.score for r in quality_mil.classify(docs(spark, rows[:5]), one).collect()} == {1.0}
    assert quality_mil.classify(docs(spark, []), labels).count() == 0


def test_attention_forward_and_gradient_against_plain_ones():
    rng = np.random.default_rng(3)
    counts = np.array([1, 4, 2, 3])
    begin = np.r_[0, np.cumsum(counts)[:-1]]
    x, y = rng.normal(size=(counts.sum(), 5)), np.array([0.0, 1.0, 1.0, 0.0])
    shapes = {"W": (5, 3), "b": (3,), "V": (3, 2), "U": (3, 2), "w": (2,), "c": (3,), "d": (1,)}
    model = quality_mil.Model(x.mean(0), x.std(0), {k: rng.normal(size=v) for k, v in shapes.items()})

    def plain(bag):
        p = model.p
        h = [np.tanh(((v - model.mean) / model.scale) @ p["W"] + p["b"]) for v in bag]
        e = [float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"]) for v in h]
        a = np.exp(e) / np.exp(e).sum()
        return 1 / (1 + np.exp(-(sum(k * v for k, v in zip(a, h)) @ p["c"] + p["d"][0])))

    want = np.array([plain(x[b : b + n]) for b, n in zip(begin, counts)])
    assert np.allclose(model.forward(x, begin, counts)[0], want)
    loss = lambda: -np.mean([np.log(s if t else 1 - s) for s, t in zip((plain(x[b : b + n]) for b, n in zip(begin, counts)), y)])
    for name, got in quality_mil.gradient(model, x, begin, counts, y).items():
        for i in np.ndindex(model.p[name].shape):
            keep = model.p[name][i]
            up, down = [model.p[name].__setitem__(i, keep + e) or loss() for e in (1e-5, -1e-5)]
            model.p[name][i] = keep
            assert abs((up - down) / 2e-5 - got[i]) < 1e-6


def test_noisy_or_and_its_gradient_against_plain_ones():
    rng = np.random.default_rng(4)
    at, bag_of = rng.integers(0, 6, 20), np.sort(np.r_[np.arange(8), rng.integers(0, 8, 12)])
    doc_of_bag, y = np.array([0, 0, 1, 2, 2, 2, 3, 3]), np.array([1.0, 0.0, 1.0, 0.0, 1.0])  # the last has no sentence
    w, b, leak = rng.normal(size=6), -1.0, -2.0
    sig = lambda z: 1 / (1 + np.exp(-z))

    def loss(w, b, leak):
        out = 0.0
        for d, t in enumerate(y):
            clean = 1 - sig(leak)
            for s in np.flatnonzero(doc_of_bag == d):
                clean *= 1 - sig(b + w[at[bag_of == s]].sum())
            out -= np.log(1 - clean if t else clean) / len(y)
        return out

    gw, (gb, gl) = toxicity.gradient(w, b, leak, at, bag_of, doc_of_bag, y)
    for k in range(6):
        e = np.eye(6)[k] * 1e-5
        assert abs((loss(w + e, b, leak) - loss(w - e, b, leak)) / 2e-5 - gw[k]) < 1e-6
    assert abs((loss(w, b + 1e-5, leak) - loss(w, b - 1e-5, leak)) / 2e-5 - gb) < 1e-6
    assert abs((loss(w, b, leak + 1e-5) - loss(w, b, leak - 1e-5)) / 2e-5 - gl) < 1e-6
    model = toxicity.Model({h: 4.0 for h in toxicity.hashed("vile")}, -3.0)
    said = [1 - sig(4.0 * len(toxicity.hashed("vile")) - 3.0)] * 2 + [1.0]
    score, spans = model.document("So vile. Vile again! calm here", {})
    assert abs(score - (1 - np.prod(said))) < 1e-9 and len(spans) == 2


# ---- pieces ---------------------------------------------------------------

ODD = ["", None, " ", "  ", "   a", " a  b   ", "\n", "a\n\n b", "▁x ▁", "ключ 日本​🎉", "x" * 3000, "ab" * 4000 + "ключ" * 900, "  " + "qz" * 1500, " " * 700 + "end", "\t t\r\n", "0123 456", "\0 n\0", "aaaa aaaaaaaaaaaa", "  \n  "]


def test_pieces_equal_the_library(spark, sf):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rng = random.Random(6)
    made = ["".join(rng.choice("abcdefghij thetionsing  \n.é") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = [*ODD, *made, *real, *ODD]
    got = pieces.encode(docs(spark, list(enumerate(texts))), batch_chars=20_000).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.ids == lib.encode(t), repr(t[:40])
        assert r.decoded == t.replace("▁", " ") == lib.decode(r.ids)
    assert pieces.encode(docs(spark, [])).count() == 0


def test_suffix_array_orders_suffixes():
    codes = np.array([ord(c) for c in "banana\0bandana\0"], np.int64)
    text = "banana\0bandana\0"
    assert [text[i : i + 8] for i in pieces.suffix_array(codes, 8)] == sorted(text[i : i + 8] for i in range(len(text)))


# ---- pipeline -------------------------------------------------------------


def test_pipeline_decisions(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(7)
    rows, labels = labelled(spark, rng, 300, insult, "toxic")
    bench = {i: prose(rng, 40) for i in range(3)}
    clean = [t for i, t in rows if i % 4]
    rows += [(1000 + k, clean[k]) for k in range(10)]
    rows += [(2000 + k, clean[k] + " " + " ".join(bench[k % 3]) + " " + " ".join(prose(rng, 300))) for k in range(6)]
    rows += [(3000, " ".join(prose(rng, 80)) + " write to jane.roe@mail.example.net now")]
    base = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    sf = str(tmp_path)
    base.write.parquet(f"{sf}/documents.parquet")
    labels.withColumn("quality", F.lit(1)).write.parquet(f"{sf}/labels.parquet")
    items(spark, [(i, " ".join(w)) for i, w in bench.items()]).write.parquet(f"{sf}/benchmark.parquet")
    current, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(c.STAGES):
        current = stage(spark, current, sf)
        assert k == len(c.STAGES) - 1 or current.columns == base.columns
        current.write.parquet(f"{sf}/stage{k}")
        current = spark.read.parquet(f"{sf}/stage{k}")
        seen[name] = {r.doc_id: r for r in current.collect()}
    tox, near, leak, pii, last = seen.values()
    assert not [i for i in tox if i < 1000 and i % 4 == 0] and len([i for i in tox if i < 1000 and i % 4]) >= 220
    assert not [i for i in near if 1000 <= i < 1010] and set(near) | set(range(1000, 1010)) >= set(tox)
    assert not [i for i in leak if 2000 <= i < 2006] and set(leak) == {i for i in near if not 2000 <= i < 2006}
    assert set(pii) == set(leak) == set(last) and "jane.roe" not in pii[3000].text and pii[3000].n_chars == len(pii[3000].text)
    assert all(pii[i].text == leak[i].text for i in pii if i != 3000) and all(r.decodes for r in last.values())
    assert {(r.doc_id, tuple(r.ids)) for r in c.run(spark, sf).collect()} == {(i, tuple(r.ids)) for i, r in last.items()}

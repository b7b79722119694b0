"""Near-duplicates, quality, archives, language-model scores and the pipeline against plain versions."""

import hashlib
import io
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postwatch.llm import anchors, common, linking, maxent, minhash, near_dedup, quality, queries, warc
from tests.llm.conftest import prose

SF_DIR = "/root/testdata/sf0.001"


# --- near-duplicates ---------------------------------------------------------------------------------------------------


def families(rng):
    """Groups of near copies of all sizes, a group whose ends are alike only through its middle, and single texts."""
    pairs = []

    def add(words):
        pairs.append((len(pairs), " ".join(words)))

    for size in (2, 5, 40):
        base = prose(rng, 120).split()
        for _ in range(size):
            words = list(base)
            words[rng.randrange(120)] = prose(rng, 1)
            add(words)
    chain = prose(rng, 150).split()
    for k in range(12):  # each is alike to the next, the first is not to the last
        add(prose(random.Random(1), 60).split()[: 5 * k] + chain[5 * k :])
    for _ in range(20):
        add(prose(rng, 50).split())
    add(["few", "words"])
    add(["few", "words"])
    return pairs


def plain_groups(pairs):
    texts = [t or "" for _, t in pairs]
    parts = [near_dedup.counted(common.utf8(pa.array([t])))[1:] for t in texts]
    total = Counter(v for values, _ in parts for v in values.tolist())
    df = [np.array([total[v] for v in values.tolist()], np.uint32) for values, _ in parts]
    weighted = [(v, near_dedup.weighted(tf, near_dedup.idf_table(n, len(texts)))) for (v, tf), n in zip(parts, df)]
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    holders = {}
    for k, (values, _) in enumerate(parts):
        for v in values.tolist() or [None]:
            holders.setdefault(v, []).append(k)
    for a, b in {(a, b) for held in holders.values() for a in held for b in held if b < a}:
        if near_dedup.similarity(weighted[a], weighted[b]) >= near_dedup.THRESHOLD:
            up[max(root(a), root(b))] = min(root(a), root(b))
    ranked = [-(1 << 63) if k is None else k for k, _ in pairs]
    least = {}
    for k in range(len(texts)):
        least[root(k)] = min(least.get(root(k), 1 << 62), ranked[k])
    return [(pairs[k][0], None if least[root(k)] == -(1 << 63) else least[root(k)]) for k in range(len(texts))]


def test_sampling_estimates_weighted_jaccard():
    rng = random.Random(3)
    words = prose(rng, 300).split()
    hits, wanted = 0, 0.0
    for trial in range(40):
        own = prose(random.Random(trial), 300).split()
        cut = 20 + 7 * trial
        texts = common.utf8(pa.array([" ".join(own), " ".join(own[:cut] + words[cut:])]))
        doc, values, tf = near_dedup.counted(texts)
        weight = near_dedup.weighted(tf, near_dedup.idf_table(np.ones(len(values)), 1000))
        _, keys = near_dedup.drawn(doc, values, weight)
        hits += (keys[0] == keys[1]).sum()
        s = near_dedup.similarity(*[(values[doc == k], weight[doc == k]) for k in (0, 1)])
        wanted += near_dedup.BANDS * s**near_dedup.ROWS
    assert abs(hits - wanted) < 0.2 * wanted


@pytest.mark.parametrize("group_bytes", [1 << 24, 4000])
def test_groups(frame, rows, group_bytes):
    pairs = families(random.Random(12))
    found = near_dedup.classes(frame(pairs), group_bytes=group_bytes)
    assert rows(found, "id", "class_id") == sorted(plain_groups(pairs), key=repr)
    assert found.where("kept").count() == len({c for _, c in plain_groups(pairs)})


def test_groups_of_a_given_table(spark, rows):
    """All pairs that share a shingle, with exact df, against the operator, over 1,000 documents."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in documents.collect()]
    assert rows(near_dedup.groups(documents), "doc_id", "class_id") == sorted(plain_groups(pairs), key=repr)


def test_packed_hashes():
    values = np.unique(common.random_bits(5, 1000))
    assert near_dedup.unpacked(near_dedup.packed(values)).tolist() == values.tolist()
    assert near_dedup.unpacked(near_dedup.packed(values[:0])).tolist() == []


def test_odd_rows_and_one_of_each(frame, rows, odd):
    want = plain_groups(odd)
    assert rows(near_dedup.groups(frame(odd)), "doc_id", "class_id") == sorted(want, key=repr)
    kept = near_dedup.one_of_each(frame(odd))
    assert kept.columns == frame(odd).columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [*{c for _, c in want}, 48, None]))
    assert near_dedup.groups(frame([])).count() == 0 and near_dedup.one_of_each(frame([])).count() == 0


def test_near_copies_by_minhash(frame, rows, odd):
    pairs = families(random.Random(11)) + [(k if k is None else k + 100_000, t) for k, t in odd]
    texts = [t or "" for _, t in pairs]
    sets = [set(minhash.shingles(*common.separated(common.utf8(pa.array([t])), 32))[0].tolist()) for t in texts]
    up = list(range(len(pairs)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    members = {}
    for k, (doc_id, text) in enumerate(pairs):
        members.setdefault(root(k), []).append(anchors.NO_ID if doc_id is None else doc_id)
    public = lambda k: None if k == anchors.NO_ID else k
    want = [(public(i), public(min(group))) for group in members.values() for i in group]
    found = minhash.near_copies(frame(pairs))
    assert rows(found, "doc_id", "class_id") == sorted(want, key=repr)
    assert len({c for _, c in want}) < len(want) - 40
    assert minhash.near_copies(frame([])).count() == 0


def test_texts_without_words_are_one_group(frame, rows):
    found = near_dedup.groups(frame([(1, ""), (2, " "), (3, "\n\t"), (4, None), (5, "word"), (6, "other")]))
    assert rows(found, "doc_id", "class_id") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6)]


def test_frequencies_are_exact(frame, odd, monkeypatch):
    """df of each shingle by a plain count; with ranges and groups of few bytes as well."""
    pairs = families(random.Random(15)) + odd
    sets = {}
    total = Counter()
    for _, t in pairs:
        values = near_dedup.counted(common.utf8(pa.array([t or ""])))[1].tolist()
        sets[t or ""] = values
        total.update(values)
    assert len({v >> 44 for v in total}) < len(total)  # places of a table of 2**20 would be shared
    docs = anchors.keyed(frame(pairs))
    n_bytes = sum(len((t or "").encode()) for _, t in pairs)
    hashed = {r.x: r.text for r in docs.collect()}
    for group, reach in ((near_dedup.GROUP, near_dedup.RANGE), (5000, 3000)):
        monkeypatch.setattr(near_dedup, "GROUP", group)
        monkeypatch.setattr(near_dedup, "RANGE", reach)
        found = near_dedup.with_frequencies(docs, len(pairs), n_bytes).collect()
        assert len(found) == len(pairs)
        for r in found:
            assert np.frombuffer(r.df, np.uint32).tolist() == [total[v] for v in sets[hashed[r.x]]]


def plain_draws(doc, values, weight):
    """Bands by the formula of the sampling, one shingle after the other."""
    own, keys = near_dedup.draws(), []
    for d in sorted(set(doc.tolist())):
        v, level = values[doc == d], np.log(weight[doc == d])
        row = np.zeros((near_dedup.BANDS, 1), np.uint64)
        for k in range(near_dedup.SAMPLES):
            at = ((v * own.turn[k]) >> np.uint64(50)).astype(np.int64)
            t = np.floor(level * own.per_r[k][at] + own.beta[k][at])
            least = int(np.argmin(own.rest[k][at] - own.r[k][at] * t))
            drawn = v[least : least + 1] ^ common.mixed(t[least : least + 1].astype(np.int64).astype(np.uint64))
            band = k // near_dedup.ROWS
            row[band] = common.mixed(row[band] * np.uint64(0xC2B2AE3D27D4EB4F) + drawn + np.uint64(band))
        keys.append(row.ravel())
    return np.array(keys)


@pytest.mark.parametrize("block", [near_dedup._SHINGLES, 50])
def test_draws_by_weight_are_those_of_the_formula(monkeypatch, block):
    """Texts whose shingles have one weight, a few, and one each, and values that several shingles of a text share."""
    monkeypatch.setattr(near_dedup, "_SHINGLES", block)
    rng = np.random.default_rng(4)
    sizes = [1, 400, 3, 900, 60, 2000, 1]
    doc = np.repeat([0, 2, 3, 4, 7, 8, 9], sizes)
    values = np.concatenate([np.unique(common.random_bits(int(rng.integers(99)), n)) for n in sizes])
    few = np.array([1.0, 1.5, 1.75, 2.0, 2.5, 3.0, 3.5, 4.0])[rng.integers(8, size=len(doc))]
    for weight in (np.full(len(doc), 2.0), few, 1 + rng.random(len(doc)), np.where(doc == 3, 1.25, few)):
        has, keys = near_dedup.drawn(doc, values, weight.astype(np.float32))
        assert has.tolist() == [0, 2, 3, 4, 7, 8, 9]
        assert keys.tolist() == plain_draws(doc, values, weight.astype(np.float32)).tolist()


def test_counted_in_portions(odd, monkeypatch):
    texts = [t or "" for _, t in odd]
    whole = near_dedup.counted(common.utf8(pa.array(texts)))
    monkeypatch.setattr(near_dedup, "_TEXTS", 300)
    for a, b in zip(whole, near_dedup.counted(common.utf8(pa.array(texts)))):
        assert a.tolist() == b.tolist()
    want = []
    for k, t in enumerate(texts):
        found = Counter(minhash.shingles(*common.separated(common.utf8(pa.array([t])), 32))[0].tolist())
        want += [(k, v, n) for v, n in sorted(found.items())]
    assert list(zip(*(c.tolist() for c in whole))) == want


def carried(texts, n_docs):
    """Bodies of texts as they come to their comparisons, with one band each that all share."""
    parts = [near_dedup.counted(common.utf8(pa.array([t])))[1:] for t in texts]
    total = Counter(v for values, _ in parts for v in values.tolist())
    df = [np.array([total[v] for v in values.tolist()], np.uint32) for values, _ in parts]
    weighted = [(v, near_dedup.weighted(tf, near_dedup.idf_table(n, n_docs))) for (v, tf), n in zip(parts, df)]
    bodies = [(8).to_bytes(4, "big") + len(n.tobytes()).to_bytes(4, "big") + bytes(7) + b"\1" + n.tobytes() + t.encode() for t, n in zip(texts, df)]
    return bodies, weighted


def test_few_comparisons_in_a_component_of_unlike_texts():
    """Texts with most words from one base and some of their own are candidates of each other, but few are compared; no link is lost."""
    rng = random.Random(21)
    base, texts = prose(rng, 300).split(), [prose(rng, 2), "", " "]
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(300), 1 if k % 5 == 0 else 12):
            words[at] = prose(rng, 1)
        texts.append(" ".join(words))
    bodies, weighted = carried(texts, 1000)
    alike, keys = near_dedup._measure(1000, near_dedup.THRESHOLD)(bodies)
    want = {(a, b) for a in range(len(texts)) for b in range(a) if near_dedup.similarity(weighted[a], weighted[b]) >= near_dedup.THRESHOLD}
    assert {(a, b) for a in range(len(texts)) for b in range(a) if alike(a, b)} == want and 50 < len(want) < 1000
    assert all(set(keys[a]) & set(keys[b]) for a, b in want)
    tried = []
    members = [(k, k, bands) for k, bands in enumerate(near_dedup._bands_of(bodies))]
    links = list(linking.linked(members, lambda a, b: tried.append((a, b)) or alike(a, b), keys))
    assert set(links) <= want and len(tried) < len(texts) ** 2 / 8
    up = linking._Groups()
    other = linking._Groups()
    up.up, other.up = ({k: k for k in range(len(texts))} for _ in range(2))
    for groups, found in ((up, links), (other, want)):
        for a, b in found:
            groups.join(a, b)
    assert [up.root(k) for k in range(len(texts))] == [other.root(k) for k in range(len(texts))]


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    up = {}

    def root(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    moved = {a for e in edges if e[0] != e[1] for a in e}
    found = {r.node: r.root for r in linking.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert found == {k: root(k) for k in moved}


def test_linked_compares_across_groups_only():
    members = [(k, k, [1, 2]) for k in range(50)]
    tried = []
    alike = lambda a, b: tried.append((a, b)) or (a % 2 == b % 2)
    links = list(linking.linked(members, alike))
    assert len(links) == 48 and len(tried) < 50 * 26


# --- quality -----------------------------------------------------------------------------------------------------------


def test_quality_learns(spark, frame, odd):
    rng = random.Random(2)
    good = [(k, prose(rng, 80)) for k in range(400)]
    bad = [(1000 + k, " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in prose(rng, 80).split())) for k in range(150)]
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad] + [(None, 1, 0), (5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame(good + bad), labels)
    found = {r.doc_id: r for r in quality.scores(frame(good + bad), model).collect()}
    held = [r for r in found.values() if r.held_out]
    assert {r.doc_id for r in held} == {k for k, _ in good + bad if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id < 1000) for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found.values())
    kept = quality.keep_good(frame(good + bad + odd), model)
    assert kept.columns == frame(odd).columns and kept.where("doc_id >= 1000").count() < 15
    assert quality.scores(frame(odd), model).count() == len(odd) and quality.scores(frame([]), model).count() == 0


def test_quality_with_long_labelled_texts(spark, frame):
    """A labelled text longer than all that the dictionary takes shuts out no other, wherever it stands, and teaches itself."""
    rng = random.Random(4)
    bad = lambda n: " ".join(w.upper() + "$$$" for w in prose(rng, n).split())
    texts = {k: prose(rng, 80) if k < 300 else bad(80) for k in range(600)}
    order = [r.id for r in spark.range(600).where("xxhash64(id) % 2 = 0").where(quality.remainder("id") != 0).orderBy(F.xxhash64("id")).collect()]
    first = next(k for k in order if k < 300)
    line = texts[first] + " "
    texts[first] = line * (5 * (1 << 20) // len(line) + 1)
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in texts], "doc_id long, quality int, toxic int")
    docs = frame(list(texts.items()))
    found = quality.scores(docs, quality.fit(docs, labels)).where("held_out").collect()
    assert np.mean([r.predicted == (r.doc_id < 300) for r in found]) > 0.95
    assert quality.LONG_BYTES - quality.BLOCK <= len(quality.spread(texts[first].encode())) <= quality.LONG_BYTES
    assert quality.spread(b"short") == b"short" and quality.spread(b"") == b""


def test_quality_without_labels(spark, frame, odd):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.scores(frame(odd), quality.fit(frame(odd), nothing)).collect()} == {0.5}
    only_good = spark.createDataFrame([(k, 1, 0) for k in range(20)], nothing.schema)
    assert len({r.score for r in quality.scores(frame(odd), quality.fit(frame(odd), only_good)).collect()}) == 1


def test_quality_on_given_labels(spark):
    scores = queries.all_queries()["op7_quality"](spark, "/root/testdata/sf0.01")
    rows = scores.join(queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


# --- archives ----------------------------------------------------------------------------------------------------------


@pytest.fixture()
def pages(spark):
    rng = random.Random(11)
    long = [prose(rng, 200) for _ in range(6)]
    rows = [(k, f"http://h/{k}", rng.choice(long) if k % 3 == 0 else prose(rng, k)) for k in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: y", ""), (102, "u", "short"), (103, "u", "short"), (104, "u", "é" * 50), (99, "u", "é" * 50)]
    rows += [(105, "u", "WARC/1.1\r\n\r\n" * 20), (None, "u", long[0]), (0, "twice", rows[0][2]), (106, "u", prose(rng, 60_000))]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(3)


def plain_records(rows):
    first = {}
    for k, _, html in rows:
        first[html or ""] = min(first.get(html or "", 1 << 62), -(1 << 63) if k is None else k)
    out = []
    for k, _, html in rows:
        body = (html or "").encode()
        again = len(body) >= 100 and first[html or ""] < (-(1 << 63) if k is None else k)
        refers = first[html or ""] if again and first[html or ""] != -(1 << 63) else None
        out.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [300, 5000, 1 << 23])
def test_archives(spark, rows, pages, range_bytes):
    given, table = pages
    files = warc.write(table, common.fresh_dir(spark, "warc"), file_bytes=3_000)
    assert files.count() > 3
    found = warc.read(files, range_bytes=range_bytes)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows(found, *columns) == plain_records(given)
    bodies = {r.page_id: bytes(r.payload).decode() for r in found.where("record_type = 'response'").collect()}
    assert bodies[106] == dict((k, h) for k, _, h in given)[106] and bodies[100] == ""
    assert rows(warc.round_trip(spark, table)) == rows(found, *columns)


def test_archives_empty(spark, pages):
    assert warc.round_trip(spark, pages[1].where("page_id = -1")).count() == 0


def test_records_begin_where_headers_decode():
    member = warc._record(7, "http://h", "page", hashlib.sha256(b"page").hexdigest(), 4, None)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # a member inside a member, and bare magic
    inner = warc._record(8, None, "x", "0", 1, None)
    outer = stored.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\n" + inner + b"\x1f\x8b\x08" * 5) + stored.flush()
    body = member + outer + member
    for start in range(0, len(body), 7):
        found = list(warc.records(io.BytesIO(body), len(body), start, len(body)))
        want = sum(at >= start for at in (0, len(member), len(member) + len(outer)))
        assert len(found) == want


# --- language model ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("frequent", [100_000, 40, 0])
def test_base_scores(frame, odd, frequent):
    rng = random.Random(13)
    pairs = odd + [(100 + k, prose(rng, 30, "abc")) for k in range(60)] + [(200, "Is IS is É é")]
    fold = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    remainder = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7
    counts = Counter(w for k, t in pairs if remainder(k) != 2 for w in fold(t))
    n, v = sum(counts.values()), len(counts)
    want = {}
    for k, t in pairs:
        words = fold(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want.setdefault(k, []).append((remainder(k) == 2, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    got = {}
    for r in maxent.scores(frame(pairs), frequent).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
        assert r.score < 0
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_model_is_a_distribution_and_learns(spark):
    """Probabilities of all classes and words add up to one, and held-out texts with order in them score above the base."""
    rng = random.Random(14)
    line = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(400):
        at = rng.randrange(30)
        rows.append((k, " ".join(line[(at + j) % 30] for j in range(40))))
    found = maxent.scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in found) > 0.9 * sum(r.base_score for r in found)
    counts = spark.createDataFrame([(f"w{k}", k + 1, 1 + 7 * k) for k in range(50)], "word string, h long, c long")
    model = maxent.prepare(counts, 20)
    model.weights += np.random.default_rng(1).normal(0, 1, model.weights.shape).astype(np.float32)
    share = np.exp(model.logits(np.array([[3], [9000]])))[0]
    share = share / share.sum()
    within = np.bincount(model.kinds, 10.0**model.within, maxent.CLASSES - maxent.RARE_CLASSES)
    assert np.allclose(within[np.unique(model.kinds)], 1) and abs(share.sum() - 1) < 1e-5


def _packed_model(spark):
    """A model of the more frequent half of 50 words, and all words after three contexts with made-up counts."""
    counts = spark.createDataFrame([(f"w{k}", (k + 1) << 57, 1 + 7 * k) for k in range(50)], "word string, h long, c long")
    model = maxent.prepare(counts, 25)
    rng = np.random.default_rng(2)
    model.weights += rng.normal(0, 1, model.weights.shape).astype(np.float32)
    words = np.append(np.arange(len(model.hashes)), maxent._RARE_WORD + np.arange(maxent.RARE_CLASSES))
    keys = np.array([5, 1 << 40, (1 << 46) + 9])
    token = ((keys[:, None] << maxent._WORD_BITS) + words).ravel().astype(np.uint64)
    n = rng.integers(0, 4, len(token)) * rng.integers(0, 2, len(token))
    n[: len(words)] = 0  # a context that no learning row holds
    return model, token, n


def test_trained_contexts_are_distributions(spark):
    model, token, n = _packed_model(spark)
    w = len(model.hashes)
    found = 10.0 ** maxent.token_scores(model, token, n).reshape(3, -1)
    found[:, w:] *= model.rare_total  # the mass of all words of a rare class
    assert np.allclose(found.sum(axis=1), 1, atol=1e-5)
    plain = maxent.token_scores(model, token, np.zeros_like(n)).reshape(3, -1)
    assert np.allclose(np.log10(found[0, :w]), plain[0, :w])
    assert (np.log10(found[:, :w]) > plain[:, :w])[n.reshape(3, -1)[:, :w] >= 2].mean() > 0.9


def test_trained_contexts_against_small_steps(spark):
    """The weights that the shards settle at are those of plain gradient steps on the same likelihood and ridge."""
    model, token, n = _packed_model(spark)
    w = len(model.hashes)
    kinds = np.append(model.kinds[np.argsort(model.rank)], np.arange(maxent.CLASSES - maxent.RARE_CLASSES, maxent.CLASSES))
    share = np.append(10.0 ** model.within[np.argsort(model.rank)], 1 / model.rare_total)
    mask = (1 << maxent.BITS) - 1
    want, size = [], len(token) // 3
    for k in range(3):
        key, seen = int(token[size * k]) >> maxent._WORD_BITS, n[size * k : size * k + size]
        rows = [[key >> maxent.BITS + maxent._EXTRA], [(key >> maxent._EXTRA & mask) + (1 << maxent.BITS)]]
        fixed, times = model.logits(np.array(rows))[0].astype(float), np.bincount(kinds, seen, maxent.CLASSES)
        of_class, of_word = np.zeros(maxent.CLASSES), np.zeros(w)
        for _ in range(4000):
            p = np.exp(fixed + of_class)
            of_class += 0.02 * (times - times.sum() * p / p.sum() - maxent.CLASS_RIDGE * of_class)
            q = share[:w] * np.exp(of_word)
            inside = q / np.bincount(kinds[:w], q, maxent.CLASSES)[kinds[:w]]
            step = seen[:w] - times[kinds[:w]] * inside - maxent.WORD_RIDGE * of_word
            of_word += 0.02 * step * (seen[:w] > 0)  # a word that was not seen has no weight
        p, q = np.exp(fixed + of_class), np.append(share[:w] * np.exp(of_word), share[w:])
        inside = np.append(q[:w] / np.bincount(kinds[:w], q[:w], maxent.CLASSES)[kinds[:w]], share[w:])
        want.append(np.log10(p / p.sum())[kinds] + np.log10(inside))
    assert np.abs(maxent.token_scores(model, token, n) - np.concatenate(want)).max() < 0.03


def test_packed_tokens_keep_every_occurrence(spark, monkeypatch):
    """What the shards get are the tokens of the texts, repeats counted; hot contexts are dealt into parts, others stay whole."""
    model = _packed_model(spark)[0]
    rng = np.random.default_rng(3)
    hashes = rng.choice(np.append(model.hashes, np.arange(5, dtype=np.uint64)), 5000)
    doc = np.sort(rng.integers(0, 40, 5000))
    at, kinds = model.look_up(hashes)
    held_out = np.arange(40) % 5 == 0
    for hot, parts in ((1 << 20, 1), (40, 7)):
        monkeypatch.setattr(maxent, "HOT", hot)
        rows, shards = Counter(), {}
        for shard, body in maxent.packs(model, 16, 3, *maxent.before(hashes, doc), at, kinds, doc, held_out):
            token, flags, n = maxent._from_planes(body, "uint64", "uint32", "uint32")
            for t, f, k in zip(np.cumsum(token, dtype=np.uint64).tolist(), flags.tolist(), n.tolist()):
                assert (f & 1) == (not held_out[f >> 1])
                rows[f >> 1, t & (1 << maxent._WORD_BITS) - 1] += k
                shards.setdefault(t >> maxent._WORD_BITS, set()).add(shard)
        word = np.where(at >= 0, model.rank[at], maxent._RARE_WORD + kinds - (maxent.CLASSES - maxent.RARE_CLASSES))
        assert rows == Counter(zip(doc.tolist(), word.tolist()))
        assert 1 <= max(map(len, shards.values())) <= parts and (parts == 1 or max(map(len, shards.values())) > 1)


def _shard_rows(model, rng, n_contexts):
    """Rows of a shard as they come to a task: three groups of texts, and counts of two contexts that are dealt (group -1)."""
    words = np.append(np.arange(len(model.hashes)), maxent._RARE_WORD + np.arange(maxent.RARE_CLASSES)).astype(np.uint64)
    keys = np.sort(rng.choice(1 << 47, n_contexts, replace=False)).astype(np.uint64)
    bodies, groups = [], [7, 3, 9, -1]
    for group in groups:
        key = rng.choice(keys, 20 * n_contexts) if group >= 0 else np.repeat(keys[[0, n_contexts // 2]], len(words))
        token = np.sort((key << np.uint64(maxent._WORD_BITS)) + (rng.choice(words, len(key)) if group >= 0 else np.tile(words, 2)))
        flags = rng.integers(0, 80, len(token)) if group >= 0 else np.ones(len(token))
        n = rng.integers(1, 4 if group >= 0 else 90, len(token))
        bodies.append(maxent._planes(np.diff(token, prepend=np.uint64(0)), flags.astype(np.uint32), n.astype(np.uint32)))
    rows = [pa.array(groups), pa.array([0] * 4, pa.int32()), pa.array([False] * 4), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(rows, ["group", "shard", "texts", "body"])


def test_a_shard_is_trained_in_portions(spark, monkeypatch):
    """Contexts of a shard are trained a portion at a time, with the replies that all at once give."""
    model, rows = _packed_model(spark)[0], _shard_rows(_packed_model(spark)[0], np.random.default_rng(21), 150)
    replies, sizes = [], []
    real = maxent.token_scores
    monkeypatch.setattr(maxent, "token_scores", lambda model, token, n: sizes[-1].append(token) or real(model, token, n))
    for portion in (1 << 30, 500, 1):
        monkeypatch.setattr(maxent, "_PORTION", portion, raising=False)
        sizes.append([])
        found = pa.Table.from_batches(maxent._fit(model)(iter([rows])))
        assert found.column("group").to_pylist() == [7, 3, 9]
        replies.append([maxent._from_planes(body.as_py(), "uint32", "float32") for body in found.column("body")])
    for other in replies[1:]:
        for (text, score), (text_, score_) in zip(replies[0], other):
            assert np.array_equal(text, text_) and np.allclose(score, score_, rtol=1e-5)
    contexts = [[set((token >> np.uint64(maxent._WORD_BITS)).tolist()) for token in part] for part in sizes]
    assert len(contexts[0]) == 1 and len(contexts[1]) > 9 and len(contexts[2]) == 150 and max(map(len, contexts[2])) == 1
    for part in contexts:
        assert sum(map(len, part)) == len(set().union(*part)) == 150  # a context is never cut


def test_memory_of_a_shard_and_of_packing(spark, monkeypatch):
    """A task holds less than 70 bytes for each token of a shard, and of a packed group little when it reads the next one."""
    model = _packed_model(spark)[0]
    rows = _shard_rows(model, np.random.default_rng(22), 10_000)
    monkeypatch.setattr(maxent, "_PORTION", 1 << 15, raising=False)
    tracemalloc.start()
    try:
        for _ in maxent._fit(model)(iter([rows])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 70 * 600_000

        rng, held = random.Random(23), []
        texts = [prose(rng, 40_000) for _ in range(3)]
        maxent.tokens(common.utf8(pa.array(texts[:1])))  # tables that are made once
        monkeypatch.setattr(maxent, "_FLUSH", 1 << 16)
        monkeypatch.setattr(maxent, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
        model.hot = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def batches():
            for k, text in enumerate(texts):
                held.append(tracemalloc.get_traced_memory()[0])
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([False]), pa.array([text])], ["doc_id", "held_out", "text"])

        for row in maxent._pack(model, 4)(batches()):
            del row
        assert max(held) - held[0] < 110 * 40_000
    finally:
        tracemalloc.stop()


def test_scores_do_not_depend_on_dealing(frame, monkeypatch):
    """Contexts that are dealt into parts get the weights that they have in one piece; equal texts score alike."""
    rng = random.Random(15)
    words = ["of", "the", "a"] + [f"w{k}" for k in range(12)]
    pairs = [(k, " ".join(rng.choices(words, [9, 9, 6] + [1] * 12, k=rng.randint(0, 60)))) for k in range(300)]
    pairs += [(400 + k, pairs[k][1]) for k in range(40)]
    found = []
    for hot, parts in ((1 << 20, 1), (40, 2)):
        monkeypatch.setattr(maxent, "HOT", hot)
        dealt = []
        monkeypatch.setattr(maxent, "_pack", lambda model, n, real=maxent._pack: dealt.append(model.hot) or real(model, n))
        found.append({r.doc_id: r for r in maxent.scores(frame(pairs), frequent=8).collect()})
        monkeypatch.undo()
        assert max(dealt[0][1].tolist(), default=1) >= parts and (len(dealt[0][0]) > 0) == (parts > 1)
    whole, cut = found
    assert set(whole) == set(cut) == {k for k, _ in pairs}
    for k in whole:
        assert whole[k].base_score == pytest.approx(cut[k].base_score) and whole[k].score == pytest.approx(cut[k].score, abs=1e-4)
    for k in range(40):
        assert cut[k].score == pytest.approx(cut[400 + k].score, abs=1e-4)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_gradient_against_a_plain_one(spark, frame, monkeypatch, spread):
    """Summed over tasks and portions it is that of each token alone; without weights, too."""
    model = _packed_model(spark)[0]
    model.weights = (np.random.default_rng(4).normal(0, 1, model.weights.shape) * spread).astype(np.float32)
    monkeypatch.setattr(maxent, "_PAIRS", 50)
    monkeypatch.setattr(maxent, "_TOKENS", 16)
    rng = random.Random(17)
    texts = [(k, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 9)))) for k in range(60)] + [(70, None)]
    _, _, _, hashes, doc, _ = maxent.tokens(common.utf8(pa.array([text or "" for _, text in texts])))
    rows, kinds = maxent.features(*maxent.before(hashes, doc)), model.look_up(hashes)[1]
    p = np.exp(model.logits(rows).astype(float))
    own = np.column_stack([np.eye(maxent.CLASSES)[kinds] - p / p.sum(axis=1, keepdims=True), np.ones(len(kinds))])
    want = np.zeros((2 << maxent.BITS, maxent.CLASSES + 1))
    for row in rows:
        np.add.at(want, row, own)
    found = np.zeros_like(want).reshape(-1, 64 * (maxent.CLASSES + 1))
    for block, values in common.summed(frame(texts).select("text").mapInArrow(maxent._gradient(model), common.BLOCKS), "float32"):
        found[block] = values
    assert np.allclose(found.reshape(want.shape), want, atol=1e-4)


def test_equal_pairs_of_rows_are_worked_out_once(spark, monkeypatch):
    model = _packed_model(spark)[0]
    done = []
    monkeypatch.setattr(maxent, "_softmax", lambda logits, real=maxent._softmax: done.append(logits.shape[1]) or real(logits))
    rng = np.random.default_rng(6)
    pairs = rng.integers(0, 50, 4000).astype(np.uint32) << np.uint32(maxent.BITS) | rng.integers(0, 20, 4000).astype(np.uint32)
    total = np.zeros((maxent.CLASSES, 2 << maxent.BITS))
    maxent._expected(model, pairs, np.ascontiguousarray(model.weights.T), total)
    assert sum(done) == len(np.unique(pairs)) <= 1000
    half = 1 << maxent.BITS
    assert np.allclose(total[:, :half].sum(axis=0), np.bincount(pairs >> maxent.BITS, minlength=half), rtol=1e-5)
    assert np.allclose(total[:, half:].sum(axis=0), np.bincount(pairs & (half - 1), minlength=half), rtol=1e-5)


def test_look_up_finds_the_place_of_each_word(spark):
    model = _packed_model(spark)[0]
    rng = np.random.default_rng(5)
    model.hashes = np.unique(np.append(rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2), np.arange(40, dtype=np.uint64)))
    model.kinds = np.arange(len(model.hashes)) % 7
    asked = np.concatenate([model.hashes, model.hashes + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    place = {h: k for k, h in enumerate(model.hashes.tolist())}
    assert model.look_up(asked)[0].tolist() == [place.get(h, -1) for h in asked.tolist()]


def test_words_counted_over_a_task(frame, monkeypatch):
    """Counts are those of all texts, however often a task sends what it holds, and words longer than a chunk are whole."""
    rng = random.Random(16)
    pairs = [(k, " ".join(rng.choices("abcdefghij", k=20))) for k in range(60)] + [(70, "x" * 5000 + " a"), (71, None)]
    want = Counter(w for _, text in pairs for w in [*(text or "").split(), ""])
    for held, chunk in ((1 << 17, 1 << 20), (4, 64)):
        monkeypatch.setattr(maxent, "_HELD", held)
        monkeypatch.setattr(common, "CHUNK_BYTES", chunk)
        assert {r.word: r.c for r in maxent.count_words(frame(pairs)).collect()} == want


def test_held_out_gain_on_the_given_table(spark):
    """Over the documents of the smallest given table; texts whose copies were learned score far above the base."""
    found = maxent.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    model, base = (sum(r[c] for r in found) / sum(r.n_tokens for r in found) for c in ("score", "base_score"))
    assert model > base + 0.05
    assert all(abs(r.token_score * r.n_tokens - r.score) < 1e-6 for r in found)


def test_scores_of_empty_table(frame):
    assert maxent.scores(frame([])).count() == 0


# --- queries and the pipeline ------------------------------------------------------------------------------------------


def test_every_operator_has_a_query():
    names = queries.all_queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(queries.all_oracles()) <= set(names)


@pytest.mark.parametrize("name", list(queries.all_oracles()))
def test_equals_sql(spark, name):
    from checks import compare

    columns = sorted((frame := queries.all_queries()[name](spark, SF_DIR)).columns)
    twin = compare.connect(SF_DIR).sql(queries.all_oracles()[name])
    assert sorted(twin.columns) == columns
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, twin.select(*columns).fetchall()))


def test_pipeline_of_odd_rows(spark, frame, odd, monkeypatch):
    """Nulls, repeated rows, clashing columns and an empty table through the whole chain; the tagger is hardly trained."""
    fit = corpus_pipeline.pii.fit
    monkeypatch.setattr(corpus_pipeline.pii, "fit", lambda docs: fit(docs, steps=2))
    for docs in (frame(odd), frame([])):
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.staged(stage(spark, docs, SF_DIR), "test")
            left = docs.count()
            assert docs.columns == columns and left <= n and (name != "personal_data" or left == n)
            n = left
        ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
        assert len(ids) == n and all(r.n_tokens == len(r.ids) for r in ids)


def test_pipeline_stages(spark):
    """Each stage against what its operator says of its own input; columns stay those of documents until the last."""
    docs = queries.table(spark, SF_DIR, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontaminate", "personal_data", "tokens"]
    model = quality.fit(docs, queries.table(spark, SF_DIR, "labels"))
    good = {r.doc_id for r in quality.scores(docs, model).where("predicted = 1").collect()}
    kept = common.staged(stages["quality"](spark, docs, SF_DIR), "test")
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == columns
    want = plain_groups([(r.doc_id, r.text) for r in kept.orderBy("doc_id").collect()])
    kept = common.staged(stages["near_duplicates"](spark, kept, SF_DIR), "test")
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want} and kept.columns == columns
    clean = common.staged(stages["decontaminate"](spark, kept, SF_DIR), "test")
    from tests.llm.test_texts import plain_hits

    items = [(r.item_id, r.text) for r in queries.table(spark, SF_DIR, "benchmark").collect()]
    hits = plain_hits([(r.doc_id, r.text) for r in kept.collect()], items)
    assert {r.doc_id for r in clean.collect()} == {h[0] for h in hits if not h[5]} and clean.columns == columns
    masked = common.staged(stages["personal_data"](spark, clean, SF_DIR), "test")
    rows = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == columns and len(rows) == clean.count()
    from postwatch.llm import pii

    for doc_id, row in rows.items():
        assert pii.base_spans(before[doc_id].text) == [] or row.text != before[doc_id].text
        assert not pii.base_spans(row.text) and row.n_chars == len(row.text)
        assert row.text == before[doc_id].text or any(f"<{kind}>" in row.text for kind in pii.KINDS)
    ids = stages["tokens"](spark, masked, SF_DIR)
    assert ids.count() == len(rows) and "doc_id" in ids.columns


def test_pipeline_runs(spark):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.count() > 100 and found.where("n_tokens <> size(ids)").isEmpty()

"""Hard negatives, ranked search and token counts against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postwatch.llm import bpe, common, hard_negatives, lexical, token_counts
from tests.llm.conftest import prose

# --- hard negatives ----------------------------------------------------------------------------------------------------


@pytest.fixture()
def vectors(spark):
    def make(rows, partitions=3):
        schema = "vec_id long, embedding array<float>, label int, r long, id string, v int, cell int, positives string"
        return spark.createDataFrame([(*row, 1, "x", 2, 3, "p") for row in rows], schema).repartition(partitions)

    return make


def plain_negatives(rows, asks, window=(30, 90)):
    kept = []
    for k, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((-(1 << 63) if k is None else k, [math.floor(256 * float(np.float32(c))) for c in x], label))
    out = []
    for at, (anchor, v, label) in enumerate(kept):
        if not asks(anchor):
            continue
        score = [max(1 - (1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))) for _, w, _ in kept]
        order = sorted((k for k in range(len(kept)) if k != at), key=lambda k: (-score[k], kept[k][0]))
        for p in [k for k in order if kept[k][2] == label][:5]:
            found = [k for k in order if kept[k][2] != label and window[0] * score[p] <= 100 * score[k] <= window[1] * score[p]]
            out += [(anchor, kept[p][0], rank, kept[k][0], score[p], score[k]) for rank, k in enumerate(found[:10], 1)]
    return sorted(out, key=repr)


def mined(frame):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0)
    assert found.columns == columns
    return sorted(((*(-(1 << 63) if x is None else x for x in row),) for row in found.collect()), key=repr)


def some_vectors(n, width=6, scale=1.0, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    return [(k, (scale * (centres[k % 4] + rng.normal(size=width)) / 4).astype(np.float32).tolist(), int(k % 4) if k % 9 else int(k % 3)) for k in range(n)]


@pytest.mark.parametrize("scale", [1.0, 3e4, 2e7], ids=["several to a word", "one to a word", "wider than a word"])
def test_hard_negatives(vectors, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "_TILE", 3)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 40)
    rows = some_vectors(150, scale=scale)
    expected = plain_negatives(rows, lambda k: k % 10 == 0)
    assert expected and mined(vectors(rows)) == expected


def test_hard_negatives_odd_rows(vectors):
    """Nulls, ties, copies, short and empty vectors, values that are not finite."""
    rows = some_vectors(60)
    same = rows[0][1]
    rows += [(100 + k, same, k % 2) for k in range(40)]  # ties go by id
    rows += [(None, same, 0), (200, None, 0), (201, same, None), (202, [1.0, None], 0), (203, [float("nan")] * 6, 1), (204, [float("inf")] + [0.0] * 5, 1)]
    rows += [(210, [], 0), (211, [0.5], 1), (212, [0.25, -0.5], 0), (220, [0.0] * 6, 7), (-10, [-x for x in same], 0)]
    expected = plain_negatives(rows, lambda k: k % 10 == 0 and k != -(1 << 63))
    assert mined(vectors(rows)) == expected
    twice = rows + rows[:21]
    assert mined(vectors(twice)) == plain_negatives(twice, lambda k: k % 10 == 0 and k != -(1 << 63))


def test_hard_negatives_one_label_or_none(vectors):
    assert mined(vectors([(k, [1.0, 0.5], 3) for k in range(30)])) == []
    assert mined(vectors([])) == []
    assert mined(vectors([(1, [0.1], 1)])) == []
    assert mined(vectors([(0, None, None)])) == []


@pytest.mark.parametrize("most", [4, 700, 1 << 30, 1 << 61, 1 << 80])
def test_packed_products_are_exact(most):
    rng = random.Random(most)
    side = math.isqrt(most // 4)
    side = min(side, (1 << 62) - 1)
    rows = np.array([[rng.randint(-side, side) for _ in range(4)] for _ in range(11)], np.int64)
    anchors = np.array([[rng.randint(-side, side) for _ in range(4)] for _ in range(3)], np.int64)
    found = hard_negatives.Packed(rows, most).scores(anchors)
    low, high = -(1 << 63) + 1, (1 << 63) - 1
    assert found.tolist() == [[max(low, min(high, sum(int(x) * int(y) for x, y in zip(a, c)))) for c in rows] for a in anchors]


# --- ranked search -----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(pairs, items, k=10):
    docs = [(-(1 << 63) if i is None else i, Counter(TERM.findall((t or "").translate(_LOWER)))) for i, t in pairs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(_LOWER)))
        ranked = []
        for i, c, n in docs:
            m = 25 + (75 * n * n_docs) // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                ranked.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=repr)


def searched(documents, items, **options):
    found = lexical.search(documents, items, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((a, b, -(1 << 63) if c is None else c, d) for a, b, c, d in found.collect()), key=repr)


@pytest.fixture()
def asked(spark):
    return lambda pairs: spark.createDataFrame([(k, t, 1, "x") for k, t in pairs], "item_id long, text string, r long, id string")


def topical(rng, n):
    """Texts about few topics with words of a skewed frequency, and copies."""
    words = [prose(rng, 1) for _ in range(300)]
    texts = []
    for k in range(n):
        topic = rng.randrange(6) * 50
        texts.append(" ".join(words[topic + int(50 * rng.random() ** 3)] if rng.random() < 0.7 else words[int(300 * rng.random() ** 2)] for _ in range(rng.randint(3, 60))))
    return texts + texts[:20] * 3


@pytest.mark.parametrize("shard, item_bytes", [(1 << 19, 8 << 20), (700, 900)], ids=["one shard", "many shards and blocks of items"])
def test_ranked_search(frame, asked, odd, shard, item_bytes):
    rng = random.Random(5)
    texts = topical(rng, 400)
    pairs = list(enumerate(texts)) + [((k or 0) + 5000 if k is not None else None, t) for k, t in odd]
    items = [(k, " ".join(rng.sample(texts, 1)[0].split()[:12])) for k in range(25)] + [(30, None), (31, " .,"), (32, "nowhere"), (33, odd[0][1]), (7, texts[3]), (7, texts[3])]
    items += [(None, texts[0].upper()), (34, (odd[31][1] or "") + " " + texts[9])]
    assert searched(frame(pairs), asked(items), shard=shard, item_bytes=item_bytes) == plain_search(pairs, items)


def test_ranked_search_passes_blocks_over(monkeypatch):
    """Blocks are left unscored, and the best are still those of a full ranking."""
    rng = random.Random(8)
    texts = topical(rng, 1500)
    items = lexical.Items(pa.array(range(20)), pa.array([" ".join(t.split()[:9]) for t in texts[:20]]))
    data, starts, ends, doc = lexical.terms_of(common.utf8(pa.array(texts)))
    number = items.numbers(data, starts, ends)
    key, tf = np.unique(doc[number >= 0] * len(items.vocabulary) + number[number >= 0], return_counts=True)
    term, of = key % len(items.vocabulary), key // len(items.vocabulary)
    sizes, n = np.bincount(of, minlength=len(texts)), np.bincount(doc, minlength=len(texts))
    weights = lexical.Weights(items, len(texts), len(doc), dict(Counter(term.tolist())))
    held = np.flatnonzero(sizes)
    shard = lexical.Shard(weights, held, n[held], sizes[held], term, tf)
    scored = []
    whole = shard.scores
    monkeypatch.setattr(shard, "scores", lambda docs, weight: scored.append(len(docs)) or whole(docs, weight))
    for item in range(20):
        best, every = lexical.Best(10), np.zeros(weights.size, np.int64)
        shard.search(item, best)
        every[weights.items[item][0]] = weights.items[item][1]
        full = whole(np.arange(len(held)), every)
        order = np.lexsort((held, -full))[:10]
        assert best.score.tolist() == full[order].tolist() and best.id.tolist() == held[order].tolist()
    assert sum(scored) < 0.6 * 20 * len(held)


def test_summaries_bound_every_document():
    rng = random.Random(2)
    texts = topical(rng, 300)
    items = lexical.Items(pa.array([0, 1]), pa.array([" ".join(texts[:3]), " ".join(texts[3:6])]))
    data, starts, ends, doc = lexical.terms_of(common.utf8(pa.array(texts)))
    number = items.numbers(data, starts, ends)
    key, tf = np.unique(doc[number >= 0] * len(items.vocabulary) + number[number >= 0], return_counts=True)
    term, of = key % len(items.vocabulary), key // len(items.vocabulary)
    held, sizes = np.unique(of, return_counts=True)
    weights = lexical.Weights(items, len(texts), len(doc), dict(Counter(term.tolist())))
    shard = lexical.Shard(weights, held, np.bincount(doc)[held], sizes, term, tf)
    for t in range(weights.size):
        docs, offsets, at, most = shard.blocks(t)
        known = dict(zip(at.tolist(), most.tolist()))
        expected: dict[int, int] = {}
        for block in range(len(offsets) - 1):
            for d in docs[offsets[block] : offsets[block + 1]]:
                for c, impact in zip(shard.term[shard.first[d] :][: sizes[d]], shard.impact[shard.first[d] :][: sizes[d]]):
                    if c in weights.company(t):
                        where = int(c) * (len(offsets) - 1) + block
                        expected[where] = max(expected.get(where, 0), int(impact))
        assert known == expected


def test_ranked_search_empty(frame, asked):
    assert searched(frame([(1, "a b")]), asked([])) == []
    assert searched(frame([]), asked([(1, "a b")])) == []
    assert searched(frame([(1, None), (2, "-")]), asked([(1, "a b"), (2, None)])) == []


# --- token counts ------------------------------------------------------------------------------------------------------


def test_token_counts_equal_library(frame, odd):
    rng = random.Random(4)
    own = Tokenizer.from_file(bpe.default_path())
    pairs = odd + [(900, "don't STOP <|endoftext|>now<|startoftext|>"), (901, "数据 Größe ΣΑΣ 🙂🙂 İstanbul é"), (902, "".join(rng.choice("abcdefgh") for _ in range(5000)))]
    pairs += [(903, "a" * 4000), (904, " ".join("xyz123" for _ in range(3000)))]
    found = token_counts.counts(frame(pairs))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = []
    for k, t in pairs:
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        expected.append((k, len((t or "").encode()), n, n > 2048))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert token_counts.counts(frame([])).collect() == []


def test_long_word_is_merged_in_time():
    rng = random.Random(6)
    own = Tokenizer.from_file(bpe.default_path())
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    merges = token_counts.merges(bpe.default_path())
    assert merges[word] == len(own.encode(word, add_special_tokens=False).ids)
    assert word not in merges  # long words are not kept


def test_counts_do_not_depend_on_the_cache(monkeypatch):
    rng = random.Random(7)
    words = [prose(rng, 1) for _ in range(300)]
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 10)
    small, whole = token_counts.Merges(bpe.default_path()), bpe.tokenizer(bpe.default_path())
    assert [small[w] for w in words] == [len(x) for x in whole.encode(words)]
    assert len(small) <= 10

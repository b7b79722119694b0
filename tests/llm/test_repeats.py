"""Substring and phrase dedup against plain versions, also with bounds so low that every hot path runs."""

import hashlib
import random
import re

import numpy as np
import pytest

from postwatch.llm import phrases, substrings
from tests.llm.conftest import prose


def ranked(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def plain_substrings(pairs, length=400):
    texts = [(t or "").encode() for _, t in pairs]
    seen = {}
    for t in texts:
        for at in range(len(t) - length + 1):
            seen[t[at : at + length]] = seen.get(t[at : at + length], 0) + 1
    out = []
    for (doc_id, _), t in zip(pairs, texts):
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - length + 1):
            if seen[t[at : at + length]] > 1:
                gone[at : at + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def plain_phrases(pairs, window=13):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in pairs]
    first = {}
    for (doc_id, _), words in zip(pairs, split):
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, ranked(doc_id)), ranked(doc_id))
    out = []
    for (doc_id, _), words in zip(pairs, split):
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < ranked(doc_id):
                gone[at : at + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def crowded():
    """A passage that many texts share and continue in many ways, texts that repeat within themselves, copies."""
    rng = random.Random(2)
    shared, twice = prose(rng, 150), prose(rng, 90)
    texts = [prose(rng, rng.randint(0, 90)) + " " + shared + rng.choice([" a", " b ", "", " " + prose(rng, 3)]) + prose(rng, 40) for _ in range(50)]
    texts += [prose(rng, 30) + twice + prose(rng, 40) + twice for _ in range(15)]
    texts += [prose(rng, 80) for _ in range(15)] + ["x" * 399, "x" * 400, "y" * 1000, "ab" * 450]
    return list(enumerate(texts + texts[5:7] + texts[5:6]))


@pytest.mark.parametrize("hot", [2000, 3])
def test_substrings_crowded(frame, rows, crowded, hot):
    found = substrings.remove_repeats(frame(crowded), hot=hot).drop("kept")
    assert rows(found) == plain_substrings(crowded)


@pytest.mark.parametrize("hot", [2000, 4])
def test_phrases_crowded(frame, rows, crowded, hot):
    found = phrases.remove_repeats(frame(crowded), hot=hot).drop("kept")
    assert rows(found) == plain_phrases(crowded)


def test_odd_rows(frame, rows, odd):
    assert rows(substrings.remove_repeats(frame(odd)).drop("kept")) == plain_substrings(odd)
    assert rows(phrases.remove_repeats(frame(odd)).drop("kept")) == plain_phrases(odd)


@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings_of_periodic_text(frame, rows, hot):
    """Text that repeats in itself only, by periods below and above a window's grams, alone and beside other text."""
    rng = random.Random(4)
    pairs = [(k, "".join(rng.choice("abcdé") for _ in range(period)) * (2500 // period)) for k, period in enumerate((1, 2, 3, 7, 60, 300, 336, 350, 399))]
    pairs += [(20, prose(rng, 60) + "q" * 401 + prose(rng, 60)), (21, "z" * 401), (22, "z." * 200), (23, "-" * 2000 + "=" * 2000 + "-" * 700)]
    assert rows(substrings.remove_repeats(frame(pairs), hot=hot).drop("kept")) == plain_substrings(pairs)


@pytest.mark.parametrize("period", ["e", "ab", "abcdefg"])
def test_substrings_of_megabytes_of_one_period(frame, rows, period):
    rng = random.Random(6)
    ends = prose(rng, 20), prose(rng, 20)
    n = 6_000_000 // len(period) * len(period)
    (row,) = rows(substrings.remove_repeats(frame([(1, ends[0] + "|" + period * (n // len(period)) + "|" + ends[1])])).drop("kept"))
    kept = (ends[0] + "||" + ends[1]).encode()
    assert row == (1, n + len(kept), n, 1, hashlib.sha256(kept).hexdigest())


def test_empty_table(frame):
    assert substrings.remove_repeats(frame([])).count() == 0
    assert phrases.remove_repeats(frame([])).count() == 0


def test_interval_expansion_alone():
    rng = np.random.default_rng(3)
    for _ in range(60):
        length = int(rng.integers(8, 40))
        pieces = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 150)).astype(np.uint8).tobytes() for _ in range(rng.integers(1, 8))]
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        places, at, want = {}, 0, np.zeros(len(text), bool)
        for piece in pieces:
            for k in range(len(piece) - length + 1):
                places.setdefault(piece[k : k + length], []).append(at + k)
            at += len(piece) + 1
        for found in places.values():
            want[found] = len(found) > 1
        assert (substrings.repeated_starts(text, np.cumsum([len(p) + 1 for p in pieces]) - 1, length) == want).all()

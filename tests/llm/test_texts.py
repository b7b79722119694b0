"""Decontamination, tokenizing, personal data and fingerprints against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from postwatch.llm import bpe, decontaminate, minhash, pii, tagger
from tests.llm.conftest import prose


def folded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(pairs, items):
    found = {}
    for item, text in items:
        words = folded(text)
        for at in range(max(1, len(words) - 9) if words else 0):
            found.setdefault(tuple(words[at : at + 10]), set()).add(item)
    out = []
    for doc_id, text in pairs:
        words, hit, names = folded(text), set(), set()
        for at in range(len(words)):
            for n in range(1, 11):
                key = tuple(words[at : at + n])
                if len(key) == n and key in found:
                    hit.update(range(at, at + n))
                    names |= found[key]
        listed = sorted(str(x) for x in names if x is not None)
        out.append((doc_id, len(words), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture()
def items():
    rng = random.Random(4)
    passages = [(k, prose(rng, 10 + 3 * k)) for k in range(6)]
    return passages + [(6, "only Four words here"), (7, "solo"), (7, passages[2][1]), (None, passages[3][1]), (8, None), (9, " .,; "), (10, "")]


def test_decontaminate(spark, frame, rows, odd, items):
    rng = random.Random(5)
    pairs = odd + [(100 + k, f"{prose(rng, 5)} {t} {prose(rng, 4)}") for k, (_, t) in enumerate(items)]
    pairs += [(200, "Xsolo solos solo-SOLO"), (201, "only,four\nWORDS! here"), (202, items[4][1][:-3]), (203, items[5][1].upper() + " " + items[0][1])]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = plain_hits(pairs, items)
    assert any(w[5] for w in want) and not all(w[5] for w in want)
    assert rows(decontaminate.hits(frame(pairs), benchmark).drop("items")) == want
    # a benchmark that takes several passes
    assert rows(decontaminate.hits(frame(pairs), benchmark, block_bytes=200).drop("items")) == want
    clean = decontaminate.clean(frame(pairs), benchmark)
    assert clean.columns == frame(pairs).columns and clean.count() == sum(not w[5] for w in want)


def test_decontaminate_empty(spark, frame, odd):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(frame(odd), nothing).where("contaminated").count() == 0
    assert decontaminate.hits(frame([]), nothing).count() == 0


def test_bpe_equals_library(frame, odd):
    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(6)
    made = ["", "  ", "aaaaaaa aaaa aaa", "ΑΣ ΣΑΣ İstanbul ǅ", "<|endoftext|>a<|startoftext|> <|endoftext|", "it's THEY'LL 'd x'S 123 ½ ٣"]
    made += ["\x1c\x1d a\x85b c​d", "é 가 日本語 😀👍🏽", "''' re're", "Ᲊa Ɤb ՘c"]
    kinds = [(32, 127), (0, 0x250), (0, 0x3000), (0x1F300, 0x1F700)]
    made += ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(30))) for _ in range(300)]
    pairs = odd + [(1000 + k, t) for k, t in enumerate(made)]
    want = {}
    for doc_id, text in pairs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        body = np.array(ids, "<u4").tobytes()
        want.setdefault(doc_id, []).append((len(ids), hashlib.sha256(body).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = {}
    for row in bpe.digests(frame(pairs)).collect():
        got.setdefault(row.doc_id, []).append(tuple(row)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.digests(frame([])).count() == 0


def test_bpe_long_words_equal_library():
    """Words on both sides of the length from which places are linked, many to a call, of few and of many different pairs."""
    library, own, rng = Tokenizer.from_file(bpe.default_path()), bpe.Tokenizer(bpe.default_path()), random.Random(8)
    texts = ["a" * 9001, "ab" * 700, "日本語中文字符测试漢" * 90, "=-" * 300 + "x" * 257, "thethere" * 64]
    for letters in ("ab", "aab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "éaß日"):
        texts += [" ".join("".join(rng.choice(letters) for _ in range(rng.choice([2, 9, 255, 256, 257, 400, 1500]))) for _ in range(4)) for _ in range(12)]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_round_trip(frame):
    library = Tokenizer.from_file(bpe.default_path())
    pairs = [(1, "Some words, some more."), (2, None)]
    rows = {r.doc_id: r for r in bpe.round_trip(frame(pairs)).collect()}
    ids = library.encode(pairs[0][1], add_special_tokens=False).ids
    assert rows[1].ids == ids and rows[1].decoded == library.decode(ids, skip_special_tokens=False) and rows[2].ids == []
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(pairs))).collect()} == {k: r.decoded for k, r in rows.items()}


def plain_spans(text):
    found = []
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda t: re.sub("[^0-9]", "", t)
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(digits(t)) <= 15),
    ]
    for k, (kind, pattern, holds) in enumerate(tests):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if holds(m[0])]
    return [(start, kind, end) for start, _, kind, end in sorted(found)]


def test_base_spans():
    rng = random.Random(4)
    parts = ["@", ".", "a", "b-", "1", "2", "55", "+", " ", "-", "(", ")", "4111111111111111", "x@y.z", ".1.2.3", "\n", "é", "%_", "999.1.1.1"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_tagger_gradient():
    rng = np.random.default_rng(0)
    p = tagger.initial()
    for name in ("inputs", "hidden", "out", "bias", "moves", "first"):
        setattr(p, name, getattr(p, name).astype(float) + (rng.normal(0, 0.3, getattr(p, name).shape) if name in ("bias", "moves", "first") else 0))
    x = rng.integers(0, tagger.SYMBOLS, (3, 7))
    y = np.zeros((3, 7), int)
    y[0, 2], y[0, 3:5], y[1, 0], y[1, 1] = 1, 2, 3, 4
    _, gradient = tagger.loss_and_gradient(p, x, y)
    for values, slopes in zip(p.arrays(), gradient):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in values.shape)
            if values is p.inputs:
                at = (at[0], x.ravel()[rng.integers(0, 21)], at[2])
            was = values[at]
            values[at] = was + 1e-3
            up = tagger.loss_and_gradient(p, x, y)[0]
            values[at] = was - 1e-3
            down = tagger.loss_and_gradient(p, x, y)[0]
            values[at] = was
            assert abs((up - down) / 2e-3 - slopes[at]) < 2e-3


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(1)
    p = tagger.initial(3)
    p.moves += rng.normal(0, 0.5, p.moves.shape).astype(np.float32)
    x = rng.integers(0, tagger.SYMBOLS, (4, 4))
    scores = tagger.emissions(p, x)[0]
    for n, labels in enumerate(tagger.decode(p, x)):
        paths = np.array(np.meshgrid(*[range(tagger.LABELS)] * 4, indexing="ij")).reshape(4, -1).T
        paths = paths[[all(tagger.allowed()[a, b] for a, b in zip(path, path[1:])) for path in paths]]
        value = p.first[paths[:, 0]] + sum(scores[t, n, paths[:, t]] for t in range(4)) + sum(p.moves[paths[:, t], paths[:, t + 1]] for t in range(3))
        assert abs(value.max() - value[(paths == labels).all(1)][0]) < 1e-4


@pytest.fixture(scope="module")
def fitted():
    rng = random.Random(1)
    rows = [("plain", 0, 0, prose(rng, 25, "abcdefghilmnorstu")[:96]) for _ in range(300)]
    x, y = pii.labelled_windows(rows, 2000)
    return tagger.train(x, y, 160, 48), rows


def test_chains_are_decoded_as_one_sequence():
    """Cells joined by their transfers give the labels of one pass over the whole chain, with label 0 beside it inside a text."""
    p, rng = tagger.initial(4), np.random.default_rng(5)
    for array in p.arrays():
        array += rng.normal(0, 1, array.shape).astype(np.float32)
    moves = tagger._moves(p).astype(np.float64)
    for trial in range(30):
        sizes = rng.integers(1, 6, 4)
        steps, n = int(rng.integers(1, 7)), int(sizes.sum())
        scores = rng.normal(0, 2, (steps, n, tagger.LABELS)).astype(np.float32)
        fresh = np.zeros(n, bool)
        fresh[np.cumsum(sizes) - sizes] = True
        opens, closes = rng.random(n) < 0.5, rng.random(n) < 0.5
        first, last = tagger.joined(p, tagger.transfers(p, scores), fresh, opens, closes)
        found = tagger.traced(p, scores, first, last)
        for at, size in zip(np.cumsum(sizes) - sizes, sizes):
            line = scores[:, at : at + size].transpose(1, 0, 2).reshape(-1, tagger.LABELS).astype(np.float64)
            best, came = (p.first if opens[at] else moves[0]) + line[0], []
            for now in line[1:]:
                came.append((best[:, None] + moves).argmax(0))
                best = (best[:, None] + moves).max(0) + now
            path = [int((best if closes[at + size - 1] else best + moves[:, 0]).argmax())]
            for back in came[::-1]:
                path.append(int(back[path[-1]]))
            assert found[at : at + size].ravel().tolist() == path[::-1]


def test_tagged_spans_end_with_words():
    text = "write to jane.doe [at] mail [dot] org or (286) 555-5136, not 5555555555555555 " + "7" * 5000
    email, phone = text.index("jane"), text.index("(286")
    want = (email, email + len("jane.doe [at] mail [dot] org"))
    assert pii._bounds("email", text, email + 3, want[1] - 1) == pii._bounds("email", text, email - 3, want[1]) == want
    assert pii._bounds("phone", text, phone + 1, phone + 12) == (phone, phone + 14)
    assert pii._bounds("card", text, text.index("5555555"), text.index("5555555") + 9) is None
    assert pii._bounds("card", text, len(text) - 2500, len(text) - 2480) is None


def test_long_texts_are_scored_in_runs(fitted, monkeypatch):
    """A text of many windows has the same spans whether its scores are kept or made twice, in large runs or small ones."""
    p, _ = fitted
    rng = random.Random(12)
    texts = ["".join(rng.choice([" (286) 555-5136 ", " abc [at] host [dot] org ", "7 8 9", "plain words here ", "9" * 90]) for _ in range(300)), "", "no digits"]
    base = [pii.base_spans(t) for t in texts]
    whole = pii.added_spans(p, texts, base)
    assert whole[0] and not whole[1] and not whole[2]
    monkeypatch.setattr(pii, "RUN_WINDOWS", 7)
    assert pii.added_spans(p, texts, base) == whole


def test_tagger_learns(fitted):
    p, rows = fitted
    x, y = pii.labelled_windows(rows, 300, seed=77)  # other values in other places
    found = tagger.decode(p, x)
    assert (found == y).mean() > 0.95 and ((found > 0) & (y > 0)).sum() / (y > 0).sum() > 0.85


def test_personal_data(frame, fitted, odd):
    p, _ = fitted
    rng = random.Random(3)
    fill = lambda: prose(rng, 60, "abcdefghilmnorstu")
    pairs = odd + [(100, f"{fill()} mail bob@mail.org {fill()} or 10.0.0.1 {fill()}"), (101, f"call +1 (286) 555-5136 or 4111111111111111 {fill()}")]
    pairs += [(200 + k, f"{fill()} {v} {fill()}") for k, v in enumerate(["(286) 555-5136", "286-555-5136", "tom [at] host [dot] org", "4111.1111.1111.1111"] * 6)]
    got = {}
    for row in pii.find(frame(pairs), p).collect():
        got.setdefault(row.doc_id, []).append(row)
    texts = {k: t or "" for k, t in pairs}
    assert sum(map(len, got.values())) == len(pairs)
    for doc_id in (100, 101, 44, 30):
        base = plain_spans(texts[doc_id])
        row = got[doc_id][0]
        spelled = ",".join(f"{kind}:{a}:{b}" for a, kind, b in base)
        assert row.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(filter(None, spelled.split(","))) <= set(row.spans.split(","))
    assert sum(got[200 + k][0].n_added > 0 for k in range(24)) >= 12  # spellings that the patterns do not have
    assert all(r.n_added == 0 for k in range(25) for r in got[k])
    masked = {r.doc_id: r for r in pii.mask(frame([pairs[-26], pairs[0], (3, None)]), p).collect()}
    assert "<email>" in masked[100].text and "bob@" not in masked[100].text and "<ip>" in masked[100].text
    assert masked[100].n_chars == len(masked[100].text) and masked[0].text == pairs[0][1] and masked[3].text is None
    assert pii.find(frame([]), p).count() == 0


def test_fit_on_documents(frame, odd):
    p = pii.fit(frame(odd), steps=2)
    assert pii.find(frame(odd), p).count() == len(odd) and pii.fit(frame([]), steps=1)


def test_fingerprints(frame, odd):
    order = lambda r: (-(1 << 63) if r[0] is None else r[0])
    unique = [r for r in odd if r[0] not in (47, 48, None)] + [(47, "equal"), (51, "equal"), (None, "none at all")]
    ranked = sorted(unique, key=order)
    texts = [t or "" for _, t in ranked]
    changed = [minhash.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    import pyarrow as pa

    from postwatch.llm import common

    own, other = (minhash.signatures(common.utf8(pa.array(t))) for t in (texts, changed))
    want = {}
    for k, (doc_id, _) in enumerate(ranked):
        near = [float((own[k] == other[k]).mean()), float((own[k] == own[(k + 1) % len(own)]).mean())]
        digest = hashlib.sha256(changed[k].encode()).hexdigest()
        want[doc_id] = (len(texts[k]), digest, minhash.hexed(own[k : k + 1])[0], minhash.hexed(other[k : k + 1])[0], *near)
    for stretches in (1, 7):
        got = {r.doc_id: tuple(r)[1:] for r in minhash.with_edits(frame(unique), stretches).collect()}
        assert got == want
    assert minhash.with_edits(frame(odd)).count() == len(odd)  # repeated rows, one id for two texts
    assert minhash.with_edits(frame([])).count() == 0
    assert [tuple(r)[-1] for r in minhash.with_edits(frame([(1, "alone here")])).collect()] == [1.0]


def test_likeness_estimates_jaccard():
    import pyarrow as pa

    from postwatch.llm import common

    rng = random.Random(8)
    for share in (0.2, 0.5, 0.9):
        words = prose(rng, 400).split()
        cut = int(400 * share)
        other = words[:cut] + prose(rng, 400 - cut).split()
        sets = [{tuple(w[k : k + 5]) for k in range(396)} for w in (words, other)]
        a, b = minhash.signatures(common.utf8(pa.array([" ".join(words), " ".join(other)])))
        assert abs((a == b).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.17

"""BPE encoding and decoding with the rules and the vocabulary of a tokenizer file (``word_bpe_49k.json`` by default).

A text is cut at the special tokens, brought to NFC and lower case, and split into words. Words are encoded many at once:
their symbols lie in one flat array, a round looks every neighbouring pair up in the sorted pair keys by binary search,
takes each word's pair of lowest rank, and merges it wherever the word has it; words without a pair leave. A task keeps
words it has encoded, up to ``CACHE_WORDS``, so a common word costs its rounds once.

Words of more than ``LONG`` bytes (text without spaces) would take very many rounds over the whole array. Theirs lie in an array
of their own whose places are linked; a round takes the places of one rank from an index, and looks up only the pairs it changed.

Decoding joins the vocabulary's entries of the ids, as the file names no decoder, by one space.

Defined cases: a null or empty text has no ids and decodes to the empty text; texts are taken whole; rows are independent.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from postwatch.llm import common

CACHE_WORDS = 150_000
LONG = 256
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
# Fixed values of the tokenizer's rules: contractions, letters, single digits, other marks.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^\p{{White_Space}}{L}{N}]+"
WORD = regex.compile(RULE.format(L=r"\p{L}", N=r"\p{N}"))
_MAY_BE_NEW = regex.compile("[\u0558-\U0010ffff]")


def _ranges(chars: Iterable[str]) -> str:
    """The characters, in ascending order, as ranges of a set of a pattern."""
    codes = np.array([ord(c) for c in chars] or [0])
    first = np.append(True, np.diff(codes) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[first].tolist(), codes[np.append(first[1:], True)].tolist()))


@lru_cache(maxsize=1)
def _newer() -> tuple[regex.Pattern, regex.Pattern, normalizers.Normalizer]:
    """For texts with characters that ``unicodedata`` lacks: what finds them, the word rule, and the normalizer.

    Python, ``regex`` and the tokenizers library follow different editions of Unicode; the library's counts.
    """
    unassigned = (chr(c) for c in range(0x558, 0x110000) if unicodedata.category(chr(c)) == "Cn")
    lacking = regex.findall(r"[\p{L}\p{N}\p{M}]", "".join(unassigned))
    known = {c for kind in (r"\p{L}", r"\p{N}") for c, _ in pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(" ".join(lacking))}
    unknown = _ranges(c for c in lacking if c not in known)
    rule = RULE.format(L=rf"[\p{{L}}--[{unknown}]]", N=rf"[\p{{N}}--[{unknown}]]")
    return regex.compile(f"[{_ranges(lacking)}]"), regex.compile(rule, regex.V1), normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: its own where it is visible, else the next one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(visible) else chr(next(others)) for b in range(256)]


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in {**vocab, **self.special}.items():
            self.tokens[k] = token
        inner = [vocab[c] for c in byte_symbols()]
        last = [vocab[c + suffix] for c in byte_symbols()]
        self.symbols = np.array([inner, last], np.uint64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.uint64)
        self.never = len(pairs)
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token is kept, marked by a space, which no word has."""
        if self._cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[str] = []
        for part in self._cut.split(text):
            out.extend([" " + part] if part in self.special else self._plain(part))
        return out

    @staticmethod
    def _plain(text: str) -> list[str]:
        # letter by letter: a capital sigma becomes the same small one at the end of a word
        if _MAY_BE_NEW.search(text):
            finds, rule, normalizer = _newer()
            if finds.search(text):
                return rule.findall(normalizer.normalize_str(text))
        return WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and the offsets of the words (one more than words)."""
        raw, offsets = common.flat(common.utf8(pa.array(words, pa.string())))
        closes = np.zeros(len(raw), np.int64)
        closes[offsets[1:] - 1] = 1
        symbols = self.symbols[closes, raw]
        word = np.repeat(np.arange(len(words)), np.diff(offsets))
        done_symbols, done_words = [], []
        is_long = (np.diff(offsets) > LONG)[word]
        if is_long.any():
            alive, merged = self._linked(symbols[is_long], word[is_long])
            done_symbols.append(merged[alive])
            done_words.append(word[is_long][alive])
            symbols, word = symbols[~is_long], word[~is_long]
        while len(symbols):
            key = symbols[:-1] << np.uint64(32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), self.never, np.int64)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], self.never)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(begins, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, begins), sizes)
            open_ = least < self.never
            done_symbols.append(symbols[~open_])
            done_words.append(word[~open_])
            symbols, word, rank, least = symbols[open_], word[open_], rank[open_], least[open_]
            if not len(symbols):
                break
            hit = rank == least
            # neighbouring hits share a symbol: every second one of a row of hits counts, from its first
            places = np.flatnonzero(hit)
            row = np.append(True, (places[1:] != places[:-1] + 1) | (word[places[1:]] != word[places[:-1]]))
            nth = np.arange(len(places)) - np.maximum.accumulate(np.where(row, np.arange(len(places)), 0))
            places = places[nth % 2 == 0]
            symbols[places] = self.merged[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return np.zeros(0, np.uint32), np.zeros(len(words) + 1, np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.uint32), np.append(0, np.cumsum(np.bincount(word, minlength=len(words))))

    def _linked(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places are left of the given words, and the symbols after all merges; ranks in ascending order over all words."""
        n = len(symbols)
        symbols = np.append(symbols, np.uint64(0))
        inside = word[1:] == word[:-1]
        after = np.append(np.where(np.append(inside, False), np.arange(1, n + 1), n), n)  # place n: no neighbour
        before = np.append(np.where(np.append(False, inside), np.arange(-1, n - 1), n), n)

        def ranked(places: np.ndarray) -> np.ndarray:
            key = symbols[places] << np.uint64(32) | symbols[after[places]]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where((self.keys[at] == key) & (after[places] < n), self.ranks[at], self.never)

        heap: list[int] = []
        index: dict[int, list[np.ndarray]] = {}

        def listed(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            order = order[: np.count_nonzero(ranks < self.never)]
            places, ranks = places[order], ranks[order]
            begins = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(ranks) else ranks
            ends = np.append(begins[1:], len(ranks)).tolist()
            for r, a, b in zip(ranks[begins].tolist(), begins.tolist(), ends):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        rank = np.append(ranked(np.arange(n)), self.never)
        listed(np.arange(n), rank[:n])
        alive = np.ones(n, bool)
        while heap:
            least = heapq.heappop(heap)
            found = index.pop(least)
            places = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            places = places[rank[places] == least]
            if not len(places):
                continue
            if len(places) > 1:  # of neighbouring hits every second one counts
                nth = np.arange(len(places))
                nth -= np.maximum.accumulate(np.where(np.append(True, after[places[:-1]] != places[1:]), nth, 0))
                places = places[nth % 2 == 0]
            gone = after[places]
            alive[gone] = False
            rank[gone] = self.never
            symbols[places] = self.merged[least]
            beyond = after[gone]
            after[places] = beyond
            before[beyond] = places
            left = before[places]
            changed = np.unique(np.concatenate([places, left[left < n]]))
            rank[changed] = fresh = ranked(changed)
            listed(changed, fresh)
        return alive, symbols[:n]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > CACHE_WORDS:
            self._reset()
        split = [self.words(t) for t in texts]
        fresh = [w for w in dict.fromkeys(w for words in split for w in words) if w not in self.known]
        if fresh:
            special = [w for w in fresh if w[0] == " "]
            plain = [w for w in fresh if w[0] != " "]
            ids, offsets = self.merge(plain)
            for w in plain + special:
                self.known[w] = len(self.known)
            self.pool = np.concatenate([self.pool, ids, np.array([self.special[w[1:]] for w in special], np.uint32)])
            base = self.starts[-1]
            self.starts = np.concatenate([self.starts, base + offsets[1:], base + len(ids) + np.arange(1, len(special) + 1)])
        out = []
        for words in split:
            k = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            first, n = self.starts[k], self.starts[k + 1] - self.starts[k]
            out.append(self.pool[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _digests(path: str):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch, texts in common.chunks(batches):
            encoded = own.encode(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in encoded], pa.int64()),
                    pa.array([common.sha(x.astype("<u4").tobytes()) for x in encoded]),
                    pa.array([common.sha(own.decode(x).encode()) for x in encoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return digests


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, then decoded from the ids."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_digests(path or default_path()), DIGEST)


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids of each row."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch, texts in common.chunks(batches):
            encoded = own.encode(texts.to_pylist())
            n = np.array([len(x) for x in encoded], np.int64)
            ids = common.lists(pa.array(np.concatenate(encoded).astype(np.int32)), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), ids], ["doc_id", "n_tokens", "ids"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of doc_id and ids; null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (the text that the ids decode to) of each row."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch, texts in common.chunks(batches):
            encoded = own.encode(texts.to_pylist())
            n = np.array([len(x) for x in encoded], np.int64)
            ids = common.lists(pa.array(np.concatenate(encoded).astype(np.int32)), n)
            decoded = pa.array([own.decode(x) for x in encoded], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), ids, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")

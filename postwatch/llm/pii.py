"""Personal data: four kinds by fixed patterns, and more of them by a character tagger (:mod:`postwatch.llm.tagger`).

Base spans are those of the patterns; they always stay. The tagger is a bidirectional LSTM with a CRF, trained in numpy when
the operator is called, from labelled spans: the base spans of a sample of the documents, and the same kinds of data spelled
in ways the patterns do not cover (``name [at] host [dot] org``, ``(286) 555-5136``, card groups with dots), put into
windows of the documents' own text. It reads texts in windows of ``WINDOW`` characters that overlap by half. A character's label
scores are the mean of those of the windows that hold it, by its distance to their ends, and the labels are decided for the
text as one sequence: the best path of the CRF through all cells (the ``STRIDE`` characters in the middle of a window). A tagged
span grows to whole words and numbers and is added if it touches no base span and holds a value of its kind (digits and check
sum, or a name and a host).

Every value of the four kinds has a digit, an @, or an "at" in brackets; a window without any of these has label 0
throughout and is not run: its neighbours are decided with a label 0 beside them.

Learned from: documents of an id hash that gives about ``SAMPLE_ROWS`` rows, of these at most ``2 * FIT_WINDOWS`` cuts around base
spans, around every fourth other trigger and of plain text, by hash. Training has ``FIT_WINDOWS`` windows: up to a third around
base spans, up to a sixth around other triggers, the rest plain text with values put in.

Defined cases: a null text is empty and has no spans; positions are code points; texts are read whole; rows are independent.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postwatch.llm import common, tagger

KINDS = tagger.KINDS
WINDOW, STRIDE = 160, 80
FIT_LENGTH = 96
SAMPLE_ROWS = 20_000
FIT_WINDOWS = 4000
FIT_STEPS, FIT_BATCH = 220, 64
RUN_WINDOWS = 2048
LONGEST = 320  # no value has more characters: the bound of an address, and far above that of a number
HELD_RUNS = 4  # beyond, label scores are made a second time instead of kept
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

Span = tuple[int, str, int]  # start, kind, end

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({<] ?at ?[\])}>]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) << (place & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_ip(text: str) -> bool:
    return all(len(part := p.lstrip("0")) <= 3 and int(part or "0") <= 255 for p in text.split("."))


def is_card(text: str, least: int = 14) -> bool:
    digits = digits_of(text)
    return least <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by start, then kind."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        if host:
            end = host.end()
            found.append((begin, "email", end))
        at = text.find("@", max(at + 1, end))
    for m in _NUMBERS.finditer(text):
        if "." in m[0] and is_ip(m[0]):
            found.append((m.start(), "ip", m.end()))
    found.extend((m.start(), "card", m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and is_card(m[0]))
    if "+" in text:
        found.extend((m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


# --- labelled windows --------------------------------------------------------------------------------------------------


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of text around base spans, around other triggers, and plain ones: kind, begin and end of the span, text."""
    for _, texts in common.chunks(batches):
        rows = []
        for text in texts.to_pylist():
            spans = base_spans(text)
            for start, kind, end in spans:
                low = max(0, start - (len(text) * 31 + start) % (FIT_LENGTH // 2))
                if end - low <= FIT_LENGTH:
                    rows.append((kind, start - low, end - low, text[low : low + FIT_LENGTH]))
            taken = [(s, e) for s, _, e in spans]
            for m in islice(_TRIGGER.finditer(text), 0, None, 4):
                low = max(0, m.start() - FIT_LENGTH // 2)
                if all(e <= low or s >= low + FIT_LENGTH for s, e in taken):
                    rows.append(("trigger", 0, 0, text[low : low + FIT_LENGTH]))
            if len(text) > FIT_LENGTH:
                low = (len(text) * 7919) % (len(text) - FIT_LENGTH)
                if not _TRIGGER.search(text[low : low + FIT_LENGTH]):
                    rows.append(("plain", 0, 0, text[low : low + FIT_LENGTH]))
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), *(pa.array(columns[k], pa.int32()) for k in (1, 2)), pa.array(columns[3], pa.string())],
            ["kind", "low", "high", "body"],
        )


def _word(rng: random.Random, low: int = 3, high: int = 9) -> str:
    return "".join(rng.choice("aeiouabcdefghijklmnoprstuvwy") for _ in range(rng.randint(low, high)))


def _value(kind: str, rng: random.Random) -> str:
    """A value of a kind, in one of many spellings."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        name = _word(rng) + rng.choice(["", ".", "_", "-", ""]) + rng.choice(["", _word(rng), digits(2)])
        host, last = _word(rng) + rng.choice(["", "-" + _word(rng)]), rng.choice(["com", "org", "net", "example", _word(rng, 2, 3)])
        at, dot = rng.choice([("@", ".")] * 3 + [(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "(dot)"), (" @ ", "."), (" (at) ", " (dot) ")])
        return name + at + host + dot + last
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = digits(rng.choice([13, 14, 15, 15, 15, 15, 18]))
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        sep = rng.choice(["", "", " ", "-", ".", "_", "  "])
        return sep.join(whole[k : k + 4] for k in range(0, len(whole), 4))
    area, middle, tail = digits(3), digits(3), digits(4)
    return rng.choice(
        [f"+1 ({area}) {middle}-{tail}", f"+{digits(2)} {area} {middle}{tail}", f"({area}) {middle}-{tail}", f"{area}-{middle}-{tail}", f"001-{area}-{middle}-{tail}", f"1-{area}-{middle}-{tail}", f"{area}.{middle}.{tail}"]
    )


def _other(rng: random.Random) -> str:
    """Something with digits that is no personal data."""
    n = lambda a, b: str(rng.randint(a, b))
    return rng.choice(
        [n(0, 99999), f"{n(1, 31)}.{n(1, 12)}.{n(1900, 2030)}", f"{n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}", f"{n(0, 23)}:{n(10, 59)}", f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}", f"${n(1, 9999)}.{n(10, 99)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 32, 40]))), "@" + _word(rng), f"{n(1, 999)} {n(1, 999)}", f"[{n(1, 99)}]", f"http://{_word(rng)}.{_word(rng, 2, 3)}/{n(1, 999)}"]
    )


def _labelled(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros(FIT_LENGTH, np.int64), np.zeros(FIT_LENGTH, np.int64)
    symbols = tagger.symbols(text)[:FIT_LENGTH]
    x[: len(symbols)] = symbols
    for kind, low, high in spans:
        k = KINDS.index(kind)
        y[low:high] = 2 + 2 * k
        if low < FIT_LENGTH:
            y[low] = 1 + 2 * k
    return x, y


def labelled_windows(rows: list[tuple[str, int, int, str]], n: int = FIT_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of windows: those of the rows, and made ones with values put into plain text."""
    rng, out = random.Random(seed), []
    plain = [r[3] for r in rows if r[0] == "plain"] or [" ".join(_word(rng) for _ in range(16)) for _ in range(200)]
    real = [r for r in rows if r[0] in KINDS]
    for kind, low, high, body in real[: n // 3]:
        spans = [(k, s, e) for s, k, e in base_spans(body) if (k, s, e) != (kind, low, high)]
        spans = [(k, s, e) for k, s, e in spans if e <= low or s >= high] + [(kind, low, high)]
        out.append(_labelled(body, spans))
    for kind, _, _, body in [r for r in rows if r[0] == "trigger"][: n // 6]:
        out.append(_labelled(body, []))
    while len(out) < n:
        body, spans = rng.choice(plain), []
        for _ in range(rng.randint(1, 2)):
            kind = rng.choice([*KINDS, *KINDS, "other"])
            value = _value(kind, rng) if kind in KINDS else _other(rng)
            breaks = [m.start() for m in re.finditer(" ", body) if all(m.start() < s - 1 or m.start() > e for _, s, e in spans)]
            at = rng.choice(breaks) + 1 if breaks else 0
            if spans and any(s < at <= e for _, s, e in spans):
                continue
            before, after = rng.choice([("", " "), ("", ". "), ("", ", "), ("(", ") "), ("", "### ")])
            body = body[:at] + before + value + after + body[at:]
            grown = len(before) + len(value) + len(after)
            spans = [(k, s + grown, e + grown) if s >= at else (k, s, e) for k, s, e in spans]
            if kind in KINDS:
                spans.append((kind, at + len(before), at + len(before) + len(value)))
        shift = rng.randint(0, max(0, len(body) - FIT_LENGTH))
        spans = [(k, s - shift, e - shift) for k, s, e in spans if s >= shift]
        out.append(_labelled(body[shift : shift + FIT_LENGTH], [(k, s, e) for k, s, e in spans if s < FIT_LENGTH]))
    return tuple(np.stack(c) for c in zip(*out))


def fit(documents: DataFrame, steps: int = FIT_STEPS) -> tagger.Parameters:
    docs = documents.select("doc_id", "text")
    share = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    cuts = sample.mapInArrow(_cuts, "kind string, low int, high int, body string").withColumn("h", F.xxhash64("kind", "low", "body"))
    rows = cuts.orderBy("h", "body", "low").limit(2 * FIT_WINDOWS).collect()
    x, y = labelled_windows([(r.kind, r.low, r.high, r.body) for r in rows])
    return tagger.train(x, y, steps, FIT_BATCH)


# --- decoding ----------------------------------------------------------------------------------------------------------


_AT, _DOT = r" ?(?:@|[\[({<] ?at ?[\])}>]) ?", r" ?(?:\.|[\[({<] ?dot ?[\])}>]) ?"
_VALUES = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9][0-9 ._-]+[0-9]"),
    "phone": re.compile(r"[+(]?[0-9][0-9 ().-]+[0-9]"),
}
#: A tagged span grows over these, so that it ends where a word or number does.
_GROWS = {"email": _LOCAL_CHARS, "ip": frozenset("0123456789."), "card": frozenset("0123456789"), "phone": frozenset("0123456789+(")}


def _is_value(kind: str, text: str) -> bool:
    if not _VALUES[kind].fullmatch(text):
        return False
    if kind == "phone":
        return 10 <= len(digits_of(text)) <= 15 and len(text) > len(digits_of(text))
    return kind == "email" or (is_ip(text) if kind == "ip" else is_card(text))


def _bounds(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The value that a tagged span stands for: grown to whole words or numbers, cut to what the kind's values look like."""
    grows, least, most = _GROWS[kind], start - LONGEST, end + LONGEST
    while start and start >= least and text[start - 1] in grows:
        start -= 1
    while end < len(text) and end <= most and text[end] in grows and text[end] not in "+(":
        end += 1
    if start < least or end > most or end - start > 3 * LONGEST:
        return None
    found = _VALUES[kind].search(text, start, end)
    if not found:
        return None
    end = found.end() - (found[0][-1] == "-" and kind == "email")
    return (found.start(), end) if _is_value(kind, text[found.start() : end]) else None


def _tagged(text: str, labels: np.ndarray) -> Iterator[Span]:
    """Spans of a label sequence, without white space and sentence marks at their ends."""
    kind = np.where(labels > 0, (labels + 1) // 2, 0)
    new = np.append(True, (kind[1:] != kind[:-1]) | (labels[1:] % 2 == 1))
    for start, end in zip(first := np.flatnonzero(new), np.append(first[1:], len(kind))):
        if kind[start]:
            body = text[start:end]
            low = start + len(body) - len(body.lstrip(" \t\r\n,;:"))
            high = end - (len(body) - len(body.rstrip(" \t\r\n,;:.")))
            if low < high:
                yield int(low), KINDS[kind[start] - 1], int(high)


def _settled(p: tagger.Parameters, cells: list[tuple[int, int]], spelled_out: dict[int, np.ndarray]):
    """First and last label of each cell on the best path of its text, and the function that gives label scores of cells."""
    reach = (WINDOW - STRIDE) // 2
    own = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW))[reach : reach + STRIDE].astype(np.float32) / (STRIDE + 1)
    own = own[:, None, None]  # how much a cell's own window counts where a neighbour's holds the place as well
    text, window = np.array(cells).T
    left = np.array([len(spelled_out[k]) - w * STRIDE for k, w in cells])
    fresh = np.append(True, (text[1:] != text[:-1]) | (window[1:] != window[:-1] + 1))

    def made(at: int, upto: int) -> np.ndarray:
        low, high = max(0, at - 1), min(len(cells), upto + 1)
        x = np.zeros((high - low, WINDOW), np.int64)
        for row, (k, w) in enumerate(cells[low:high]):
            begin = w * STRIDE - reach
            piece = spelled_out[k][max(0, begin) : begin + WINDOW]
            x[row, max(0, -begin) : max(0, -begin) + len(piece)] = piece
        whole = tagger.emissions(p, x)[0]
        out = whole[reach : reach + STRIDE].copy()
        here = np.flatnonzero(~fresh[low + 1 : high])
        out[-reach:, here] = out[-reach:, here] * own[-reach:] + whole[:reach, here + 1] * (1 - own[-reach:])
        out[:reach, here + 1] = out[:reach, here + 1] * own[:reach] + whole[-reach:, here] * (1 - own[:reach])
        beyond = np.arange(STRIDE)[:, None] >= left[low:high]
        out[beyond] = np.where(np.arange(tagger.LABELS) == 0, np.float32(0), np.float32(-1e4))
        return out[:, at - low : upto - low]

    runs = [(at, min(at + RUN_WINDOWS, len(cells))) for at in range(0, len(cells), RUN_WINDOWS)]
    held = {run: made(*run) for run in runs} if len(runs) <= HELD_RUNS else {}

    def scores(at: int, upto: int) -> np.ndarray:
        return held[at, upto] if held else made(at, upto)

    moved = np.concatenate([tagger.transfers(p, scores(*run)) for run in runs])
    return *tagger.joined(p, moved, fresh, window == 0, left <= STRIDE), scores


def added_spans(p: tagger.Parameters, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """For each text the spans that the tagger adds to the base spans."""
    cells = []  # text, window: those with a trigger
    for k, text in enumerate(texts):
        reach = (WINDOW - STRIDE) // 2
        own: set[int] = set()
        for m in _TRIGGER.finditer(text):
            # windows that hold the place: window w covers [w * STRIDE - reach, w * STRIDE + STRIDE + reach)
            own.update(range(max(0, (m.start() - STRIDE - reach) // STRIDE + 1), (m.start() + reach) // STRIDE + 1))
        cells.extend((k, w) for w in sorted(own) if w * STRIDE < len(text))
    spelled_out = {k: tagger.symbols(texts[k]) for k in {k for k, _ in cells}}
    labels = {k: np.zeros(len(s), np.int64) for k, s in spelled_out.items()}
    if cells:
        first, last, scores = _settled(p, cells, spelled_out)
        for at in range(0, len(cells), RUN_WINDOWS):
            upto = min(at + RUN_WINDOWS, len(cells))
            for (k, w), found in zip(cells[at:upto], tagger.traced(p, scores(at, upto), first[at:upto], last[at:upto])):
                own = labels[k][w * STRIDE : (w + 1) * STRIDE]
                own[:] = found[: len(own)]
    out: list[list[Span]] = [[] for _ in texts]
    for k, sequence in labels.items():
        if sequence.any():
            text, taken = texts[k], base[k]
            for start, kind, end in _tagged(text, sequence):
                held = _bounds(kind, text, start, end)
                if held and all(e <= held[0] or s >= held[1] for s, _, e in taken):
                    out[k].append((held[0], kind, held[1]))
            out[k] = sorted(set(out[k]))
    return out


def _find(p: tagger.Parameters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in common.chunks(batches):
            texts = values.to_pylist()
            base = [base_spans(t) for t in texts]
            added = added_spans(p, texts, base)
            every = [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[1]))) for b, a in zip(base, added)]
            counts = [[sum(kind == s[1] for s in b) for b in base] for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([common.sha(spelled(b).encode()) for b in base]),
                    pa.array([spelled(e) for e in every], pa.string()),
                    pa.array([len(a) for a in added], pa.int64()),
                ],
                [c.split()[0] for c in RESULT.split(", ")],
            )

    return run


def find(documents: DataFrame, p: tagger.Parameters) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, all spans, and how many of them the tagger added."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(p), RESULT)


def masked(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; spans that overlap are one, named after the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(documents: DataFrame, p: tagger.Parameters) -> DataFrame:
    """The documents with all their columns, personal data masked in text and n_chars counted anew where it is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in common.chunks(batches):
            texts = values.to_pylist()
            base = [base_spans(t) for t in texts]
            every = [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[1]))) for b, a in zip(base, added_spans(p, texts, base))]
            place = batch.schema.get_field_index("text")
            own = [masked(t, e) if e else None for t, e in zip(texts, every)]
            changed = pa.array([was if new is None else new for was, new in zip(batch.column(place).to_pylist(), own)], batch.schema.field(place).type)
            yield batch.set_column(place, "text", changed)

    out = documents.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length(common.text_of()).cast(dict(out.dtypes)["n_chars"])) if "n_chars" in out.columns else out

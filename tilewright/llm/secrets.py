"""Secret scans: fixed patterns, and the Shannon entropy of sliding windows over candidate strings.

The entropy of a window is kept by incremental counts: moving one place changes two counts, so a string costs
time linear in its length. Each character class has its own alphabet and threshold. Parts between separators that read as words or numbers are set
aside first, so paths and addresses aren't taken for keys; an allow-list suppresses identifiers that look random but are public.
Defined results: null and empty texts have no spans; rows with null or repeated ids are scanned like any other; of spans with one start the kinds
stand in the order listed; very long texts are read whole, in time linear in their length; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_rows, spans_text

#: The patterns of the base kinds.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ORDER = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
KEYWORDS = ("password", "passwd", "secret", "token", "api")

WINDOW = 20
#: Class, its pattern, and the bits per character that a window of it must reach.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 3.0),
    ("base32", re.compile(r"[A-Z2-7]+"), 3.6),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Parts of a candidate stand between these; a part with fewer characters than NEUTRAL says nothing by itself.
SEPARATOR, NEUTRAL = re.compile(r"[+/_=-]+"), 4
#: Words of a part, and how many letters they must have on average to be words.
PIECE, PIECE_SIZE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), 3
#: Public strings that look random: runs without letters, these parts as they are, and the letters and digits around these words.
ALLOW = re.compile(r"[0-9_/=+-]+")
ALLOW_PART = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
ALLOW_WORD = re.compile(r"(?i)example|sample|placeholder|changeme|xxxx|0123456789|abcdefgh")
AROUND = re.compile(r"[A-Za-z0-9]+")
_BITS = [0.0] + [c / WINDOW * math.log2(c / WINDOW) for c in range(1, WINDOW + 1)]


def window_entropies(text: str, size: int = WINDOW) -> list[float]:
    """Shannon entropy in bits of each window of `size` characters, by removing one character and adding one."""
    bits = _BITS if size == WINDOW else [0.0] + [c / size * math.log2(c / size) for c in range(1, size + 1)]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, ch in enumerate(text):
        if i >= size:
            old = text[i - size]
            c = counts[old]
            total += bits[c - 1] - bits[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        total += bits[c + 1] - bits[c]
        counts[ch] = c + 1
        if i >= size - 1:
            out.append(-total)
    return out


def readable(part: str) -> bool:
    """Whether letters and digits read as words in any case, with a number at most in sixteen characters, or as a number; random ones change case and kind too often.

    Capitals with digits among them don't: random strings of such a narrow class have long runs of letters too.
    """
    pieces = PIECE.findall(part)
    numbers = sum(p[0].isdigit() for p in pieces)
    if numbers == len(pieces):
        return True
    if numbers and part.isupper():
        return False
    letters = sum(len(p) for p in pieces if not p[0].isdigit())
    return letters >= PIECE_SIZE * (len(pieces) - numbers) and numbers <= 1 + len(part) // 16


def doubtful(candidate: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """The stretches of a candidate between its readable parts that hold an unreadable one, if they are as long as a window.

    The parts of paths, addresses and identifiers are readable, so they are never joined to a string that looks random by its length alone.
    """
    out, begin, end, found, at = [], None, 0, False, 0
    for m in [*SEPARATOR.finditer(candidate), None]:
        stop = m.start() if m else len(candidate)
        if stop > at:
            part = candidate[at:stop]
            if len(part) >= NEUTRAL and readable(part):
                if found and end - begin >= window:
                    out.append((begin, end))
                begin, found = None, False
            else:
                begin = at if begin is None else begin
                end, found = stop, found or len(part) >= NEUTRAL
        if m:
            at = m.end()
    if found and begin is not None:
        end = len(candidate) if SEPARATOR.fullmatch(candidate, end) else end  # filling at the end belongs to the key
        if end - begin >= window:
            out.append((begin, end))
    return out


def public_windows(candidate: str, window: int = WINDOW) -> bytearray:
    """For each place, 1 if the window that begins there lies within an allowed part or touches letters and digits around an allowed word."""
    out = bytearray(len(candidate))
    for m in ALLOW_PART.finditer(candidate):
        n = m.end() - window + 1 - m.start()
        out[m.start() : m.start() + n] = b"\1" * n
    if ALLOW_WORD.search(candidate):
        for m in AROUND.finditer(candidate):  # each run is searched once
            if ALLOW_WORD.search(candidate, m.start(), m.end()):
                first = max(0, m.start() - window + 1)
                out[first : m.end()] = b"\1" * (m.end() - first)
    return out


def entropy_spans(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs of windows of a candidate's doubtful stretches that reach a class's threshold.

    A stretch is judged by the narrowest class it belongs to, and each run of a narrower class inside it by that class. Public windows don't count.
    """
    spans = []
    for m in CANDIDATE.finditer(text):
        candidate = m.group()
        stretches = doubtful(candidate, window)
        public = public_windows(candidate, window) if stretches else b""
        for begin, stop in stretches:
            units = {x.span(): bits for _, pattern, bits in reversed(CLASSES) for x in pattern.finditer(candidate, begin, stop) if x.end() - x.start() >= window and not ALLOW.fullmatch(x.group())}
            for (start, end), least in units.items():
                open_at = None
                for i, e in enumerate(chain(window_entropies(candidate[start:end], window), (-1.0,)), start):
                    if e >= least - 1e-9 and not public[i]:
                        open_at = i if open_at is None else open_at
                    elif open_at is not None:
                        spans.append((m.start() + open_at, m.start() + i - 1 + window))
                        open_at = None
    return _merged(spans)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, in code points; matches that fail a length are dropped and not tried again."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that entropy adds): those that lie within a base span are not repeated."""
    base, more = base_spans(text), []
    if found := entropy_spans(text):
        ends = sorted((a, b) for _, a, b in base)
        furthest, at = -1, 0  # how far the base spans that have begun reach
        for a, b in found:
            while at < len(ends) and ends[at][0] <= a:
                furthest = max(furthest, ends[at][1])
                at += 1
            if furthest < b:
                more.append(("entropy", a, b))
    return base, more


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, spans and the digest of the base spans."""

    def read(ids, texts):
        found = [scan(t) for t in texts]
        count = lambda kind: [sum(k == kind for k, _, _ in base) for base, _ in found]
        digest = [hashlib.sha256(spans_text(base, ORDER).encode()).hexdigest() for base, _ in found]
        return ids, count("assign"), count("access"), count("hex"), [len(m) for _, m in found], digest, [spans_text(b + m, ORDER) for b, m in found]

    return map_rows(documents(docs), read, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string", ["doc_id", "text"])


def redact(text: str, mark: str = "[REDACTED]") -> str:
    base, more = scan(text)
    out, at = [], 0
    for a, b in _merged([(s, e) for _, s, e in base + more]):
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same columns and rows, each secret in `text` replaced by a mark; null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t))

    return docs.withColumn("text", clean("text"))

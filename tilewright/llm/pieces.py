"""SentencePiece encoding and decoding by a table of last tokens over text prefixes.

In byte-pair merging every prefix of a text has one encoding, so it has one last token. A token that an automaton finds ending at a place is the last token of
the prefix there if the prefix before it ends in a token that is compatible with it: two tokens are compatible if merging their joined characters
gives just these two. A merge across a border of a token sequence happens first between two neighbours, so a sequence is an encoding if each two
neighbours are compatible. The table costs time linear in the text; ids are recovered backwards from its end.

As far as no piece holds the border between them, a text falls into chunks of white space and the letters or other characters after it; what short ones gave is
kept in a table of bounded size, which changes cost only. Characters outside the vocabulary become byte tokens.
Defined results: null and empty texts have no tokens and decode to the empty text; rows with null or repeated ids are encoded like any other; very long texts are
encoded and decoded a block of chunks at a time; the lower block mark U+2581 in a text is read as a space, as the library does; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, islice
from typing import NamedTuple

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import documents, map_rows

#: The mark that stands for a space, the bytes of a broken character, and the text of an unknown id.
SPACE, BROKEN, UNKNOWN = "▁", "�".encode(), " ⁇ ".encode()
#: Characters of a chunk and chunks that are kept, pairs of tokens whose test is kept, chunks of a block, and characters of a text that is cut up step by step.
KEPT_SIZE, KEPT, PAIRS, BLOCK, LONG = 32, 1 << 20, 1 << 20, 1 << 14, 1 << 20


class Vocabulary(NamedTuple):
    """Pieces by id, with the kind of each (normal, byte, unknown or control) and its score."""

    pieces: list[str]
    kinds: list[str]
    scores: list[float]


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a byte-pair model whose texts aren't normalised but for spaces; its size doesn't depend on the data."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if any(map(model.is_unused, ids)):
        raise ValueError("models with unused pieces aren't served")
    kinds = ["unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "byte" if model.is_byte(i) else "normal" for i in ids]
    if kinds.count("byte") != 256:
        raise ValueError("only models with byte tokens are served")
    found = Vocabulary([model.id_to_piece(i) for i in ids], kinds, np.array([model.get_score(i) for i in ids], np.float32).tolist())
    own = Encoder(found)
    for probe in (" a  b ", "ﬁ ① é", "x" * 40, " " * 40 + "y"):
        if list(chain.from_iterable(own.blocks(probe))) != model.encode(probe):
            raise ValueError("not a byte-pair model with a leading space and no other normalisation")
    return found


def chunk_pattern(inner: set[tuple[str, str]]) -> str:
    """The pattern of chunks: white space, and the letters or other characters after it, as far as no neighbours inside a piece (`inner`) cross such a border."""
    if any(a != SPACE and b == SPACE for a, b in inner):
        return "(?s:.+)"
    odd = ""  # letters that stand beside others in a piece, such as small raised digits, are put to these
    while len(odd) < 100:
        letter = re.compile(rf"[^\W\d_{odd}]")
        across = [pair for pair in inner if SPACE not in pair and bool(letter.match(pair[0])) != bool(letter.match(pair[1]))]
        if not across:
            return rf"{SPACE}*(?:{letter.pattern}+|(?:[\d_{odd}]|[^\w{SPACE}])+)|{SPACE}+"
        odd += "".join(sorted({c for pair in across for c in pair if letter.match(c)}))
    return f"{SPACE}*[^{SPACE}]+|{SPACE}+"


class Encoder:
    """The tables of one vocabulary in a Python worker. Tokens are numbered by their ids, and characters outside the vocabulary from `beyond` on."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        normal = [i for i, k in enumerate(vocabulary.kinds) if k == "normal"]
        self.ids = {vocabulary.pieces[i]: i for i in normal}
        self.scores = {vocabulary.pieces[i]: vocabulary.scores[i] for i in normal}
        self.bytes = {int(vocabulary.pieces[i][3:5], 16): i for i, k in enumerate(vocabulary.kinds) if k == "byte"}
        self.beyond = len(vocabulary.pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.chunk = re.compile(chunk_pattern({pair for p in self.ids for pair in zip(p, p[1:], strict=False)}))
        self._pairs: dict[int, bool] = {}
        self._kept: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def token(self, number: int) -> str:
        return self.vocabulary.pieces[number] if number < self.beyond else chr(number - self.beyond)

    def merged(self, text: str) -> list[str]:
        """The merges by their rule, of a short text: the best score first, the leftmost of equal ones."""
        parts, known = list(text), self.scores.get
        score = [known(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while found := [s for s in score if s is not None]:
            at = score.index(max(found))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del score[at]
            if at:
                score[at - 1] = known(parts[at - 1] + parts[at])
            if at < len(score):
                score[at] = known(parts[at] + parts[at + 1])
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens a and b are the encoding of their joined characters; -1 as a stands for the begin of a text."""
        first, second = self.token(a) if a >= 0 else "", self.token(b)
        return self.merged(first + second) == ([first, second] if first else [second])

    def last_tokens(self, chunk: str) -> list[int]:
        """For each prefix of the chunk, from the empty one on, its last token."""
        last, n, pairs = [-1], 0, self._pairs
        for end, (token, size) in self.automaton.iter(chunk) if len(self.automaton) else ():
            if end < n:
                continue  # this prefix has its token
            while n < end:  # no piece ends here
                last.append(self.beyond + ord(chunk[n]))
                n += 1
            before = last[end + 1 - size]
            pair = before << 22 | token
            found = pairs.get(pair)
            if found is None:
                if len(pairs) >= PAIRS:
                    pairs.clear()
                found = pairs[pair] = self.compatible(before, token)
            if found:
                last.append(token)
                n = end + 1
        last += [self.beyond + ord(c) for c in chunk[n:]]
        return last

    def chunk_ids(self, chunk: str) -> list[int]:
        """The ids of a chunk, read backwards from its last token."""
        last, at, tokens = self.last_tokens(chunk), len(chunk), []
        while at:
            token = last[at]
            if token < self.beyond:
                tokens.append(token)
                at -= len(self.vocabulary.pieces[token])
            else:
                at -= 1
                tokens += [self.bytes[b] for b in reversed(chunk[at].encode("utf-8", "surrogatepass"))]
        tokens.reverse()
        return tokens

    def blocks(self, text: str) -> Iterator[list[int]]:
        """All ids of a text, those of a block of chunks at a time. What short chunks gave is kept in two generations of bounded size."""
        if not text:
            return
        marked = SPACE + text.replace(" ", SPACE)
        chunks = iter(self.chunk.findall(marked)) if len(marked) <= LONG else (m.group() for m in self.chunk.finditer(marked))
        while part := list(islice(chunks, BLOCK)):
            out: list[bytes] = []
            for chunk in part:
                ids = self._kept.get(chunk)
                if ids is None:
                    ids = self._older.get(chunk) or array("I", self.chunk_ids(chunk)).tobytes()
                    if len(chunk) <= KEPT_SIZE:
                        if len(self._kept) >= KEPT // 2:
                            self._kept, self._older = {}, self._kept
                        self._kept[chunk] = ids
                out.append(ids)
            yield array("I", b"".join(out)).tolist()

    @cached_property
    def surfaces(self) -> list[bytes | None]:
        """The bytes of each id but for the bytes' own ids."""
        of = {"normal": lambda p: p.replace(SPACE, " ").encode(), "control": lambda p: b"", "unknown": lambda p: UNKNOWN, "byte": lambda p: None}
        return [of[k](p) for p, k in zip(self.vocabulary.pieces, self.vocabulary.kinds, strict=True)]

    @cached_property
    def byte_of(self) -> dict[int, int]:
        return {i: b for b, i in self.bytes.items()}


def characters(raw: bytes) -> bytes:
    """The bytes of UTF-8 characters; each byte that belongs to none is a broken character of its own."""
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            lead = raw[at]
            size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
            try:
                raw[at : at + size].decode("utf-8")
                whole = size > 0 and at + size <= len(raw)
            except UnicodeDecodeError:
                whole = False
            out.append(raw[at : at + size] if whole else BROKEN)
            at += size if whole else 1
        return b"".join(out)


def decoded(encoder: Encoder, blocks: Iterable[list[int]]) -> Iterator[bytes]:
    """The UTF-8 bytes of a text from its ids, block by block: the leading space goes, and runs of byte ids are read as characters."""
    surfaces, byte_of, kinds = encoder.surfaces, encoder.byte_of, encoder.vocabulary.kinds
    begun, pending = False, bytearray()
    for ids in blocks:
        out: list[bytes] = []
        for i in ids:
            surface = surfaces[i]
            if surface is None:
                pending.append(byte_of[i])
                continue
            if pending:
                out.append(characters(bytes(pending)))
                pending.clear()
                begun = True
            if not begun and kinds[i] != "control":
                surface, begun = surface.removeprefix(b" ") if kinds[i] == "normal" else surface, True
            out.append(surface)
        yield b"".join(out)
    if pending:
        yield characters(bytes(pending))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and `ids`, all token ids of the text: one row per row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(ids, texts):
        own = _encoder(shared)
        return ids, [list(chain.from_iterable(own.blocks(t))) for t in texts]

    return map_rows(documents(docs), read, "doc_id bigint, ids array<int>", ["doc_id", "text"])


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and `text` of token ids (doc_id, ids); null ids are none."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def read(ids, tokens):
        own = _encoder(shared)
        return ids, [b"".join(decoded(own, [t or []])).decode("utf-8", "replace") for t in tokens]

    return map_rows(encoded, read, "doc_id bigint, text string", ["doc_id", "ids"])


def token_report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of `docs`; ids are encoded, digested and decoded a block at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(ids, texts):
        own = _encoder(shared)
        rows: list[tuple[int, str, str]] = []
        for text in texts:
            n, digest, back = 0, hashlib.sha256(), hashlib.sha256()

            def counted(blocks: Iterator[list[int]]) -> Iterator[list[int]]:
                nonlocal n
                for block in blocks:
                    digest.update(("," * bool(n) + ",".join(map(str, block))).encode())
                    n += len(block)
                    yield block

            for part in decoded(own, counted(own.blocks(text))):
                back.update(part)
            rows.append((n, digest.hexdigest(), back.hexdigest()))
        return ids, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    return map_rows(documents(docs), read, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["doc_id", "text"])

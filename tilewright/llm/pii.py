"""PII: fixed patterns, and information-theoretic sanitisation of the terms around them.

A protected entity is the value of a pattern's match (an address, a number). The words within `context` words of it are terms. Over the
whole corpus, the different texts in which a term stands near an entity, those that hold the term at all and those that hold the entity give
    disclosure(term -> entity) = log2(P(entity | term) / P(entity)) / -log2 P(entity),
the share of the entity's information that the term gives away: 0 if independent, 1 if the term gives it away for certain.
Terms at or above the threshold, seen with the entity in `support` different texts or more, are spans of kind `term` near that entity; copies of a text are no
further evidence.
Corpus counts of terms are taken through a bit filter of fixed size, so what is broadcast doesn't grow with the corpus.
Defined results: null and empty texts have no spans; repeated rows count once and get the same spans;
null ids are kept; without any entity no term is disclosed; terms of equal disclosure are all spans; very long texts are read whole; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, checkpointed, documents, in_filter, map_rows, spans_text, word_table

#: The patterns of the base kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3, "term": 4}
CONTEXT, SUPPORT, DISCLOSURE, FILTER_BITS = 8, 3, 0.95, 1 << 22


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping addresses, found from each `@` outwards in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns in code points; matches that fail a test are dropped and not tried again."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _entity(kind: str, value: str) -> int:
    value = value.lower() if kind == "email" else value if kind == "ip" else _digits(value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "big", signed=True)


def near_terms(text: str, base: list[tuple[str, int, int]], context: int = CONTEXT) -> list[dict]:
    """The words around each entity: term and entity as hashes, and the word's code points."""
    data, begin, end, words, _ = word_table([text])
    points = np.cumsum((data & 0xC0) != 0x80)
    start, stop = points[begin] - 1, points[end] - 1
    covered = np.zeros(len(begin), bool)
    ranges = []
    for kind, a, b in base:
        first, last = int(np.searchsorted(stop, a, side="right")), int(np.searchsorted(start, b))
        covered[first:last] = True
        ranges.append((kind, a, b, first, last))
    terms, out = words.view(np.int64).tolist(), []
    for kind, a, b, first, last in ranges:
        entity = _entity(kind, text[a:b])
        for i in [*range(max(0, first - context), first), *range(last, min(len(begin), last + context))]:
            if not covered[i]:
                out.append({"term": terms[i], "entity": entity, "s": int(start[i]), "e": int(stop[i])})
    return out


def pattern_matches(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """One row per document: counts, digest and text of the base spans, a key of its text, and its terms near entities."""

    def read(ids, keys, texts):
        found = [base_spans(t) for t in texts]
        count = [[sum(k == kind for k, _, _ in base) for base in found] for kind in ("email", "ip", "card", "phone")]
        spans = [spans_text(base, ORDER) for base in found]
        return ids, keys, *count, [hashlib.sha256(s.encode()).hexdigest() for s in spans], spans, [near_terms(t, base, context) if base else [] for t, base in zip(texts, found, strict=True)]

    schema = "doc_id bigint, text_key bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, terms array<struct<term:bigint,entity:bigint,s:int,e:int>>"
    keyed = documents(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return map_rows(keyed, read, schema, ["doc_id", "text_key", "text"])


def term_counts(docs: DataFrame, terms: DataFrame, repeated: DataFrame) -> DataFrame:
    """(term, n_term): the different texts of the whole corpus that hold each of `terms`; a filter of FILTER_BITS bits spares the rest.

    Texts that stand once are counted where they are read. Those that a second filter takes for `repeated` (text_key) give pairs of term and text, so that
    each counts once; the filter's size is fixed, and what it lets through beyond the repeated ones is counted right as well.
    """
    slots = terms.select(F.pmod("term", F.lit(FILTER_BITS)).cast("int").alias("slot")).distinct()
    bits = np.zeros(FILTER_BITS, bool)
    bits[np.asarray(slots.toPandas()["slot"], np.int64)] = True  # FILTER_BITS numbers at most, whatever the corpus
    wanted = docs.sparkSession.sparkContext.broadcast((np.packbits(bits), bit_filter(repeated)))

    def read(keys, texts):
        terms_of, copies = wanted.value
        _, _, _, words, first = word_table(texts)
        own = words.view(np.int64)
        held = np.flatnonzero(np.unpackbits(terms_of)[own & (FILTER_BITS - 1)]) if len(own) else np.zeros(0, np.int64)
        doc = np.searchsorted(first, held, side="right") - 1
        pairs = np.unique(np.stack([doc, own[held]], axis=1), axis=0) if len(held) else np.zeros((0, 2), np.int64)
        key = np.array(keys, np.int64)
        several = in_filter(copies, key)[pairs[:, 0]]
        found, n = np.unique(pairs[~several, 1], return_counts=True)
        apart = np.unique(np.stack([pairs[several, 1], key[pairs[several, 0]]], axis=1), axis=0)
        return [*found, *apart[:, 0]], [None] * len(found) + apart[:, 1].tolist(), [*n, *[1] * len(apart)]

    keyed = documents(docs).select(F.xxhash64("text").alias("text_key"), "text")
    counted = map_rows(keyed, read, "term bigint, text_key bigint, n bigint", ["text_key", "text"], size=1 << 22, rows=4096)
    once = counted.groupBy("term", "text_key").agg(F.sum("n").alias("n"))
    return once.groupBy("term").agg(F.sum(F.when(F.col("text_key").isNull(), F.col("n")).otherwise(1)).alias("n_term")).join(terms, "term", "left_semi")


def disclosures(docs: DataFrame, matched: DataFrame, support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """(term, entity, disclosure) of the terms that give an entity away, by counts of different texts."""
    texts = checkpointed(matched.groupBy("text_key").agg(F.count("*").alias("n")))
    total = texts.count()
    near = matched.where(F.size("terms") > 0).select("text_key", F.explode(F.array_distinct(F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["entity"].alias("entity"))))).alias("p")).select("text_key", "p.*").distinct()
    seen = near.groupBy("term", "entity").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    entities = near.select("entity", "text_key").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    seen = checkpointed(seen)
    counts = term_counts(docs, seen.select("term").distinct(), texts.where("n > 1").select("text_key"))
    gain = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity"))) / F.log2(F.lit(float(total)) / F.col("n_entity"))
    scored = seen.join(counts, "term").join(entities, "entity").where(F.col("n_entity") < total)
    return scored.select("term", "entity", gain.alias("disclosure")).where(F.col("disclosure") >= threshold)


def find_personal_data(docs: DataFrame, context: int = CONTEXT, support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans: one row per row of `docs`."""
    matched = checkpointed(pattern_matches(docs, context))
    told = disclosures(docs, matched, support, threshold)
    places = matched.where(F.size("terms") > 0).select("doc_id", "text_key", F.explode("terms").alias("t")).select("doc_id", "text_key", "t.*")
    kept = places.join(told, ["term", "entity"], "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("s", "e")).alias("terms"))
    rows = matched.drop("terms").alias("m").join(kept.alias("k"), F.expr("m.doc_id <=> k.doc_id AND m.text_key = k.text_key"), "left")

    @F.pandas_udf("string")
    def joined(base: pd.Series, terms: pd.Series) -> pd.Series:
        def one(b, t):
            if t is None or len(t) == 0:
                return b
            spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in b.split(",") if x)]
            return spans_text(spans + [("term", x["s"], x["e"]) for x in t], ORDER)

        return pd.Series([one(b, t) for b, t in zip(base, terms, strict=True)])

    n_term = F.coalesce(F.size("k.terms"), F.lit(0)).cast("bigint")
    spans = F.when(F.col("k.terms").isNull(), F.col("base")).otherwise(joined("base", "k.terms"))
    return rows.select("m.doc_id", "m.text_key", "n_email", "n_ip", "n_card", "n_phone", F.when(F.col("k.terms").isNull(), 0).otherwise(n_term).alias("n_term"), "base_sha256", spans.alias("spans"))


#: What stands in the place of a span; a disclosing word is generalised to its class of characters, a base match to its kind.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def mask(text: str, spans: str) -> str:
    last = len(text)
    for kind, s, e in sorted((x.split(":") for x in spans.split(",") if x), key=lambda x: (-int(x[1]), -int(x[2]))):
        a, b = int(s), min(int(e), last)
        if a >= b:
            continue
        mark = MARKS.get(kind) or ("[NUMBER]" if text[a:b].isdigit() else "[TERM]")
        text, last = text[:a] + mark + text[b:], a
    return text


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """doc_id and text, base matches and disclosing terms replaced by their kinds; one row per row of `docs`."""
    found = find_personal_data(docs, **how).select("doc_id", "text_key", "spans").dropDuplicates()

    @F.pandas_udf("string")
    def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([mask(t, s) if s else t for t, s in zip(text, spans, strict=True)])

    rows = documents(docs).withColumn("text_key", F.xxhash64("text")).alias("d")
    return rows.join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.text_key = f.text_key"), "left").select("d.doc_id", masked("d.text", "f.spans").alias("text"))

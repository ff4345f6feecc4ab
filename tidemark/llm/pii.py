"""Personal data: base patterns, and information-theoretic sanitisation of what reveals it.

Base spans (e-mail, IP address, card and phone number) come from patterns that are checked.  Each match is a protected
entity, and so are its coarser grains: the domain and the name of an address, the network of an IP address.  Terms are
words, lower-cased, cut at white space and ASCII punctuation, outside base spans.  With probabilities as shares of all
documents, an entity has the information content IC(e) = -log P(e), and a term tells PMI(e; t) = log P(e, t) / P(e) P(t)
of it.  A pair that at least SUPPORT different texts have discloses the share PMI / IC of the entity; terms that
disclose GENERALISE or more of some entity become spans of kind `term` in every document, also where the entity
does not stand: generalised to a word class, or removed from REMOVE on.  What a share of COMMON of all documents mentions identifies
nobody and is not protected.

Counts cover every document.  Only documents with an entity send their terms; the terms found are looked up in all documents
through a bit table of fixed size, and what passes it is joined exactly.

A null text counts as empty.  Rows that repeat doc_id and text get the same spans; copies of a text count as documents
but as one text.  A null doc_id is fine.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import MARKS, Words, buffers, slices
from tidemark.sources.sinks import staged

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 2
COMMON = 0.1
GENERALISE, REMOVE = 0.75, 0.9
#: Bits of the table through which terms are looked up.
BITS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: Parts of an address that may name a person.
_NAME = re.compile(r"[a-z]{3,}")
# A match cannot begin inside a run of digits whose beginning fails; the look-behind keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Every address; the local part is read backwards from the sign, so long runs cost nothing."""
    out, end, sign = [], 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, sign + 1) if start < sign else None
        if found:
            end = found.end()
            out.append((start, end))
        sign = text.find("@", max(sign + 1, end))
    return out


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[::-2]))) % 10 == 0


def _ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str) -> bool:
    return 9 <= len(_DIGIT.findall(text)) <= 15


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Start and end of the matches of each kind."""
    out = [emails(text) if "@" in text else []]
    if not _DIGIT.search(text):
        return [*out, [], [], []]
    for pattern, check in ((_IP, _ip), (_CARD, _card), (_PHONE, _phone)):
        out.append([m.span() for m in pattern.finditer(text) if check(m.group())])
    return out


def joined(kinds, spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(kinds, spans) for a, b in own)


def entities(text: str, spans: list[list[tuple[int, int]]]) -> list[str]:
    """Names of the protected entities of a text, coarser grains included."""
    out = set()
    for kind, own in zip(KINDS, spans):
        for a, b in own:
            match = text[a:b].lower()
            if kind in ("card", "phone"):
                match = "".join(_DIGIT.findall(match))
            out.add(f"{kind}:{match}")
            if kind == "ip":
                out.add(f"net:{match.rpartition('.')[0]}")
            elif kind == "email":
                local, _, domain = match.partition("@")
                out.add(f"domain:{domain}")
                out |= {f"name:{x}" for x in _NAME.findall(local)}
    return sorted(out)


def number(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True)


def terms(text: str, spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word outside the spans."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    words = Words(data, np.array([0, len(data)]), separators=MARKS, lower=True)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Code point number of each byte.
    point = np.cumsum((data & 0xC0) != 0x80) - 1
    first, last = point[words.starts], point[words.ends - 1] + 1
    every = np.array(sorted(s for own in spans for s in own), np.int64).reshape(-1, 2)
    # Of the spans that begin before a word ends, the one that reaches farthest decides.
    reach = np.r_[-1, np.maximum.accumulate(every[:, 1])] if len(every) else np.array([-1])
    out = reach[np.searchsorted(every[:, 0], last)] <= first
    return words.hash.view(np.int64)[out], first[out], last[out]


_FOUND = "doc_id long, mark long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, terms array<long>"


def _found(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            counts, base, named, told = [], [], [], []
            for text in part.column("text"):
                text = text.as_py() or ""
                spans = base_spans(text)
                counts.append([len(s) for s in spans])
                base.append(joined(KINDS, spans))
                named.append([number(x) for x in entities(text, spans)] if base[-1] else [])
                told.append(np.unique(terms(text, spans)[0]) if base[-1] else [])
            columns = np.array(counts, np.int64).reshape(-1, 4)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (named, told)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), *(pa.array(columns[:, i]) for i in range(4)), pa.array(base, pa.string()), *lists],
                ["doc_id", "mark", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "terms"],
            )


def _terms(batches):
    """Documents of each term, added up for a batch."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        found = []
        for i, j in slices(offsets):
            words = Words(data, offsets[i : j + 1], separators=MARKS, lower=True)
            order = np.lexsort((words.doc, words.hash))
            term, doc = words.hash[order], words.doc[order]
            if len(term):
                new = np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]
                found.append(np.unique(term[new], return_counts=True))
        if found:
            term, count = (np.concatenate(x) for x in zip(*found))
            term, place = np.unique(term, return_inverse=True)
            count = np.bincount(place, count).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count)], ["term", "docs"])


def disclosures(found: DataFrame, docs: DataFrame) -> DataFrame:
    """entity, term, docs_entity, docs_term, docs_both, texts, disclosure of the pairs over the threshold."""
    total = found.count()
    held = found.where(F.size("entities") > 0).select("mark", "terms", F.explode("entities").alias("entity"))
    # Equal texts have equal terms, so one list for each text goes on, with its number of copies.
    held = held.groupBy("entity", "mark").agg(F.count("*").alias("n"), F.first("terms").alias("terms"))
    held = staged(held, "entity-texts")
    known = held.groupBy("entity").agg(F.sum("n").alias("docs_entity"), F.count("*").alias("texts"))
    known = known.where((F.col("texts") >= SUPPORT) & (F.col("docs_entity") <= COMMON * total)).drop("texts")
    pairs = held.join(known, "entity").select("entity", "docs_entity", "n", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(
        F.max("docs_entity").alias("docs_entity"), F.sum("n").alias("docs_both"), F.count("*").alias("texts")
    )
    counts = docs.select("text").mapInArrow(_terms, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs_term"))
    told = pairs.where(F.col("texts") >= SUPPORT).join(counts, "term")
    content = -F.log(F.col("docs_entity") / total)
    shared = F.log(F.col("docs_both") * total / (F.col("docs_entity") * F.col("docs_term")))
    told = told.withColumn("disclosure", shared / content).where(F.col("disclosure") >= GENERALISE)
    return told.select("entity", "term", "docs_entity", "docs_term", "docs_both", "texts", "disclosure")


def _looked_up(places: np.ndarray):
    """Occurrences of terms whose place in the bit table is set, with the code points where they stand."""

    def run(batches):
        table = np.zeros(BITS, bool)
        table[places] = True
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                words = Words(data, offsets[i : j + 1], separators=MARKS, lower=True)
                hit = np.flatnonzero(table[words.hash % np.uint64(BITS)])
                if not len(hit):
                    continue
                # Code points before each byte of the slice; a document's own count begins at its first byte.
                point = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                doc = words.doc[hit]
                begin = point[words.offsets[doc]]
                first, last = point[words.starts[hit]] - begin, point[words.ends[hit]] - begin
                rows = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in ("key", "mark")), *(pa.array(x) for x in (words.hash[hit].view(np.int64), first, last))],
                    ["key", "mark", "term", "start", "end"],
                )

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans (texts), terms of every row of `docs(doc_id, text)`.

    `terms`: (start, end, disclosure) of the terms that reveal an entity, in order.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("mark", F.xxhash64("text"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    found = staged(docs.select("doc_id", "mark", "text").mapInArrow(_found, _FOUND), "found")
    told = staged(disclosures(found, docs).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosures")
    # At most BITS numbers.
    places = told.select(F.col("term").bitwiseAND(F.lit(BITS - 1)).alias("p")).distinct()
    places = np.array([r["p"] for r in places.collect()], np.int64)
    near = docs.select(key, "mark", "text").mapInArrow(_looked_up(places), "key string, mark long, term long, start long, end long")
    near = near.join(told, "term").groupBy("key", "mark")
    more = near.agg(F.array_sort(F.collect_set(F.struct("start", "end", "disclosure"))).alias("told"))
    out = found.drop("entities", "terms").withColumn("key", key).join(more, ["key", "mark"], "left")
    # A word that a base span touches is no term.
    apart = "not exists(split(base, ','), s -> base != '' and int(split_part(s, ':', 2)) < t.end and int(split_part(s, ':', 3)) > t.start)"
    out = out.withColumn("terms", F.expr(f"filter(told, t -> {apart})")).drop("told")
    out = out.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")))
    texts = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, F.array_join(texts, ",")))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base", spans.alias("spans"), "terms")


def _clean(batches):
    for batch in batches:
        out = []
        for text, spans, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "terms"))):
            text, parts, at = text or "", [], 0
            share = {(t["start"], t["end"]): t["disclosure"] for t in terms or []}
            marks = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in (spans or "").split(",") if s))
            for a, b, kind in marks:
                if a < at:
                    continue
                word = text[a:b]
                label = kind if kind != "term" else "removed" if share[a, b] >= REMOVE else "number" if word.isdigit() else "name" if word[:1].isupper() else "word"
                parts += text[at:a], f"[{label}]"
                at = b
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def sanitised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and text with every span of `found` (from personal_data) replaced by the name of its class."""
    found = found.select(F.col("doc_id").alias("_id"), "spans", "terms").dropDuplicates(["_id", "spans"])
    rows = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left").select(docs["doc_id"].cast("long").alias("doc_id"), "text", "spans", "terms")
    return rows.mapInArrow(_clean, "doc_id long, text string")

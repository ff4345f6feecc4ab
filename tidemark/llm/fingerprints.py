"""Document fingerprints by Order MinHash, in built-in Spark functions only.

The bytes of a text are cut into pieces where the content says so: a piece ends with the first run of bytes of class 0
within REACH bytes, or else of class 1, and so on; classes are shares of the byte values, mixed by a multiplier.
Cuts move with the text, whatever its script and with or without white space, so one edit changes the pieces around it.
A k-mer is K neighbouring pieces (fewer pieces: all of them), numbered by its occurrence.  Each numbered k-mer is hashed
once; the top bits choose one of 2^BIN_BITS bins, and each bin selects its TUPLE smallest hashes, puts them back into
text order and hashes the tuple.  A fingerprint is the sorted list of bin and tuple hash, 32 bits each, as hexadecimal
text.  Moving, inserting or replacing text changes tuples where order or content changes, so likeness (equal entries
over bins that either has) follows edit distance.

Positions have 31 bits, as many as an array can have entries.  A null text counts as empty and has an empty fingerprint;
two empty fingerprints have likeness 1.  A null doc_id comes last in the order of documents, and rows with one doc_id
follow each other by a hash of their text.  A table of one row is followed by itself.  Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, TUPLE, BIN_BITS = 2, 2, 6
CLASSES, MULTIPLIER, REACH = 8, 201, 32
_LAST = (1 << 63) - 1
#: Lower bits of a packed value are a position, upper ones a hash.
PLACE_BITS = 31
_HASH, _PLACE = -(1 << PLACE_BITS), (1 << PLACE_BITS) - 1


def piece_pattern() -> str:
    """Pattern of a piece of a text whose characters are the bytes."""
    own = ["".join(f"\\x{b:02x}" for b in range(256) if b * MULTIPLIER % 256 * CLASSES // 256 == k) for k in range(CLASSES)]
    return "|".join(f"[^{c}]{{0,{REACH - 1}}}+[{c}]{{1,{REACH}}}" for c in own)


def with_entries(docs: DataFrame, text: str, out: str) -> DataFrame:
    """`docs` with the fingerprint entries of column `text` as array<bigint> `out`.

    Steps are columns of their own: each is worked out once for a row, and sorting stays compiled code.
    """
    pieces, grams, starts, numbered, bins = (f"_{out}_{s}" for s in ("pieces", "grams", "starts", "numbered", "bins"))
    gram = ", ".join(f"get({pieces}, i + {j})" for j in range(K))
    as_bytes = F.decode(F.col(text).cast("binary"), "ISO-8859-1")
    docs = docs.withColumn(pieces, F.regexp_extract_all(as_bytes, F.lit(piece_pattern()), F.lit(0)))
    docs = docs.withColumn(
        grams,
        F.expr(
            f"sort_array(transform(filter(sequence(0, greatest(size({pieces}) - {K}, 0)), i -> i < size({pieces})), "
            f"i -> (xxhash64({gram}) & {_HASH}L) | (i & {_PLACE}L)))"
        ),
    )
    docs = docs.withColumn(
        starts,
        F.expr(
            f"filter(sequence(0, size({grams})), j -> j < size({grams}) and "
            f"(j = 0 or (get({grams}, j) & {_HASH}L) != (get({grams}, j - 1) & {_HASH}L)))"
        ),
    )
    docs = docs.withColumn(
        numbered,
        F.expr(
            f"sort_array(flatten(transform({starts}, (g, j) -> transform("
            f"sequence(g, coalesce(get({starts}, j + 1), size({grams})) - 1), "
            f"q -> (xxhash64(get({grams}, q) & {_HASH}L, q - g) & {_HASH}L) | (get({grams}, q) & {_PLACE}L)))))"
        ),
    )
    top = 64 - BIN_BITS
    docs = docs.withColumn(
        bins,
        F.expr(
            f"filter(sequence(0, size({numbered})), j -> j < size({numbered}) and (j = 0 or "
            f"shiftrightunsigned(get({numbered}, j), {top}) != shiftrightunsigned(get({numbered}, j - 1), {top})))"
        ),
    )
    # Text order: the position goes in front, the hash behind.
    chosen = (
        f"filter(slice({numbered}, g + 1, {TUPLE}), "
        f"e -> shiftrightunsigned(e, {top}) = shiftrightunsigned(get({numbered}, g), {top}))"
    )
    in_order = f"sort_array(transform({chosen}, e -> shiftleft(e & {_PLACE}L, {64 - PLACE_BITS}) | shiftrightunsigned(e, {PLACE_BITS})))"
    tuple_hash = f"xxhash64(transform({in_order}, e -> e & {(1 << (64 - PLACE_BITS)) - 1}L))"
    entry = (
        f"shiftleft(shiftrightunsigned(get({numbered}, g), {top}), {32 - BIN_BITS}) | "
        f"(({tuple_hash}) & {(1 << (32 - BIN_BITS)) - 1}L)"
    )
    docs = docs.withColumn(out, F.expr(f"sort_array(transform({bins}, g -> {entry}))"))
    return docs.drop(pieces, grams, starts, numbered, bins)


def as_text(entries: str) -> Column:
    return F.expr(f"array_join(transform({entries}, e -> lpad(lower(hex(e)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Equal entries over bins that either fingerprint has, 0 to 1."""
    used = [f"transform({x}, e -> shiftright(e, {32 - BIN_BITS}))" for x in (a, b)]
    return F.expr(f"coalesce(try_divide(size(array_intersect({a}, {b})), size(array_union({used[0]}, {used[1]}))), 1.0D)")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of `docs(doc_id, text)`."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_entries(docs, "text", "entries").select("doc_id", as_text("entries").alias("fingerprint"))


def _block(cuts: list[int]) -> Column:
    """Number of the block of `_ord`: cuts below it, counted in two steps of square-root length."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.array(*[F.lit(g[-1]) for g in groups])
    at = F.size(F.filter(coarse, lambda c: c < F.col("_ord")))
    fine = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    return at * step + F.coalesce(F.size(F.filter(F.get(fine, at), lambda c: c < F.col("_ord"))), F.lit(0))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows of `docs(doc_id, text)` in blocks of ascending doc_id, and the window that walks a block.

    There are about as many blocks as rows in a block.  Each block ends with a copy of the row that follows it
    (`_extra`), so the next document is always in the same block.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("_ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    rows = docs.count()
    parts = math.isqrt(rows)
    cuts: list[int] = []
    if parts > 1:
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        found = docs.agg(F.percentile_approx("_ord", shares, max(10_000, 20 * parts)).alias("cuts")).first()["cuts"]
        cuts = sorted(set(found))
    docs = docs.withColumn("_block", _block(cuts)).withColumn("_extra", F.lit(False))
    firsts = docs.groupBy("_block").agg(F.min("_ord").alias("_first"))
    # One row of two numbers per block.
    by_block = Window.orderBy("_block")
    follows = firsts.select(
        F.col("_block").alias("_before"),
        F.coalesce(F.lead("_first").over(by_block), F.min("_first").over(Window.partitionBy())).alias("_next"),
    )
    extra = docs.join(follows, docs["_ord"] == follows["_next"]).select(
        "doc_id", "text", "_ord", F.col("_before").alias("_block"), F.lit(True).alias("_extra")
    )
    walk = Window.partitionBy("_block").orderBy("_extra", "_ord", "_tie")
    return docs.unionByName(extra).withColumn("_tie", F.xxhash64("text")), walk


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last quarter replaced by the beginning of the next document.
    """
    rows, walk = with_next(docs)
    rows = rows.withColumn("_next", F.coalesce(F.lead("text").over(walk), F.col("text")))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    start = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter)
    rows = rows.withColumn("edited", F.concat(start, F.substring(F.col("_next"), F.lit(1), quarter))).drop("_next")
    rows = with_entries(with_entries(rows, "text", "own"), "edited", "other").drop("text")
    rows = rows.withColumn("following", F.lead("own").over(walk)).where("not _extra")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        as_text("own").alias("fingerprint"),
        as_text("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "coalesce(following, own)").alias("near_next"),
    )

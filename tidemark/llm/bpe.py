"""Byte-pair encoding and decoding.

The encoder works through a piece of text with the longest tokens that start at each position, found by one
Aho-Corasick pass.  A token is accepted if it may follow the token before it: the pair table says whether merging
both texts together would keep the border between them.  If not, its next shorter prefix token is tried, and where
none is left the encoder steps back; a position that failed is never entered again, so the work is linear and the result
is exactly that of merging by rank.  Decoding copies each token's bytes from one buffer by a table of offsets.

Texts are cut at white space first; the pieces between are encoded once and remembered (two generations of
REMEMBERED at most).  The special token of the vocabulary is recognised in texts, as the public library
does.

A null text counts as empty: no tokens.  Rows are encoded one by one, so repeated rows need no care; extra columns are
ignored.  A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import lean

# The white space and the cutting pattern of the public byte-level tokenizer.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + "]+(?![^" + WHITE + "])|[" + WHITE + "]+"
)

REMEMBERED = 200_000
BATCH_BYTES = 1 << 20
_SPAN = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_PIECE = regex.compile(PIECES)


def _visible() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tokens in order of rank (bytes first, then merges), their ids, and the special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        ids = model["model"]["vocab"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["model"]["merges"]]
        signs = _visible()
        self.texts = [*signs, *(a + b for a, b in merges)]
        place = {text: i for i, text in enumerate(self.texts)}
        self.halves = [(i, i) for i in range(256)] + [(place[a], place[b]) for a, b in merges]
        self.ids = np.array([ids[t] for t in self.texts], np.uint32)
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens in order of id, and where each begins."""
        byte = {sign: i for i, sign in enumerate(_visible())}
        parts: dict[int, bytes] = {int(n): bytes(byte[c] for c in t) for n, t in zip(self.ids, self.texts)}
        parts |= {n: text.encode() for text, n in self.special.items()}
        size = max(parts) + 1
        every = [parts.get(i, b"") for i in range(size)]
        return np.frombuffer(b"".join(every), np.uint8), np.cumsum([0, *map(len, every)])


class Encoder(dict):
    """Token ids of texts; the dictionary itself remembers pieces between white space."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.signs = str.maketrans(dict(enumerate(_visible())))
        self.lengths = [len(t) for t in vocabulary.texts]
        self.halves = vocabulary.halves
        self.ids = vocabulary.ids
        self.merged = {pair: i for i, pair in enumerate(vocabulary.halves) if i >= 256}
        self.special = {text: np.uint32(n).tobytes() for text, n in vocabulary.special.items()}
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.tokens = ahocorasick.Automaton()
        place = {}
        for i, text in enumerate(vocabulary.texts):
            self.tokens.add_word(text, i)
            place[text] = i
        self.tokens.make_automaton()
        # The longest token that is a proper prefix of each token.
        self.shorter = [next((place[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in place), -1) for t in vocabulary.texts]
        self.pairs: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """A new entry of the pair table."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        known = self.pairs[left, right] = self._border_stays(left, right)
        return known

    def _border_stays(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that made both tokens.

        The later of both tokens is taken apart again and again; at each step the two tokens at the border must
        not merge earlier than the one just taken apart.
        """
        limit = len(self.halves)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and left >= 256:
                    limit, left = left, self.halves[left][1]
                    break
                if side == "right" and right >= 256:
                    limit, right = right + 1, self.halves[right][0]
                    break
            else:
                return True

    def piece(self, text: str) -> list[int]:
        """Ranks of the tokens of one piece, given in the vocabulary's signs."""
        if (token := self.tokens.get(text, -1)) >= 0:
            return [token]
        size, lengths, pairs = len(text), self.lengths, self.pairs
        longest = [-1] * (size + 1)
        for end, token in self.tokens.iter(text):
            # Ends come in rising order, so the last token noted for a start is its longest.
            longest[end + 1 - lengths[token]] = token
        shut: set[int] = set()
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if end not in shut:
                    fits = last < 0 or pairs.get((last, token))
                    if fits or fits is None and self.fits(last, token):
                        break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at, last, token = end, token, longest[end]
            else:
                shut.add(at)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
        return out

    def __missing__(self, span: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if packed := self.older.get(span):
            self[span] = packed
            return packed
        ranks = []
        for piece in _PIECE.findall(span):
            ranks += self.piece(piece.encode().decode("latin-1").translate(self.signs))
        packed = self.ids[ranks].astype("<u4").tobytes()
        if len(span) <= 64:
            self[span] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if len(text) <= BATCH_BYTES:
            return b"".join(map(self.__getitem__, _SPAN.findall(text)))
        spans, out = (m.group() for m in _SPAN.finditer(text)), []
        while part := list(islice(spans, 100_000)):
            out.append(b"".join(map(self.__getitem__, part)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not (found := self.cut.search(text)):
            return self._plain(text)
        out, at = [], 0
        while found:
            out += self._plain(text[at : found.start()]), self.special[found.group()]
            at = found.end()
            found = self.cut.search(text, at)
        return b"".join([*out, self._plain(text[at:])])


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.bytes, self.starts = vocabulary.table()

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """UTF-8 texts of packed ids; bytes that are no UTF-8 become replacement characters."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        first = self.starts[ids]
        lengths = self.starts[ids + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.arange(total) + np.repeat(first - (ends - lengths), lengths)].tobytes()
        marks = np.concatenate([[0], ends])[np.cumsum([0, *(len(p) // 4 for p in packed)])]
        return [_checked(data[a:b]) for a, b in zip(marks[:-1], marks[1:])]


def _checked(data: bytes) -> bytes:
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()


_built: dict[str, tuple[Encoder, Decoder]] = {}


def tools(key: str, vocabulary: Vocabulary) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of this worker, built once."""
    if key not in _built:
        _built.clear()
        _built[key] = Encoder(vocabulary), Decoder(vocabulary)
    return _built[key]


def _groups(texts: pa.Array):
    """Numbers of texts with about BATCH_BYTES characters together."""
    group, size = [], 0
    for i, text in enumerate(texts):
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= BATCH_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (packed little-endian 32-bit integers) of every row of `docs(doc_id, text)`.

    `path`: the vocabulary file.  With `decoded`, the column `decoded` holds the UTF-8 text of these ids.
    """
    vocabulary = Vocabulary(path)

    def run(batches):
        encoder, decoder = tools(path, vocabulary)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column("text")):
                packed = [encoder.encode(x) for x in texts]
                columns = [batch.column("doc_id").slice(at, len(texts)), pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array(decoder.decode(packed), pa.binary()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, ids binary" + (", decoded binary" if decoded else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of `ids(doc_id, ids)`; null ids give an empty text."""
    vocabulary = Vocabulary(path)

    def run(batches):
        _, decoder = tools(path, vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = decoder.decode([x.as_py() or b"" for x in part.column("ids")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t.decode() for t in texts])], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    made = encode(docs, path, decoded=True)
    return made.select(
        "doc_id",
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Byte-level BPE: encode whole texts to token ids, and decode ids to bytes.

Three steps. Texts are cut into pieces exactly where the pattern of the vocabulary cuts them,
for a batch at a time in NumPy: the pattern only asks whether a character is a letter, a number,
white space or none of these, so a table over code points and a few comparisons of neighbours
give all cuts. Bytes of a piece become the printable characters of the byte table, which is the
alphabet the ``tokenizers`` model works on. The model merges every distinct piece once; what it
gave is kept per worker, and the ids of a text are gathered from there.

Nulls and empty texts have no tokens. Texts of any length are encoded whole: longer ones go
through in slices that end where a piece ends anyway. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.workers import add_columns, map_batches, per_worker, texts_of

# Bytes that stand for themselves in the byte table. All others get the code
# points from 256 on, in ascending order.
_OWN_CHARACTER = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Characters per slice and distinct pieces kept per worker: they bound memory, not results.
SLICE_CHARS = 500_000
KEPT_PIECES = 500_000

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_CODE_POINTS = 0x110000


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    own = set(_OWN_CHARACTER)
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_from_ranks(ranks: dict[bytes, int]):
    """A ``tokenizers`` model that merges by rank.

    Every way to put a token together from two others is a merge, in the order of the ranks:
    the neighbours that make the token of the lowest rank are merged first.
    """
    from tokenizers import models

    table = byte_characters()
    spelled = {token: "".join(map(table.__getitem__, token)) for token in ranks}
    merges = [
        (spelled[token[:cut]], spelled[token[cut:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    vocabulary = {spelled[token]: rank for token, rank in ranks.items()}
    return models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True)


class Vocabulary:
    """A vocabulary file, its merging model and the bytes of every id."""

    def __init__(self, path: str):
        table = byte_characters()
        self.spelling = {byte: char for byte, char in enumerate(table)}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path).model
            with open(path, encoding="utf-8") as file:
                content = json.load(file)
            ids = content["model"]["vocab"]
            added = content.get("added_tokens") or []
            for token in added:
                if any(token.get(x) for x in ("single_word", "lstrip", "rstrip", "normalized")):
                    raise ValueError(f"added token {token['content']!r} is not matched as it stands")
            self.added = {token["content"]: token["id"] for token in added}
            back = {char: byte for byte, char in enumerate(table)}
            self.token_bytes = {
                i: bytes(back[c] for c in token)
                for token, i in ids.items()
                if all(c in back for c in token)
            }
            self.token_bytes.update({i: token.encode() for token, i in self.added.items()})
        else:
            self.added = {}
            ranks = load_ranks(path)
            self.model = model_from_ranks(ranks)
            self.token_bytes = {i: token for token, i in ranks.items()}
        # Where several added tokens start, the longest is taken.
        longest = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.size = max(self.token_bytes) + 1
        self.id_type = np.uint16 if self.size <= 1 << 16 else np.uint32

    def merge(self, piece: str) -> list:
        """Tokens of one piece, with ``id`` and ``offsets`` in bytes."""
        return self.model.tokenize(piece.encode().decode("latin-1").translate(self.spelling))

    def split(self, text: str) -> Iterator[tuple[str, int | None]]:
        """``text`` in parts that are not empty: those that are an added token of the file, with
        its id, and those between them."""
        at = 0
        if self.added_pattern:
            for found in self.added_pattern.finditer(text):
                if found.start() > at:
                    yield text[at : found.start()], None
                yield found[0], self.added[found[0]]
                at = found.end()
        if at < len(text):
            yield text[at:], None


def vocabulary(path: str) -> Vocabulary:
    return per_worker(("vocabulary", path), lambda: Vocabulary(path))


def _classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    classes = np.full(_CODE_POINTS, _OTHER, np.uint8)
    points = [p for p in range(_CODE_POINTS) if not 0xD800 <= p < 0xE000]
    everything = "".join(map(chr, points))
    where = np.array(points)
    for pattern, name in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for run in regex.finditer(pattern, everything):
            classes[where[run.start() : run.end()]] = name
    return classes


def _hash_tables(n: int = 2 * SLICE_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per code point, and the powers of an odd number and of its inverse."""
    random = np.random.default_rng(20240229)
    values = random.integers(1, 1 << 63, _CODE_POINTS, dtype=np.uint64)
    factor = int(random.integers(1, 1 << 62)) * 2 + 1
    inverse = pow(factor, -1, 1 << 64)
    powers = np.full(n, factor, np.uint64)
    backwards = np.full(n, inverse, np.uint64)
    powers[0] = backwards[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(backwards, out=backwards)
    return values, powers, backwards


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start among ``points``, the code points of texts that start at ``first``.

    Runs of letters, of numbers and of other characters are pieces, each with the one space
    before it. The rest of a run of white space is a piece of its own, and so is its last
    character if it is no space. An apostrophe that starts a run takes the ending after it along.
    """
    n = len(points)
    kind = per_worker("classes", _classes)[points]
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    text_start[n] = True
    before = np.empty(n, np.uint8)
    before[0] = 0
    before[1:] = kind[:-1]
    before[text_start[:-1]] = 0
    blank = kind == _SPACE
    before_text = np.zeros(n, bool)  # a word follows in the same text
    before_text[:-1] = ~blank[1:]
    before_text &= ~text_start[1:]
    space = points == 0x20
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1]
    after_space &= before != 0
    start = np.where(blank, (before != _SPACE) | before_text, (kind != before) & ~after_space)
    start[text_start[:-1]] = True

    ticks = np.flatnonzero((points == 0x27) & start)
    ticks = ticks[ticks + 1 < n]
    ticks = ticks[(kind[ticks + 1] == _LETTER) & ~text_start[ticks + 1]]
    if len(ticks):
        padded = np.concatenate([points, [0, 0, 0]])
        one, two = padded[ticks + 1], padded[ticks + 2]
        long_fits = ~text_start[ticks + 2]
        # The endings of the pattern.
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = long_fits & np.logical_or.reduce(
            [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        )
        for which, length in ((short, 2), (long & ~short, 3)):
            at = ticks[which]
            start[at + 1] = False
            ends = at + length
            start[ends[ends < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes batches of texts; keeps the ids of pieces it has seen."""

    def __init__(self, path: str):
        self.words = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted
        self.slots = np.empty(0, np.int64)
        self.pool = np.empty(1 << 16, self.words.id_type)
        self.used = 0
        self.begin = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """The position of each text that is not empty, and its ids. Texts come in order; one
        that is longer than a slice, or holds added tokens, comes in several parts."""
        batch: list[tuple[int, str, int | None]] = []
        chars = 0
        for i, text in enumerate(texts):
            for between, added in self.words.split(text):
                for part in slices(between) if added is None else [between]:
                    if batch and chars + len(part) > SLICE_CHARS:
                        yield from self._encode_parts(batch)
                        batch, chars = [], 0
                    batch.append((i, part, added))
                    chars += len(part)
        if batch:
            yield from self._encode_parts(batch)

    def _encode_parts(
        self, batch: list[tuple[int, str, int | None]]
    ) -> Iterator[tuple[int, np.ndarray]]:
        plain = [(i, part) for i, part, added in batch if added is None]
        encoded = self._encode_slice(plain) if plain else iter(())
        for i, _, added in batch:
            yield next(encoded) if added is None else (i, np.array([added], self.words.id_type))

    def _encode_slice(self, batch: list[tuple[int, str]]) -> Iterator[tuple[int, np.ndarray]]:
        joined = "".join(part for _, part in batch)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(part) for _, part in batch])
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        starts = piece_starts(points, first)
        which = self._pieces(joined, points, starts)
        sizes = self.count[which]
        total = np.cumsum(sizes)
        at = np.repeat(self.begin[which] - np.concatenate([[0], total[:-1]]), sizes)
        at += np.arange(total[-1])
        ids = self.pool[at]
        ends = np.concatenate([np.searchsorted(starts, first[1:]), [len(starts)]])
        done = 0
        for (i, _), end in zip(batch, ends, strict=True):
            yield i, ids[done : total[end - 1]]
            done = total[end - 1]

    def _pieces(self, joined: str, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The slot of every piece, after the model has merged those not seen before."""
        values, powers, inverse = per_worker("hashes", _hash_tables)
        if len(points) > len(powers):
            # A text without a place to cut it: tables that reach as far, for this slice only.
            values, powers, inverse = _hash_tables(len(points))
        running = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values[points] * powers[: len(points)], out=running[1:])
        ends = np.append(starts[1:], len(points))
        hashes = (running[ends] - running[starts]) * inverse[starts]
        codes, distinct = pd.factorize(hashes)
        if len(self.keys) > KEPT_PIECES:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        slots = np.empty(len(distinct), np.int64)
        slots[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            slots[new] = self._learn(joined, starts[first[new]], ends[first[new]])
            self._remember(distinct[new], slots[new])
        return slots[codes]

    def _learn(self, joined: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        merge = self.words.merge
        ids = [
            [token.id for token in merge(joined[a:b])]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
        ]
        sizes = np.array([len(x) for x in ids])
        flat = np.fromiter(chain.from_iterable(ids), self.words.id_type, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        slots = np.arange(len(self.begin), len(self.begin) + len(ids))
        self.begin = np.append(self.begin, self.used + np.cumsum(sizes) - sizes)
        self.count = np.append(self.count, sizes)
        self.used += len(flat)
        return slots

    def _remember(self, keys: np.ndarray, slots: np.ndarray) -> None:
        keys, slots = np.append(self.keys, keys), np.append(self.slots, slots)
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]


_SAFE_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def slices(text: str) -> Iterator[str]:
    """``text`` in parts that can be encoded apart: a space between letters starts a piece."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        cuts = [m.start() for m in _SAFE_CUT.finditer(text, at + SLICE_CHARS // 2, at + SLICE_CHARS)]
        if not cuts:
            cut = _SAFE_CUT.search(text, at + SLICE_CHARS)
            if not cut:
                break
            cuts = [cut.start()]
        yield text[at : cuts[-1]]
        at = cuts[-1]
    if at < len(text):
        yield text[at:]


def encoder(path: str) -> Encoder:
    return per_worker(("encoder", path), lambda: Encoder(path))


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of every text."""
    found = encoder(path)
    empty = np.empty(0, found.words.id_type)
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for i, ids in found.encode(texts):
        parts[i].append(ids)
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else empty for p in parts]


def token_offsets(text: str, path: str) -> list[tuple[int, int]]:
    """The bytes of the UTF-8 text, from and to, that each token stands for."""
    words = vocabulary(path)
    found, at = [], 0
    for part, added in words.split(text):
        if added is not None:
            end = at + len(words.token_bytes[added])
            found.append((at, end))
            at = end
            continue
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, np.array([0])).tolist()
        for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
            # One character stands for one byte, but the model counts offsets of that character's
            # own UTF-8 form; the bytes of each token tell them apart.
            for token in words.merge(part[a:b]):
                end = at + len(words.token_bytes[token.id])
                found.append((at, end))
                at = end
    return found


def decode_ids(ids: Iterable[int], path: str) -> bytes:
    """The bytes that ids stand for. An id that is not in the vocabulary raises a KeyError."""
    return b"".join(map(vocabulary(path).token_bytes.__getitem__, ids))


def decode_stream(parts: Iterable[Iterable[int]], path: str) -> Iterator[str]:
    """Text for ids that arrive in parts. A character whose bytes are split over parts comes
    with the part that completes it; bytes that are no text become U+FFFD."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for part in parts:
        yield decoder.decode(decode_ids(part, path))
    yield decoder.decode(b"", final=True)


def encode_documents(df: DataFrame, path: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with ``_ids``, the token ids as little-endian unsigned 32-bit integers, and, on
    request, ``_offsets``, the byte each token ends before."""
    def work(texts: list[str]) -> list[pa.Array]:
        ids = [x.astype("<u4").tobytes() for x in encode_texts(texts, path)]
        arrays = [pa.array(ids, pa.binary())]
        if offsets:
            ends = [[b for _, b in token_offsets(t, path)] for t in texts]
            arrays.append(pa.array(ends, pa.list_(pa.int32())))
        return arrays

    return add_columns(df, text, "_ids binary" + ", _offsets array<int>" * offsets, work)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: ``key, n_tokens, ids_sha256, decoded_sha256, intact``.

    ``intact`` tells whether the decoded bytes are the text's. One pass without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        rows = []
        for content, ids in zip(texts, encode_texts(texts, path), strict=True):
            decoded = decode_ids(ids.tolist(), path)
            rows.append(
                (
                    len(ids),
                    hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                    hashlib.sha256(decoded).hexdigest(),
                    decoded == content.encode(),
                )
            )
        counts, digests, back, intact = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(digests),
                pa.array(back),
                pa.array(intact),
            ],
            ["key", "n_tokens", "ids_sha256", "decoded_sha256", "intact"],
        )

    schema = (
        f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, intact boolean"
    )
    return map_batches(
        df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), work, schema
    ).withColumnRenamed("key", key)

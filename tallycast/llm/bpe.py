"""Byte-level BPE: an exact backtracking encoder over Aho-Corasick matches, and a decoder by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tallycast.llm.text import as_bytes, chunks, gathered, lists, map_arrow

#: The white space and the split pattern of byte-level vocabularies of this family.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: The same letters and numbers spelled out below U+0250, for a faster engine on texts that stay there.
LOW_LETTER, LOW_NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LOW_PATTERN = PATTERN.replace(r"\p{L}", f"[{LOW_LETTER}]").replace(r"\p{N}", f"[{LOW_NUMBER}]").replace(
    f"[^{WHITE}[{LOW_LETTER}][{LOW_NUMBER}]]", f"[^{WHITE}{LOW_LETTER}{LOW_NUMBER}]")
CACHED_PIECE, CACHED_PIECES = 64, 1_000_000
NEVER = 1 << 30
_loaded: dict[str, "Vocabulary"] = {}


def byte_of_character() -> dict[str, int]:
    """The printable stand-in of every byte: itself if visible in Latin-1, else the next character from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of pieces as little-endian 32-bit integers; the first million of the short ones are remembered."""

    def __init__(self, tables: Vocabulary):
        super().__init__()
        self.tables = tables

    def __missing__(self, piece: str) -> bytes:
        ids = self.tables.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_PIECE and len(self) < CACHED_PIECES:
            self[piece] = packed
        return packed


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file, and the tables of both directions."""

    def __init__(self, content: str):
        file = json.loads(content)
        as_byte = byte_of_character()
        raw = lambda token: bytes(as_byte[c] for c in token)
        vocab = {raw(token): i for token, i in file["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.merges = {(vocab[raw(a)], vocab[raw(b)]): (rank, vocab[raw(a + b)]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.bytes_of = {i: token for token, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(lengths))), dtype=np.uint8)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN)
        cut = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({cut})") if cut else None
        self.low_split = re.compile(LOW_PATTERN)
        self.high = re.compile(r"[^\x00-\u024f]")
        self.made_of = {whole: (rank, *pair) for pair, (rank, whole) in reversed(self.merges.items())}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.reached: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list] = {}
        self.known = _Pieces(self)

    def merged(self, data: bytes) -> list[int]:
        """The merge rule itself, on a few bytes: what the compatibility table is filled with."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            rank, at = min((self.merges.get(pair, (1 << 30, 0))[0], at) for at, pair in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 30:
                break
            first, second = ids[at], ids[at + 1]
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == first and ids[i + 1] == second:
                    out.append(self.merges[first, second][1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Left (1) or right (2) end tokens on the way from bytes to ``token``, each with the rank of the merge that swallows it."""
        key = (token, side)
        if key not in self.edges:
            steps, rank = [], NEVER
            while True:
                steps.append((token, rank))
                if token not in self.made_of:
                    break
                rank, token = self.made_of[token][0], self.made_of[token][side]
            self.edges[key] = steps[::-1]
        return self.edges[key]

    def open_border(self, before: int, token: int) -> bool:
        """Whether no merge crosses the border between two tokens.

        Merges run in the order of their ranks, equal ones from the left. At any time the two tokens that touch are known
        from both edges; they merge if their rank comes before the merges that swallow either.
        """
        left, right, i, j = self.edge(before, 2), self.edge(token, 1), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.merges.get((x, y), (NEVER, 0))[0]
            if rank < x_ends and rank <= y_ends and rank < NEVER:
                return False
            if x_ends == NEVER and y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        if token not in self.reached:
            self.reached[token] = self.merged(self.bytes_of[token]) == [token]
        return self.reached[token]

    def fits(self, before: int, token: int) -> bool:
        """The pair-compatibility table, filled as pairs occur."""
        pair = (before, token)
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[pair] = self.whole(token) and self.open_border(before, token)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece: the only split into tokens whose neighbours are all compatible.

        One pass of the automaton lists the tokens that start at each byte, the longest last. The walk takes the longest
        that fits the token before it; where none fits, the position is closed for good and the walk steps back.
        """
        starts: list[list] = [[] for _ in piece]
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            starts[end - length + 1].append((length, token))
        closed, taken, at = bytearray(len(piece) + 1), [], 0
        choice = len(starts[0]) - 1 if piece else -1
        while at < len(piece):
            options = starts[at]
            while choice >= 0:
                length, token = options[choice]
                if not closed[at + length] and (self.fits(taken[-1][1], token) if taken else self.whole(token)):
                    break
                choice -= 1
            if choice >= 0:
                taken.append((at, token, choice))
                at += length
                choice = len(starts[at]) - 1 if at < len(piece) else -1
            else:
                closed[at] = 1
                at, _, choice = taken.pop()
                choice -= 1
        return [token for _, token, _ in taken]

    def encode(self, text: str) -> bytes:
        out = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            else:
                split = self.split if self.high.search(part) else self.low_split
                out.extend(map(self.known.__getitem__, split.findall(part)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered through the offset table; broken UTF-8 becomes the replacement character."""
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        where = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
        return self.blob[where].tobytes().decode(errors="replace").encode()


def vocabulary(content: bytes) -> Vocabulary:
    """The tables of a tokenizer file, built once per worker process."""
    key = hashlib.md5(content).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(content.decode())
    return _loaded[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", packed: bool = False, decode: bool = False,
) -> DataFrame:
    """``[id_column, n_tokens, ids]``, and ``decoded`` on request, for every document.

    ``path`` names a tokenizer file of the driver; its content travels with the tasks. ``ids`` is an array of integers or,
    if ``packed``, their little-endian 32-bit form. Special tokens written in a text are encoded as such. Null text counts as
    empty and has no ids; ids of documents may be null or repeated; other columns are ignored. Bytes that are not UTF-8
    become the replacement character. Memory is bounded by one text and a cache of short pieces.
    """
    content = _read(path)

    def run(rows) -> Iterator[list]:
        tables = vocabulary(content)
        for held in chunks((key, text or b"") for key, text in rows):
            coded = [tables.encode(text.decode(errors="replace")) for _, text in held]
            counts = [len(ids) // 4 for ids in coded]
            out = [pa.array([key for key, _ in held], pa.int64()), pa.array(counts, pa.int64())]
            out.append(pa.array(coded, pa.binary()) if packed else lists(np.frombuffer(b"".join(coded), dtype="<i4"), counts))
            if decode:
                out.append(pa.array([tables.decode(np.frombuffer(ids, dtype="<u4").astype(np.int64)) for ids in coded], pa.binary()))
            yield out

    source = docs.select(F.col(id_column).cast("long").alias("id"), as_bytes(text_column).alias("text"))
    kind = "binary" if packed else "array<int>"
    out = map_arrow(source, run, f"id long, n_tokens long, ids {kind}" + ", decoded binary" * decode)
    out = out.withColumnRenamed("id", id_column)
    return out.withColumn("decoded", F.col("decoded").cast("string")) if decode else out


def decode_documents(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``[id_column, text]`` from arrays of ids; null ids give an empty text."""
    content = _read(path)

    def run(rows) -> Iterator[list]:
        tables = vocabulary(content)
        texts = ((key, tables.decode(np.array(ids or [], dtype=np.int64))) for key, ids in rows)
        yield from gathered(texts, [pa.int64(), pa.binary()], weigh=lambda row: len(row[1]) + 64)

    source = encoded.select(F.col(id_column).cast("long").alias("id"), F.col(ids_column).alias("ids"))
    return map_arrow(source, run, "id long, text binary").select(F.col("id").alias(id_column), F.col("text").cast("string").alias("text"))

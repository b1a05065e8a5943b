"""Byte-level BPE by monoid tree reduction.

A piece's bytes are halved down to single bytes, and encoded neighbours are joined up the tree by encoding a window
around the seam anew. A window's tokens may stand as soon as the token before it and its first token, and its last token and
the one after it, are stable pairs: a pair (a, b) is stable if the bytes of a and b, encoded together, give a, b again.
A token sequence in which every adjacent pair is stable is the BPE encoding of its bytes, so nothing outside
the window can change. Until then the window grows on the side that isn't stable, each time by twice as much. Decoding
concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import table, tokenizer_file

#: Encoded pieces, halves of pieces, and seams that a task remembers at most of each.
CACHE = 300_000
#: Bytes up to which pieces are remembered from one text to the next, and halves from one piece to the next.
SHORT, HALF = 64, 12
VOCABULARY = "byte_bpe_50k.tiktoken"


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.bytes = [(ranks[bytes([i])],) for i in range(256)]
        self.split = regex.compile(pattern).findall
        self.seams: dict[tuple[int, int], tuple[int, ...]] = {}
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.joins = 0

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Encodes a window: the adjacent pair of the lowest rank, leftmost first, is merged until none is left."""
        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; -1 once it is merged away
        heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            mid = ends[i]
            if mid < 0 or mid >= n or ranks.get(data[i : ends[mid]]) != rank:  # one of the two has been merged since
                continue
            end = ends[i] = ends[mid]
            ends[mid] = -1
            if end < n:
                before[end] = i
                if (rank := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (rank, i))
            if i and (rank := ranks.get(data[before[i] : end])) is not None:
                heapq.heappush(heap, (rank, before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def seam(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two neighbours' bytes; it is (a, b) if they are a stable pair."""
        if (found := self.seams.get((a, b))) is None:
            if len(self.seams) >= CACHE:
                self.seams.clear()
            found = self.seams[a, b] = self.merge(self.tokens[a] + self.tokens[b])
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's operation: the encoding of the bytes of left and right together."""
        if not left or not right:
            return left + right
        self.joins += 1
        window = self.seam(left[-1], right[0])
        if window == (left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1  # the window is left[i:] + right[:j]
        more_left = more_right = 1
        while True:
            sound_left = not i or self.seam(left[i - 1], window[0]) == (left[i - 1], window[0])
            sound_right = j == len(right) or self.seam(window[-1], right[j]) == (window[-1], right[j])
            if sound_left and sound_right:
                return left[:i] + window + right[j:]
            if not sound_left:
                i, more_left = max(0, i - more_left), 2 * more_left
            if not sound_right:
                j, more_right = min(len(right), j + more_right), 2 * more_right
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[i:] + right[:j])))

    def _encode(self, data: bytes, seen: dict[bytes, tuple[int, ...]]) -> tuple[int, ...]:
        if len(data) == 1:
            return self.bytes[data[0]]
        known = self.halves if len(data) <= HALF else seen
        if (found := known.get(data)) is None:
            mid = len(data) // 2
            found = self.join(self._encode(data[:mid], seen), self._encode(data[mid:], seen))
            if len(known) >= CACHE:
                known.clear()
            known[data] = found
        return found

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """The tree's halves that are equal are encoded once. Work grows with the length and its logarithm, for runs of one letter too."""
        if (rank := self.ranks.get(data)) is not None:  # as the library does; it holds for whole pieces only
            return (rank,)
        return self._encode(data, {}) if data else ()

    def encode(self, text: str) -> list[int]:
        """Each match of the pattern is encoded by itself, so matches meet without a window."""
        return [i for piece in self.split(text) for i in self.encode_piece(piece.encode("utf-8"))]

    def decode(self, ids: list[int] | tuple[int, ...]) -> bytes:
        """Concatenates up the tree."""
        if len(ids) <= 512:
            return b"".join(map(self.tokens.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class Digested(dict):
    """Of each piece (a string): its number of tokens, their ids in decimal with blanks between, and the bytes decoded from them."""

    def __init__(self, coder: TreeBpe):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.coder.encode_piece(piece.encode("utf-8"))
        value = (len(ids), " ".join(map(str, ids)), self.coder.decode(ids))
        if len(piece) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = value
        return value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_coders: dict[str, TreeBpe] = {}


def coder(path: str) -> TreeBpe:
    """The coder of a rank file; a worker process keeps it."""
    if path not in _coders:
        import public_tokenizers

        _coders[path] = TreeBpe(read_ranks(path), public_tokenizers.PATTERN)
    return _coders[path]


def encode_texts(df: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; a null or empty text has no ids. Repeated rows are encoded each;
    further columns aren't read. vocabulary: path of a rank file that every executor has."""
    path = vocabulary or tokenizer_file(VOCABULARY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = coder(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["_id"], "ids": [one.encode(t or "") for t in batch["_text"]]})

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("_id"), df[text].alias("_text")).mapInPandas(run, f"doc_id {kind}, ids array<int>")


def decode_ids(df: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, decoded binary); null ids decode to no bytes."""
    path = vocabulary or tokenizer_file(VOCABULARY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = coder(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["_id"], "decoded": [one.decode([] if x is None else list(x)) for x in batch["_ids"]]})

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("_id"), df[ids].alias("_ids")).mapInPandas(run, f"doc_id {kind}, decoded binary")


def digest_texts(df: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding, then decoding of the ids, without moving the ids.
    Null and empty texts have no tokens and the digests of no bytes. Repeated rows are digested each; further columns aren't read. A very
    long piece costs a task some tens of times its length in memory, since the halves of its tree are remembered while it is encoded."""
    path = vocabulary or tokenizer_file(VOCABULARY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = coder(path)
        piece = Digested(one).__getitem__
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                parts = [piece(p) for p in one.split(text or "")]
                joined, decoded = " ".join([p[1] for p in parts]), b"".join([p[2] for p in parts])
                rows.append((sum([p[0] for p in parts]), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["_id"].to_numpy())
            yield out

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("_id"), df[text].alias("_text")).mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_texts(table(spark, sf_dir, "documents"))

"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Which lengths share a sequence is decided on the histogram of lengths (at most `capacity` numbers, whatever the
corpus's size): a configuration linear program, solved by multiplicative weights whose pricing step is a
knapsack dynamic program, then rounded; what rounding leaves is packed best-fit. Spark then matches pieces to
places: the r-th piece of a length takes the r-th place of that length in the plan.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import give_back, materialize, number_within, table, tokenizer_file

CAPACITY = 2048
#: Id that ends each document.
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Words, and parts of words, whose ids a task remembers at most.
CACHE = 400_000
#: The solver stops once its value is within this share of the dual bound.
GAP = 0.05
#: Learning rate of the weights, and how far below the best price a pattern may lie that is used.
ETA, SLACK = 0.1, 0.05
#: The same for patterns that rounding adds.
TIGHT = 0.0005
#: A length whose price has fallen to this share of its first one doesn't limit how often a pattern is used.
CHEAP = 0.01

#: Python's split() takes these for white space, the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[ \t-\r]+")
#: Words whose parts can be told apart here as the tokenizer does it, and these parts (of the word in lower case).
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the tokenizer's merges: printable Latin-1 for itself, the other bytes in order from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_letters()


@dataclass
class Plan:
    """Patterns (lengths, with repeats, of one sequence) and how many sequences use each."""

    patterns: list[tuple[int, ...]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)

    def add(self, pattern: tuple[int, ...], count: int) -> None:
        self.patterns.append(pattern)
        self.counts.append(count)


@dataclass
class Cover:
    """Fractional solution: how often each pattern is used; its value, the dual bound below which no solution lies, and the dual prices
    that give it (no pattern's lengths are worth more than 1 together)."""

    uses: dict[tuple[int, ...], float]
    value: float
    bound: float
    prices: dict[int, float]


def best_values(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack with repeats, by dynamic programming: the greatest total price of lengths (ascending) within each capacity."""
    value = np.zeros(capacity + 1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        fits = ends[c]
        value[c] = max(value[c - 1], (value[c - lengths[:fits]] + prices[:fits]).max())
    return value


def trace(value: np.ndarray, prices: np.ndarray, lengths: np.ndarray, most: np.ndarray | None = None, first: int | None = None) -> list[int]:
    """A pattern, as places in lengths, that follows value, a table of best_values, for prices that may have fallen since; of equally good
    lengths the longest comes first. most: how often each may stand in it; first: one that it begins with."""
    room, out, used = len(value) - 1, [], Counter()
    while room >= lengths[0]:
        if first is not None and not out:
            k = first
        else:
            fits = int(np.searchsorted(lengths, room, "right"))
            total = value[room - lengths[:fits]] + prices[:fits]
            if most is not None:
                total[most[:fits] <= 0] = 0.0
                for k, n in used.items():
                    if k < fits and n >= most[k]:
                        total[k] = 0.0
            best = total.max()
            if best <= 0:
                break
            k = int(np.flatnonzero(total >= best * (1 - 1e-12))[-1])
        out.append(k)
        used[k] += 1
        room -= int(lengths[k])
    return out


def solve(histogram: dict[int, int], capacity: int, gap: float = GAP) -> Cover:
    """Fractional cover of the whole histogram by configurations, at most the share `gap` above the dual bound.

    Multiplicative weights: a length's price falls by exp(-ETA) each time that it is covered once more. The pattern priced best,
    or within SLACK of it, is used until one of its lengths is covered once more. Since prices only fall, the last
    knapsack table bounds every pattern's price from above: patterns are traced in it with the prices of the moment, and the
    dynamic program runs anew when none is good enough. Prices divided by the best pattern's are a dual solution, whose
    value no cover beats; uses divided by the least coverage are a primal one. There is no other end than the gap between the two.
    """
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[int(n)] for n in lengths], dtype=float)
    start, covered = lengths / capacity, np.zeros(len(lengths))
    uses: Counter[tuple[int, ...]] = Counter()
    total, bound, dual = 0.0, 0.0, start
    while True:
        prices = start * np.exp(-ETA * (covered - covered.min()))
        value = best_values(prices, lengths, capacity)
        if (now := float(demand @ prices) / value[-1]) > bound:
            bound, dual = now, prices / value[-1]
        if (least := float(covered.min())) > 0 and total / least <= (1 + gap) * bound:
            return Cover({p: x / least for p, x in uses.items()}, total / least, bound, {int(n): float(y) for n, y in zip(lengths, dual, strict=True)})
        enough, dear, fresh = (1 - SLACK) * value[-1], CHEAP * value[-1] * start, True
        while True:
            pattern = trace(value, prices, lengths, demand)
            if prices[pattern].sum() < enough:
                if not fresh:
                    break
                pattern = trace(value, prices, lengths)
            fresh = False
            at, copies = np.unique(pattern, return_counts=True)
            steps = demand[at] / copies
            limits = prices[at] >= dear[at]
            step = float(steps[limits].min() if limits.any() else steps.max())
            covered[at] += step / steps
            prices[at] *= np.exp(-ETA * step / steps)
            uses[tuple(int(n) for n in lengths[pattern])] += step
            total += step


def round_cover(cover: Cover, left: dict[int, int], capacity: int, plan: Plan) -> None:
    """Adds patterns in whole numbers to plan and takes their lengths from left. First those of the cover: as often as the whole part of
    their use, then once more each while their lengths last. Then, longest length first, patterns that the dual prices say belong to
    a solution: those worth 1, but for TIGHT, traced among the lengths that are left."""
    by_fill = sorted(cover.uses.items(), key=lambda p: (-sum(p[0]), -(p[1] % 1), p[0]))
    for part in (int, lambda x: 1):
        for pattern, x in by_fill:
            copies = Counter(pattern)
            if (times := min(part(x), *(left[n] // k for n, k in copies.items()))) > 0:
                plan.add(pattern, times)
                for n, k in copies.items():
                    left[n] -= k * times
    lengths = np.array(sorted(left))
    amounts, prices = np.array([left[int(n)] for n in lengths]), np.array([cover.prices[int(n)] for n in lengths])
    value = best_values(prices, lengths, capacity)
    for first in range(len(lengths) - 1, -1, -1):
        while amounts[first] > 0:
            pattern = trace(value, prices, lengths, amounts, first)
            if prices[pattern].sum() < 1 - TIGHT:
                break
            at, copies = np.unique(pattern, return_counts=True)
            times = int((amounts[at] // copies).min())
            plan.add(tuple(int(n) for n in lengths[pattern]), times)
            amounts[at] -= copies * times
    left.update((int(n), int(k)) for n, k in zip(lengths, amounts, strict=True))


def best_fit(left: dict[int, int], capacity: int, plan: Plan) -> None:
    """Packs what is left, largest first; a sequence takes again and again the longest length that fits. A pattern is
    used at once as often as its lengths allow, so the work depends on the number of lengths, not of pieces."""
    lengths = np.array(sorted(n for n, k in left.items() if k > 0))
    counts = np.array([left[int(n)] for n in lengths])
    while len(lengths):
        room, uses = capacity, {}
        at = len(lengths) - 1
        while at >= 0:
            at = min(at, int(np.searchsorted(lengths, room, "right")) - 1)
            if at < 0:
                break
            take = min(room // int(lengths[at]), int(counts[at]))
            if not uses:
                take = max(1, take)
            if take:
                uses[at] = take
                room -= take * int(lengths[at])
            at -= 1
        times = min(int(counts[i]) // k for i, k in uses.items())
        plan.add(tuple(int(lengths[i]) for i, k in uses.items() for _ in range(k)), times)
        for i, k in uses.items():
            counts[i] -= k * times
        stays = counts > 0
        lengths, counts = lengths[stays], counts[stays]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Plan with a place for every piece of the histogram: the configuration program, rounded; best-fit packs what no pattern of the
    program takes. Full pieces have a sequence of their own in every solution, so they aren't part of the program."""
    left, plan = {n: k for n, k in histogram.items() if k > 0}, Plan()
    if full := left.pop(capacity, 0):
        plan.add((capacity,), full)
    if left:
        round_cover(solve(left, capacity), left, capacity, plan)
        best_fit(left, capacity, plan)
    return plan


def places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """The plan by length: (length, first rank, ranks, copies in the pattern, first sequence, offset of the first copy).
    Rank r of the range stands in sequence first + (r - first rank) // copies."""
    next_rank: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in zip(plan.patterns, plan.counts, strict=True):
        offset = 0
        for n in sorted(set(pattern), reverse=True):
            copies = pattern.count(n)
            start = next_rank.get(n, 0)
            out.append((n, start, copies * count, copies, sequence, offset))
            next_rank[n] = start + copies * count
            offset += copies * n
        sequence += count
    return out


class _Remembered(dict):
    """Values made once, CACHE of them at most."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordTokenizer:
    """Ids of whole texts. For this tokenizer words between white space are independent of each other, and so are their parts
    (letters, a digit, signs), so distinct words and parts are encoded once and remembered as their packed ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.parts = _Remembered(self.encode_word), _Remembered(self.encode_part)

    def encode_part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_BYTES)
        ids = [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:  # which may begin a special token
            return b"".join(map(self.parts.__getitem__, _PART.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.split() if not _SEPARATORS.search(text) else _BLANKS.split(text)
        return b"".join(map(self.words.__getitem__, words))


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenized_pieces(df: DataFrame, vocabulary: str, capacity: int, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; a null text counts as empty. Only documents
    longer than capacity are cut. with_ids adds each piece's packed ids."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        encode = _tokenizer(vocabulary).encode
        for batch in batches:
            who, piece, start, length, crc, packed = [], [], [], [], [], []
            for key, value in zip(batch["_id"], batch["_text"], strict=True):
                ids = encode(value or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    who.append(key)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        packed.append(part)
            out = {"doc_id": pd.Series(who, dtype=batch["_id"].dtype), "piece": piece, "start": start, "length": length, "ids_crc32": crc}
            yield pd.DataFrame(out | ({"ids": packed} if with_ids else {}))

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("_id"), df[text].alias("_text")).mapInPandas(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    )


def pack(df: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document gives at least one piece (an empty or null text: the end id alone). Repeated rows are packed each.
    Ties between pieces of a length are broken by doc_id, piece and checksum. Further columns aren't read. An empty
    df gives no rows. The driver gets the histogram only, at most `capacity` rows; the plan it sends back has at
    most a few rows for each length and pattern.
    """
    spark = df.sparkSession
    pieces = materialize(tokenized_pieces(df, vocabulary or tokenizer_file(VOCABULARY), capacity, id_column, text, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = places(make_plan(histogram, capacity))
    columns = ["length", "_first", "_ranks", "_copies", "_sequence", "_offset"]
    plan = spark.createDataFrame(pd.DataFrame(rows, columns=columns), ", ".join(f"{c} long" for c in columns))
    ranked = number_within(pieces, "length", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")
    r = F.col("_rank") - F.col("_first")
    return (
        ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_first")) & (r < F.col("_ranks")))
        .select(
            "doc_id", "piece", "start", ranked["length"], "ids_crc32",
            (F.col("_sequence") + F.floor(r / F.col("_copies"))).cast("long").alias("sequence_id"),
            (F.col("_offset") + (r % F.col("_copies")) * ranked["length"]).cast("long").alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

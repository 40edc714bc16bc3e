"""Best-fit packing of token pieces, certified by dual-feasible-function lower bounds."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: the pre-tokenisation pattern of the byte-level BPE vocabulary (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROOM = 1 << 17  # cached pieces a worker


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids as little-endian uint32 bytes, the same ids as the tokenizers library gives.

    A space before a character that isn't white space always begins a token, so a text is cut there
    and each part encoded once; the cache is emptied when it is full. Parts that aren't cached go
    through the same merges in tiktoken, several times as fast; texts that hold a special token's
    string go through tokenizers whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(r" (?:\s|$)")
        # the byte-level alphabet: printable bytes stand for themselves, the others for what follows 255
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        alphabet = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.encode = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    def part(self, word: str) -> bytes:
        """Ids of the word after a space."""
        if len(self.cache) >= ROOM:
            self.cache.clear()
        out = self.cache[word] = struct.pack(f"<{len(ids := self.encode(' ' + word))}I", *ids)
        return out

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split(" ")
        if self.odd.search(text):  # white space after a space, or a space at the end, stays with what stands before
            whole = [words[0]]
            for w in words[1:]:
                if w and not w[0].isspace():
                    whole.append(w)
                else:
                    whole[-1] += " " + w
            words = whole
        ids = self.encode(words[0])
        got, part = self.cache.get, self.part
        return struct.pack(f"<{len(ids)}I", *ids) + b"".join([got(w) or part(w) for w in words[1:]])


def _pieces(path: str, length: int, end: int) -> Callable:
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for i in range(b.num_rows):
                ids = encode(b.column(1)[i].as_py() or "") + tail
                n = len(ids) // 4
                first = n % length or length
                view = memoryview(ids)
                at, k = 0, 0
                while at < n:
                    size = first if k == 0 else length
                    rows.append((i, k, at, size, zlib.crc32(view[at * 4 : (at + size) * 4])))
                    at, k = at + size, k + 1
                if len(rows) >= 20000 or i == b.num_rows - 1:
                    cols = list(zip(*rows, strict=True))
                    yield pa.record_batch([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])
                    rows = []

    return run


def lower_bound(sizes: np.ndarray, room: int) -> int:
    """Fewest bins any packing of ``sizes`` needs."""
    return lower_bound_of(np.bincount(np.asarray(sizes, np.int64), minlength=room + 1), room)


def lower_bound_of(count: np.ndarray, room: int) -> int:
    """Fewest bins for so many items of each size from 0 to ``room``, by dual feasible functions.

    f_t sends sizes over room - t to room, those under t to 0 and keeps the rest; u_k rounds size
    to multiples of room / k. A dual feasible function keeps every feasible bin feasible, so the sum
    of its values over room bounds the bins from below.
    """
    values = np.arange(room + 1)
    if not count.any():
        return 0
    n, mass = np.cumsum(count), np.cumsum(count * values)
    t = np.arange(room // 2 + 1)
    below = np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    best = int(((n[-1] - n[room - t]) * room + mass[room - t] - below + room - 1).max() // room)
    for k in range(1, 21):
        up = (k + 1) * values
        u = np.where(up % room == 0, values * k, (up // room) * room)  # k * u_k(x)
        best = max(best, int(-(-int((count * u).sum()) // (k * room))))
    return best


def best_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the room left in each bin."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left: list[int] = []
    open_: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = open_[r].pop()
            if not open_[r]:
                mask &= ~(1 << r)
        else:
            r, b = room, len(left)
            left.append(room)
        bins[i], offsets[i] = b, room - r
        left[b] = r - s
        if r > s:
            open_[r - s].append(b)
            mask |= 1 << (r - s)
    return bins, offsets, np.array(left, np.int64)


def _pack(room: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        sizes = pdf["length"].to_numpy()
        bins, offsets, left = best_fit_decreasing(sizes, room)
        gap = len(left) - lower_bound(sizes, room)
        # what a certified partition still exchanges: its emptiest bin
        return pdf.assign(bin=bins, offset=offsets, open=(left[bins] > 0) & ((gap > 0) | (bins == left.argmax())))

    return run


def token_pieces(docs: DataFrame, length: int = 1024, end: int = 2, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token pieces of each whole text, at most ``length`` tokens each."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(_pieces(path or tokenizer_path(), length, end), schema)


def pack(docs: DataFrame, length: int = 1024, end: int = 2, path: str | None = None, group: int = 8192, rounds: int = 8) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all pieces in few sequences of at most ``length``.

    A document is its token ids and then ``end``; longer ones are cut into pieces of ``length``
    tokens, of which the first may be shorter. Partitions of about ``group`` pieces are packed
    best-fit decreasing; a partition whose bins equal its lower bound is certified and stays but for
    its emptiest bin. In the others, all bins with room are open. Pieces of open bins are exchanged
    between partitions and packed again, until none is left, one partition holds them all or
    ``rounds`` are over; each round has fewer pieces.

    Partitions are dealt by a row number, so no doc_id is hot, however often it stands. A null or
    empty text is the one token ``end``; an empty table gives no rows; equal rows are packed like any
    others. Other columns are not read.
    """
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = materialize(token_pieces(docs, length, end, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = whole.filter(F.col("length") == length).select(*keys, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = whole.filter(F.col("length") < length).select("row", "length")
    placed: DataFrame | None = None
    for turn in range(rounds):
        n = rest.count()
        if not n:
            break
        groups = -(-n // group)
        schema = "row bigint, length bigint, g bigint, bin bigint, offset bigint, open boolean"
        dealt = rest.select("row", "length", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)).alias("g"))
        packed = materialize(dealt.groupBy("g").applyInPandas(_pack(length), schema), "packed")
        last = groups == 1 or turn == rounds - 1
        again = F.col("open") & F.lit(not last)
        seq = F.lit(turn).cast("long") * (1 << 57) + F.col("g") * (1 << 24) + F.col("bin")
        settled = packed.filter(~again).select("row", seq.alias("sequence_id"), "offset")
        placed = settled if placed is None else placed.unionByName(settled)
        if last:
            break
        rest = packed.filter(again).select("row", "length")
    if placed is None:
        return full
    return full.unionByName(whole.filter(F.col("length") < length).join(placed, "row").select(*keys, "sequence_id", "offset"))


def certificate(packed: DataFrame, length: int = 1024) -> DataFrame:
    """(sequences, least): how many sequences a packing has and a lower bound for any, from the numbers of pieces of each length."""
    count = np.zeros(length + 1, np.int64)
    for size, n in packed.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most ``length`` rows
        count[size] = n
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).withColumn("least", F.lit(lower_bound_of(count, length)).cast("long"))

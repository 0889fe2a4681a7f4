"""Best-fit packing by minimum bin slack: each bin takes the fullest feasible combination of the lengths still there.

Only the number of items of each length matters for the combinations, so the plan is made from a histogram of at most
``capacity`` lengths, and a combination is taken as often as its lengths allow. Items then find their place in the plan by
their rank among the items of their length.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import cut, slots
from tessera.llm.words import chunks

#: Texts on which the two ways to tokenise are compared: contractions, numbers, marks, spaces, controls, scripts, joined signs.
PROBES = [
    "A probe: it's 12 words,  with  spaces\n\nand líneas 中.",
    "we'll they've I'D don't 's 'll  'tis \t\ttabs \r\n ends  ",
    "3.14159 1,000,000 2024-01-02T03:04:05Z ½ ² ٣٤ x1y2",
    "!!! ??? ... --- *** <b>&amp;</b> {[()]} a_b a-b a/b https://example.com/?q=1#x",
    "\u00a0nbsp\u2003em\u200bzero\u0000nul\x1funit\x7f\u0085next\u2028line",
    "naïve façade Ærø Straße ŁÓDŹ ΑΒΓ привет שלום مرحبا नमस्ते ไทย 日本語 한국어",
    "😀👩‍👩‍👧 e\u0301 \ufeffbom \U0001d54f",
    "",
    " ",
    "a" * 300 + " " * 70 + "ab" * 150,
]


class ByteBpe:
    """Token ids of a byte-level BPE vocabulary file of the ``tokenizers`` library, the same as its own but several times faster.

    The file's vocabulary is handed to ``tiktoken`` as ranks; a probe at the start compares both. Texts in which the
    vocabulary's special tokens occur go to the library itself, as it gives those an id of their own.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.library = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        table = _bytes_of_characters()
        ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.specials}
        # The pattern of byte-level pre-tokenisers: a fixed value.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.core = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        if any(self.core.encode_ordinary(p) != self.library.encode(p, add_special_tokens=False).ids for p in PROBES):
            raise ValueError(f"{path} is not a byte-level BPE vocabulary of the known kind")

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.core.encode_ordinary(text), np.uint32)


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Return ``id, piece, start, length, ids_crc32`` (and ``ids``): the pieces of each document, none longer than ``capacity``.

    A document is the ids of its whole text, then ``end``. One that is longer than ``capacity`` is cut into pieces of that
    length, of which the first may be shorter. A null text counts as empty, so each row has at least one piece. Other
    columns are ignored; repeated rows and null ids are kept. ``tokenizer`` is a vocabulary file that all executors have.
    """
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes):
                keys, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for d, text in enumerate(texts):
                    own = np.append(bpe.encode(text.as_py() or ""), np.uint32(end))
                    begin, until = 0, len(own) % capacity or capacity
                    for k in range(-(-len(own) // capacity)):
                        part = own[begin:until]
                        doc.append(d)
                        piece.append(k)
                        start.append(begin)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int64))
                        begin, until = until, until + capacity
                columns = [keys.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    found = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(cut_up, schema)
    return found.withColumnRenamed("id", id)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, number) of a combination with the largest sum up to ``capacity`` that has the longest item in it.

    Reachable sums are the bits of an integer, one integer for each prefix of the lengths in ascending order; walking back
    from the best sum takes as many of the longer items as possible.
    """
    longest = max(counts)
    room = capacity - longest
    lengths = sorted(n for n in counts if n <= room)
    mask = (1 << room + 1) - 1
    reach = [1]
    for n in lengths:
        now, left, step = reach[-1], min(counts[n] - (n == longest), room // n), 1
        while left > 0:
            take = min(step, left)
            now |= now << take * n & mask
            left, step = left - take, 2 * step
        reach.append(now)
    rest = reach[-1].bit_length() - 1
    taken = {longest: 1}
    for i in range(len(lengths), 0, -1):
        n, before = lengths[i - 1], reach[i - 1]
        most = min(counts[n] - (n == longest), rest // n)
        k = next(k for k in range(most, -1, -1) if before >> rest - k * n & 1)
        if k:
            taken[n] = taken.get(n, 0) + k
            rest -= k * n
    return sorted(taken.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations and how often each is taken, until no item is left."""
    counts = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    found = []
    while counts:
        taken = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in taken)
        found.append((taken, times))
        for n, k in taken:
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return found


def pack(items: DataFrame, order: list[str], length: str = "length", capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to each row of ``items``, whose ``length`` is from 1 to ``capacity``.

    Rows of one sequence fill it from 0 without gaps. All columns are kept; they must not be named ``sequence_id`` or
    ``offset``. Rows that agree on ``order`` may change places. ``items`` should be cheap to read or cut. An empty table
    gives an empty one. The driver holds one number for each length; no group of equal lengths meets in one task.
    """
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}
    blocks: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    used = dict.fromkeys(counts, 0)
    sequence = 0
    for taken, times in plan(counts, capacity):
        at = 0
        for n, k in taken:
            blocks[n].append((used[n], k, sequence, at))
            used[n] += k * times
            at += n * k
        sequence += times
    tables = {n: np.array(b, np.int64).T for n, b in blocks.items()}
    shared = items.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("sequence long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        lengths, ranks = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
        for n in np.unique(lengths):
            mine = lengths == n
            begin, number, base, at = shared.value[int(n)]
            block = np.searchsorted(begin, ranks[mine], "right") - 1
            within = ranks[mine] - begin[block]
            sequence[mine] = base[block] + within // number[block]
            offset[mine] = at[block] + within % number[block] * n
        return pd.DataFrame({"sequence": sequence, "offset": offset})

    ranked = slots(items, [length], order, "__rank").withColumn("__place", place(F.col(length), F.col("__rank")))
    return ranked.withColumns({"sequence_id": F.col("__place.sequence"), "offset": F.col("__place.offset")}).drop("__rank", "__place")


def pack_documents(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = 2, capacity: int = 1024) -> DataFrame:
    """:func:`pieces` of all documents, packed: ``id, piece, start, length, ids_crc32, sequence_id, offset``."""
    found = cut(pieces(df, tokenizer, id, text, end, capacity))
    return pack(found, [id, "piece", "start", "ids_crc32"], capacity=capacity).select(id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

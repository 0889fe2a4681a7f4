"""Benchmark decontamination: an FM-index of each shard of documents is searched for the benchmark's phrases.

The symbols of the index are words. Occurrences are located by sampled suffix positions and merged into spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.frames import cut, once, quoted
from tessera.llm.fm_index import FmIndex

#: Bytes of benchmark text whose phrases are broadcast and searched at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 4 << 20
#: Text of a shard.
SHARD_BYTES = 1 << 20
#: Windows of a piece of a long item.
PIECE_WINDOWS = 20_000


def _item_pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, words): items in pieces of a bounded number of words that share all but one word of a window."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, rows = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, offsets = W.buffers(pa.array([value.as_py()], pa.string()))
                found = W.find(data, offsets, W.NON_ALNUM, lower=True)
                own = [found.text(i) for i in range(len(found))]
                for begin in range(0, max(1, len(own) - window + 1) if own else 0, PIECE_WINDOWS):
                    items.append(key)
                    rows.append(b" ".join(own[begin : begin + PIECE_WINDOWS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(rows, pa.binary())], ["item", "words"])

    return benchmark.select(quoted(item).cast("string"), quoted(text)).mapInArrow(cut_up, "item string, words binary")


class Phrases:
    """The distinct windows of some items, and the items of each (as places in ``items``), in about 21 bytes for each word.

    Window p is the ``lengths[p]`` words from ``begin[p]`` on in ``words``, the hashes of all items' words.
    """

    def __init__(self, rows: list[tuple[str | None, bytes]], window: int):
        table: dict[bytes, set[int]] = {}
        names: dict[str | None, int] = {}
        words, begin, lengths, place = [], [], [], 0
        for name, text in rows:
            data, offsets = W.buffers(pa.array([text.decode()], pa.string()))
            h = W.hashes(W.find(data, offsets, W.NON_ALNUM))
            k = names.setdefault(name, len(names))
            width = min(window, len(h))
            for i in range(len(h) - width + 1):
                key = h[i : i + width].tobytes()
                if key not in table:
                    begin.append(place + i)
                    lengths.append(width)
                table.setdefault(key, set()).add(k)
            words.append(h)
            place += len(h)
        self.window, self.items = window, list(names)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.begin, self.lengths = np.array(begin, np.int32), np.array(lengths, np.uint8 if window < 256 else np.int32)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in table.values()])]).astype(np.int32)
        self.item_of = np.array([k for x in table.values() for k in sorted(x)], np.int32)

    def symbols(self, known: np.ndarray):
        """(windows, their places in ``known``, right-aligned) of those windows all of whose words are in ``known``, some at a time."""
        if not len(known):
            return
        at = np.searchsorted(known, self.words)
        there = known[np.minimum(at, len(known) - 1)] == self.words
        absent = np.concatenate([[0], np.cumsum(~there)])
        begin, lengths = self.begin.astype(np.int64), self.lengths.astype(np.int64)
        whole = np.flatnonzero(absent[begin + lengths] == absent[begin])
        back = np.arange(self.window) - self.window
        for a in range(0, len(whole), PIECE_WINDOWS):
            mine = whole[a : a + PIECE_WINDOWS]
            rows = (begin + lengths)[mine, None] + back
            inside = back >= -lengths[mine, None]
            yield mine, np.where(inside, at[np.where(inside, rows, 0)], -1)


def phrase_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The benchmark's phrases in broadcasts, each made of at most about ``block_bytes`` of text, whatever the benchmark's size.

    The driver holds one block at a time; the items are read and cut up once.
    """
    spark = benchmark.sparkSession
    rows = _item_pieces(benchmark, item, text, window)
    total = rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    if blocks > 1:
        rows = cut(rows.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int")).repartition("block"), by="block")
    found = []
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.col("block") == b)
        found.append(spark.sparkContext.broadcast(Phrases([(r["item"], bytes(r["words"])) for r in part.collect()], window)))
    return found


def hits(data: np.ndarray, offsets: np.ndarray, blocks: list[Broadcast]) -> tuple[W.Words, np.ndarray, list[set[str]]]:
    """For a shard of texts: its words, which of them are hit, and each text's items."""
    found = W.find(data, offsets, W.NON_ALNUM, lower=True)
    n, docs = len(found), len(offsets) - 1
    items: list[set[str]] = [set() for _ in range(docs)]
    known, ids = np.unique(W.hashes(found), return_inverse=True)
    # Each text ends in a symbol of its own kind, 0, so that no phrase spans two.
    ends = found.first[1:] + np.arange(docs)
    symbols = np.zeros(n + docs, np.int64)
    place = np.arange(n) + found.doc_of()
    symbols[place] = ids + 1
    index = FmIndex(symbols, len(known) + 1)
    cover = np.zeros(n + docs + 1, np.int64)
    for block in blocks:
        phrases: Phrases = block.value
        for windows, wanted in phrases.symbols(known):
            lengths = phrases.lengths[windows].astype(np.int64)
            low, high = index.search(np.where(wanted >= 0, wanted + 1, -1), lengths)
            counts = high - low
            phrase = np.repeat(np.arange(len(counts)), counts)
            rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            places = index.locate(rows)
            np.add.at(cover, places, 1)
            np.add.at(cover, places + lengths[phrase], -1)
            doc = np.searchsorted(ends, places)
            for pair in np.unique(doc * len(counts) + phrase).tolist():
                d, p = divmod(pair, len(counts))
                k = windows[p]
                items[d].update(phrases.items[x] for x in phrases.item_of[phrases.first[k] : phrases.first[k + 1]])
    hit = np.cumsum(cover)[:-1] > 0
    return found, hit[place], items


def scan(df: DataFrame, blocks: list[Broadcast], id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Return ``id, n_words, spans, items`` for each row; with ``keep`` all columns of ``df``, these, and the ``kept`` text without the spans.

    ``spans`` are the merged runs of hit words, ``[start, end)`` in words; ``items`` the item ids, as sorted strings, of
    which a window occurs. Words are compared by 64-bit hashes after A-Z became a-z. Null texts have no words; a null item
    id's windows hit but name no item. Repeated rows stay, other columns are ignored, empty tables give empty results.
    ``kept`` is the text itself where nothing is hit; elsewhere the bytes from the start of a span's first word to the end
    of its last are left out. There is no shuffle; a worker holds one shard of about a MB,
    or one longer text, and the benchmark at about 21 bytes for each of its words.
    """
    found_type = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>,kept:string>"
    arrow_span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    arrow_type = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(arrow_span)), ("items", pa.list_(pa.string())), ("kept", pa.string())])

    def shard(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        found, hit, items = hits(data, offsets, blocks)
        step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
        # A run that goes on into the next document is cut there.
        cuts = found.first[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(hit))]
        both = cuts[hit[cuts] & hit[cuts - 1]] if len(hit) else cuts
        starts, ends = np.unique(np.concatenate([starts, both])), np.unique(np.concatenate([ends, both]))
        first = np.searchsorted(starts, found.first)
        spans, kept = [], []
        for d in range(len(offsets) - 1):
            mine = range(first[d], first[d + 1])
            spans.append([{"start": int(starts[i] - found.first[d]), "end": int(ends[i] - found.first[d])} for i in mine])
            if not keep or not mine:
                kept.append(texts[d].as_py() if keep else None)
                continue
            low, parts = offsets[d], []
            for i in mine:
                parts.append(data[low : found.starts[starts[i]]].tobytes())
                low = found.ends[ends[i] - 1]
            kept.append(b"".join([*parts, data[low : offsets[d + 1]].tobytes()]).decode())
        names = [sorted(x for x in own if x is not None) for own in items]
        columns = [pa.array(found.counts, pa.int64()), pa.array(spans, pa.list_(arrow_span)), pa.array(names, pa.list_(pa.string())), pa.array(kept, pa.string())]
        return pa.StructArray.from_arrays(columns, fields=list(arrow_type))

    @F.arrow_udf(found_type)
    def scanned(texts: pa.Array) -> pa.Array:
        data, offsets = W.buffers(texts)
        out = [shard(texts.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in W.chunks(np.diff(offsets), SHARD_BYTES)]
        return pa.concat_arrays(out) if out else pa.array([], arrow_type)

    names = ["n_words", "spans", "items", *["kept"] * keep]
    own = [quoted(c) for c in (df.columns if keep else [id]) if c not in names]
    return df.select(*own, once(scanned)(quoted(text)).alias("__found")).select(*own, *[F.col(f"__found.{c}") for c in names])


def judged(found: DataFrame) -> DataFrame:
    """Add ``n_hit`` and ``contaminated`` (n_hit > 0 and 20 * n_hit >= n_words) to :func:`scan`'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))

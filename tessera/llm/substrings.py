"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash of its runs of ``run`` words;
consecutive windows with the same minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket, where
sorting brings equal windows together. Only minimisers that two documents share travel at all: a window without one is in
one document alone. The bucket of a minimiser that very many documents share is divided by minimisers under other hash
functions, and of equal strings in it only the earliest document's is sorted: the windows of all others stand in that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.frames import cut, marked, once, partitions, possible, quoted

#: Documents that share a minimiser beyond which further minimisers divide its bucket and equal strings become one.
HOT = 5_000
#: Those further minimisers.
MORE = 2
#: Words sorted at once in a bucket task.
SORTED_WORDS = 600_000
NO_ID = (1 << 63) - 1


def minimisers(words: W.Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, minimiser) of each longest run of windows of one document that share their minimiser; windows by first word."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _least(W.runs(W.hashes(words), run), window - run + 1)
    valid = np.zeros(n + 1, np.int32)
    whole = words.counts >= window
    np.add.at(valid, words.first[:-1][whole], 1)
    np.add.at(valid, words.first[1:][whole] - window + 1, -1)
    valid = np.cumsum(valid)[:n] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    return first, np.flatnonzero(stop), low[first]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def divided(words: W.Words, first: np.ndarray, last: np.ndarray, low: np.ndarray, window: int, run: int) -> tuple[np.ndarray, ...]:
    """(string, first, last, key) of the parts of some super-k-mers whose windows share further minimisers, too."""
    key = np.full(len(words) - window + 1, 0, np.uint64)
    h = W.runs(W.hashes(words), run)
    for k in range(MORE):
        key = W.mix(key + _least(W.mix(h + np.uint64(k + 1)), window - run + 1))
    spans = last - first + 1
    string = np.repeat(np.arange(len(first)), spans)
    windows = np.repeat(first - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
    key = W.mix(key[windows] + low[string])
    new = np.concatenate([[True], (string[1:] != string[:-1]) | (key[1:] != key[:-1])])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(windows)]]) - 1
    return string[begin], windows[begin], windows[end], key[begin]


def _chunks_of(batches: Iterator[pa.RecordBatch], text: int):
    """(batch rows a to b, their words) of whole texts, a few MB at a time."""
    for batch in batches:
        data, offsets = W.buffers(batch.column(text))
        for a, b in W.chunks(np.diff(offsets)):
            yield batch.slice(a, b - a), W.find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.SPACES)


def _slim(window: int, run: int):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _chunks_of(batches, 2):
            first, _, low = minimisers(words, window, run)
            doc = np.searchsorted(words.first, first, "right") - 1
            pair = np.stack([doc.astype(np.uint64), low])
            pair = np.unique(pair, axis=1) if pair.shape[1] else pair
            doc = pa.array(pair[0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(pair[1].view(np.int64))], ["doc", "tie", "low"])

    return mapped


def _supers(window: int, run: int):
    """Rows for the buckets: ``bucket, hot, one, two, doc, tie, start, span, packed``; only hot ones have a digest (one, two)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _chunks_of(batches, 2):
            first, last, low = minimisers(words, window, run)
            doc = np.searchsorted(words.first, first, "right") - 1
            shared = batch.column(3)
            lists = pc.list_value_length(shared).to_numpy(zero_copy_only=False)
            flat = shared.flatten()
            values = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            hot = flat.field(1).to_numpy(zero_copy_only=False).astype(bool)
            # Both sides as (document, minimiser), so that one search answers for all documents.
            kind = np.dtype([("doc", np.int64), ("low", np.uint64)])
            known, asked = np.empty(len(values), kind), np.empty(len(low), kind)
            known["doc"], known["low"] = np.repeat(np.arange(len(lists)), lists), values
            asked["doc"], asked["low"] = doc, low
            order = np.argsort(known, order=("doc", "low"))
            known, hot = known[order], hot[order]
            at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
            there = known[at] == asked if len(known) else np.zeros(len(asked), bool)
            is_hot = there & hot[at] if len(known) else there
            docs, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()

            def rows(first: np.ndarray, last: np.ndarray, bucket: np.ndarray, doc: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
                for a in range(0, len(first), 4000):
                    f, l, d = first[a : a + 4000], last[a : a + 4000], doc[a : a + 4000]
                    packed = [words.data[words.starts[i] : words.ends[j + window - 1]].tobytes() for i, j in zip(f, l, strict=True)]
                    digest = np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in packed) if hot else bytes(16 * len(f)), np.int64).reshape(-1, 2)
                    columns = [bucket[a : a + 4000].view(np.int64), np.full(len(f), hot), digest[:, 0], digest[:, 1], docs[d], ties[d], f - words.first[d], l - f + 1]
                    yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(packed, pa.binary())], "bucket hot one two doc tie start span packed".split())

            own = there & ~is_hot
            yield from rows(first[own], last[own], low[own], doc[own], False)
            if is_hot.any():
                string, f, l, key = divided(words, first[is_hot], last[is_hot], low[is_hot], window, run)
                yield from rows(f, l, key, doc[is_hot][string], True)

    return mapped


def later_windows(packed: pa.Array, docs: np.ndarray, window: int) -> np.ndarray:
    """Rows (row, first, last): runs of windows of each packed string that also stand in one of a smaller document."""
    data, offsets = W.buffers(packed.cast(pa.large_binary()).cast(pa.large_string()))
    words = W.find(data, offsets, W.SPACES)
    row = words.doc_of()
    n = len(words) - window + 1
    starts = np.flatnonzero(row[:n] == row[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
    key = W.runs(W.hashes(words), window)[starts] if len(starts) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    starts, key = starts[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    codes = words.strings().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    # Equal hashes are confirmed word by word; where one deceives, its windows are told apart by their words.
    lead = starts[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(key) else starts
    same = np.ones(len(starts), bool)
    for j in range(window):
        same &= codes[starts + j] == codes[lead + j]
    if not same.all():
        group = np.cumsum(new)
        for g in np.unique(group[~same]):
            own = np.flatnonzero(group == g)
            by = np.lexsort(np.stack([codes[starts[own] + j] for j in range(window)]))
            starts[own] = starts[own[by]]
            rows = np.stack([codes[starts[own] + j] for j in range(window)])
            new[own] = np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)])
    flagged = np.zeros(max(0, n), bool)
    if len(starts):
        begin = np.flatnonzero(new)
        owner = docs[row[starts]]
        least = np.minimum.reduceat(owner, begin)[np.cumsum(new) - 1]
        flagged[starts[owner > least]] = True
    before = np.concatenate([[False], flagged[:-1]]) if n > 0 else flagged
    after = np.concatenate([flagged[1:], [False]]) if n > 0 else flagged
    edge = np.zeros(max(0, n), bool)
    if n > 1:
        edge[1:] = row[1:n] != row[: n - 1]
    first = np.flatnonzero(flagged & (~before | edge))
    last = np.flatnonzero(flagged & (~after | np.concatenate([edge[1:], [True]])))
    return np.stack([row[first], first - words.first[row[first]], last - words.first[row[first]]], 1) if len(first) else np.zeros((0, 3), np.int64)


def _sorted_buckets(window: int, names: list[str]):
    """From rows (bucket, doc, packed, names) in the order of ``bucket``: names, and ranges of windows [from, to] that an earlier document has."""

    def answer(table: pa.Table) -> pa.RecordBatch:
        found = later_windows(table.column("packed").combine_chunks(), table.column("doc").to_numpy(), window)
        at = pa.array(found[:, 0])
        columns = [*[table.column(n).take(at) for n in names], pa.array(found[:, 1]), pa.array(found[:, 2])]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [*names, "from", "to"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.slice(a, 2000)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("packed"))).as_py() or 0
                if size < 6 * SORTED_WORDS:
                    continue
                table = pa.Table.from_batches(held)
                bucket = table.column("bucket").to_numpy()
                whole = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
                if whole:
                    yield answer(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                size = sum(pc.sum(pc.binary_length(x.column("packed"))).as_py() or 0 for x in held)
        if held:
            yield answer(pa.Table.from_batches(held))

    return mapped


def deduplicate(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, run: int = 8, hot: int = HOT) -> DataFrame:
    """Return all columns of ``df`` and a struct ``dedup`` of ``n_words, n_removed, kept`` (the kept words, joined by one space).

    A word goes if a window over it also starts in a row with a smaller ``id``; windows are judged on the input. Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none. Rows with the same id are one document's: they take nothing
    from each other. A null id is larger than all others. An empty table gives an empty result. ``df`` may have columns of
    any names but ``dedup`` (replaced).

    Texts that equal one with a smaller id need no windows: all goes if there is any window. Documents without a shared
    minimiser are never shuffled with their texts. Of a minimiser that more than ``hot`` documents share see the module.
    """
    spark = df.sparkSession
    key = [F.coalesce(quoted(id).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(quoted(text)).alias("tie")]
    value = F.coalesce(quoted(text), F.lit("")).alias("text")
    rows = df.select(*key, value)
    slim = cut(rows.mapInArrow(_slim(window, run), "doc long, tie long, low long"))
    shared = slim.groupBy("low").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = shared.select("low", (F.col("n") > hot).alias("hot"))

    digest = df.where(F.length(quoted(text)) >= 2 * window - 1).select(*key, F.md5(quoted(text)).alias("md5"))
    earliest = digest.groupBy("md5").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("md5", "lo")
    copies = cut(digest.join(earliest, "md5").where("lo < doc").select("doc", "tie").distinct())

    lists = slim.join(shared, "low").join(copies, ["doc", "tie"], "left_anti")
    lists = cut(lists.groupBy("doc", "tie").agg(F.collect_list(F.struct("low", "hot")).alias("shared")))
    schema = "bucket long, hot boolean, one long, two long, doc long, tie long, start long, span long, packed binary"
    supers = possible(rows, lists, "doc").join(lists, ["doc", "tie"]).select("doc", "tie", "text", "shared").mapInArrow(_supers(window, run), schema)
    any_hot = bool(lists.where(F.exists("shared", lambda x: x["hot"])).head(1))
    if any_hot:
        supers = cut(supers)

    def flagged(rows: DataFrame, names: list[str]) -> DataFrame:
        in_buckets = rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
        return in_buckets.mapInArrow(_sorted_buckets(window, names), ", ".join(f"`{n}` long" for n in [*names, "from", "to"]))

    first = flagged(supers.where("not hot").select("bucket", "doc", "tie", "start", "packed"), ["doc", "tie", "start"])
    ranges = first.select("doc", "tie", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to") + window).alias("to"))
    if any_hot:
        same = ["bucket", "one", "two"]
        crowd = supers.where("hot")
        strings = cut(crowd.groupBy(*same).agg(F.min("doc").alias("doc"), F.any_value("packed").alias("packed")))
        own = flagged(strings, same)
        members = crowd.drop("packed").join(strings.select(*same, F.col("doc").alias("lo")), same)
        later = members.where("lo < doc").select("doc", "tie", F.col("start").alias("from"), (F.col("start") + F.col("span") - 1 + window).alias("to"))
        earliest_too = members.where("lo = doc").join(own, same).select("doc", "tie", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to") + window).alias("to"))
        ranges = ranges.unionByName(later).unionByName(earliest_too)
    whole_text = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.lit(-1).cast("long").alias("to")))
    ranges = cut(ranges.groupBy("doc", "tie").agg(F.collect_list(F.struct("from", "to")).alias("ranges")).unionByName(copies.withColumn("ranges", whole_text)))
    whole = df.select(F.struct(*[quoted(c) for c in df.columns if c != "dedup"]).alias("row"), *key)
    whole = marked(whole, ranges, "doc", "touched")
    # Only documents that lose words meet their ranges in a shuffle; the others stay where they are.
    joined = whole.where("touched").join(ranges, ["doc", "tie"], "left").select("row", "ranges")
    alone = whole.where("not touched").select("row", F.lit(None).cast("array<struct<from:long,to:long>>").alias("ranges"))
    found = joined.unionByName(alone).withColumn("dedup", _removed(F.col(f"row.`{text.replace('`', '``')}`"), F.col("ranges"), window))
    return found.select("row.*", "dedup")


def _removed(text: Column, ranges: Column, window: int) -> Column:
    """``ranges`` are [from, to) in words; to = -1 stands for all words of a text that has a window."""

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept:string>")
    def removed(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        n_words, n_removed, kept = [], [], []
        data, offsets = W.buffers(texts)
        lists = pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False)
        flat = ranges.flatten()
        begin, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        at = np.concatenate([[0], np.cumsum(lists)]).astype(np.int64)
        for a, b in W.chunks(np.diff(offsets)):
            words = W.find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.SPACES)
            of = np.repeat(np.arange(b - a), lists[a:b])
            own, until = begin[at[a] : at[b]], end[at[a] : at[b]]
            counts = words.counts
            until = np.where(until < 0, np.where(counts[of] >= window, counts[of], 0), until)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, words.first[of] + own, 1)
            np.add.at(cover, words.first[of] + until, -1)
            stays = np.cumsum(cover)[:-1] == 0
            # The kept words and a space after each but a document's last, taken from the buffer in one go.
            lengths = (words.ends - words.starts)[stays]
            doc = words.doc_of()[stays]
            sizes = lengths + 1
            if len(doc):
                sizes[np.concatenate([doc[1:] != doc[:-1], [True]])] -= 1
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out = np.full(total, 0x20, np.uint8)
            take = np.repeat(words.starts[stays] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            put = np.repeat(ends - sizes - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            out[put] = words.data[take]
            per_doc = np.bincount(doc, sizes, b - a).astype(np.int64) if len(doc) else np.zeros(b - a, np.int64)
            places = np.concatenate([[0], np.cumsum(per_doc)])
            kept.append(pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(out)).cast(pa.string()))
            n_words.append(counts)
            n_removed.append(counts - (np.bincount(doc, minlength=b - a) if len(doc) else 0))
        numbers = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in (n_words, n_removed)]
        return pa.StructArray.from_arrays([*numbers, pa.concat_arrays(kept) if kept else pa.array([], pa.string())], ["n_words", "n_removed", "kept"])

    return once(removed)(text, ranges)

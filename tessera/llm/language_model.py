"""Scores of texts under a trigram model that is learned from the corpus and never gathered in one place.

Documents are dealt into units. Each unit sends the trie of its words, word pairs and triples, with their training counts,
to the model's shards, cut by context; a shard merges what it gets into an Elias-Fano trie, looks up what was asked, and
sends codes back in the order of the question. Units then score their documents. Words travel as hashes, packed.

With c for training counts, f(v) = c(v) the followers of a word, and n(u, v) distinct followers of a pair,

    P(w)       = (c(w) + 0.1) / (N + 0.1 * (V + 1))
    P(w | v)   = (c(v, w) + MU * P(w)) / (f(v) + MU)
    P(w | u v) = max(c(u, v, w) - D, 0) / c(u, v) + D * n(u, v) / c(u, v) * P(w | v)

where the last is P(w | v) if the pair never occurred. The trie holds c(v, w) / f(v), the first term of P(w | u v) and the
weight D * n / c, each quantised to a byte and rounded down, so that no context gives out more than one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.elias_fano import Codebook, Trie
from tessera.llm.frames import partitions, quoted

#: Text of a unit and of a shard, about, and of the parts in which it travels.
UNIT_BYTES, PART_BYTES = 8 << 20, 128 << 10
MU, D = 64.0, 0.75
#: Hashes that stand for the start and the end of a text (fixed values).
START, END = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)
#: Bits of a context, of a pair's second word below it, of a triple's third word below its pair.
CONTEXT_BITS, PAIR_BITS, TRIPLE_BITS = 48, 32, 24
#: Sections of a question and of an answer.
ASKED, ANSWERED = 9, 5


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)



def classes(shards: int) -> int:
    """Into how many contexts a word's pairs are dealt, by the second word: a word that is a 16th of the text fills no shard."""
    return max(8, 1 << max(0, shards // 16 - 1).bit_length())


def shard_of(hashes: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Ranges of hashes: ascending hashes have ascending shards."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Unit:
    """A unit's distinct words, pairs and triples, ascending by hash and so by shard; triples stand below their pairs."""

    def __init__(self, texts: pa.Array, train: np.ndarray, shards: int):
        data, offsets = W.buffers(texts)
        self.docs = len(train)
        hashes = []
        counts = np.zeros(self.docs, np.int64)
        for a, b in W.chunks(np.diff(offsets)):
            words = W.find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.SPACES, lower=True)
            hashes.append(W.hashes(words))
            counts[a:b] = words.counts
        self.lengths = counts + 1
        ends = np.cumsum(self.lengths) - 1
        total = int(ends[-1]) + 1 if self.docs else 0
        tokens = np.full(total, END)
        inside = np.ones(total, bool)
        inside[ends] = False
        tokens[inside] = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.starts = ends - self.lengths + 1
        before = np.concatenate([[START], tokens[:-1]])
        before[self.starts] = START
        learned = np.repeat(train, self.lengths)
        cuts = np.arange(shards + 1)

        self.words, self.token = np.unique(tokens, return_inverse=True)
        self.word_cuts = np.searchsorted(shard_of(self.words, 64, shards), cuts)
        self.word_counts = np.bincount(self.token[learned], minlength=len(self.words))
        #: The end's count is the number of texts, and so the start's.
        self.context = np.concatenate([[0], self.token[:-1]]) if total else self.token
        end = np.flatnonzero(self.words == END)
        self.context[self.starts] = end[0] if len(end) else 0

        # A word's pairs are dealt over contexts by the second word.
        mixed = W.mix(tokens + np.uint64(1))
        root = W.mix(before * np.uint64(0x9E3779B97F4A7C15) + mixed % np.uint64(classes(shards))) >> np.uint64(64 - CONTEXT_BITS)
        self.contexts, of = np.unique(root, return_inverse=True)
        pairs, self.pair = np.unique((of.astype(np.uint64) << np.uint64(PAIR_BITS)) | (mixed >> np.uint64(64 - PAIR_BITS)), return_inverse=True)
        self.successors = (pairs & np.uint64((1 << PAIR_BITS) - 1)).astype(np.uint32)
        self.owner = (pairs >> np.uint64(PAIR_BITS)).astype(np.int64)
        self.runs = np.bincount(self.owner, minlength=len(self.contexts))
        self.pair_counts = np.bincount(self.pair[learned], minlength=len(pairs))
        self.context_cuts = np.searchsorted(shard_of(self.contexts, CONTEXT_BITS, shards), cuts)
        self.pair_cuts = np.searchsorted(self.owner, self.context_cuts)

        # From a text's second token on, below the pair that ends one token earlier.
        third = np.ones(total, bool)
        third[self.starts] = False
        self.third = np.flatnonzero(third)
        below = self.pair[self.third - 1].astype(np.uint64)
        triples, self.triple = np.unique((below << np.uint64(TRIPLE_BITS)) | (mixed[self.third] >> np.uint64(40) & np.uint64((1 << TRIPLE_BITS) - 1)), return_inverse=True)
        self.thirds = (triples & np.uint64((1 << TRIPLE_BITS) - 1)).astype(np.uint32)
        parent = (triples >> np.uint64(TRIPLE_BITS)).astype(np.int64)
        self.children = np.bincount(parent, minlength=len(pairs))
        self.triple_counts = np.bincount(self.triple[learned[self.third]], minlength=len(triples))
        self.triple_cuts = np.searchsorted(parent, self.pair_cuts)

    def slices(self, shard: int) -> list[slice]:
        """Its words, contexts, pairs and triples."""
        return [slice(*x[shard : shard + 2]) for x in (self.word_cuts, self.context_cuts, self.pair_cuts, self.triple_cuts)]

    def question(self, shard: int) -> bytes | None:
        """What the shard is asked, None if it is nothing."""
        w, c, p, t = self.slices(shard)
        if w.start == w.stop and c.start == c.stop:
            return None
        return _packed(
            self.words[w].tobytes(),
            _small(self.word_counts[w]),
            _low(self.contexts[c], CONTEXT_BITS),
            _small(self.runs[c]),
            self.successors[p].tobytes(),
            _small(self.pair_counts[p]),
            _small(self.children[p]),
            _low(self.thirds[t], TRIPLE_BITS),
            _small(self.triple_counts[t]),
        )


def _packed(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _unpacked(data: bytes, n: int) -> list[bytes]:
    at = [4 * n]
    for length in struct.unpack(f"<{n}I", data[: 4 * n]):
        at.append(at[-1] + length)
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _low(values: np.ndarray, bits: int) -> bytes:
    """The lowest bytes of each value."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)[:, : bits // 8].tobytes()


def _unlow(data: bytes, bits: int) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, bits // 8)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, : bits // 8] = low
    return wide.view(np.uint64).reshape(-1)


def _dense(data: bytes) -> bytes:
    """Counts and codes say little for each byte, unlike hashes."""
    return struct.pack("<I", len(data)) + _codec().compress(data, asbytes=True) if data else b""


def _undense(data: bytes) -> bytes:
    return _codec().decompress(data[4:], struct.unpack("<I", data[:4])[0], asbytes=True) if data else b""


def _small(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those over 254 are marked and follow in eight bytes."""
    large = counts > 254
    return _dense(np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes() + struct.pack("<I", int(large.sum())))


def _unsmall(data: bytes) -> np.ndarray:
    data = _undense(data)
    (large,) = struct.unpack("<I", data[-4:])
    n = len(data) - 4 - 8 * large
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, large, n)
    return counts


def _answers(questions: list[bytes]) -> tuple[list[bytes], list[int]]:
    """A shard's answers; the training tokens that it counts, and the words with any.

    Of each question: its words' counts, its contexts' followers, its pairs' codes and weights, its triples' codes.
    """
    parts = [_unpacked(q, ASKED) for q in questions]
    sizes = [len(p[0]) // 8 for p in parts]
    words, place = np.unique(np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([_unsmall(p[1]) for p in parts]), len(words)).astype(np.int64)

    contexts, of = np.unique(np.concatenate([_unlow(p[2], CONTEXT_BITS) for p in parts]), return_inverse=True)
    owner = np.repeat(of, np.concatenate([_unsmall(p[3]) for p in parts])).astype(np.uint64)
    pairs, pair = np.unique((owner << np.uint64(PAIR_BITS)) | np.concatenate([np.frombuffer(p[4], np.uint32) for p in parts]), return_inverse=True)
    pair_totals = np.bincount(pair, np.concatenate([_unsmall(p[5]) for p in parts]), len(pairs)).astype(np.int64)
    below = np.repeat(pair, np.concatenate([_unsmall(p[6]) for p in parts])).astype(np.uint64)
    triples, triple = np.unique((below << np.uint64(TRIPLE_BITS)) | np.concatenate([_unlow(p[7], TRIPLE_BITS) for p in parts]), return_inverse=True)
    triple_totals = np.bincount(triple, np.concatenate([_unsmall(p[8]) for p in parts]), len(triples)).astype(np.int64)
    pair_owner, second = (pairs >> np.uint64(PAIR_BITS)).astype(np.int64), pairs & np.uint64((1 << PAIR_BITS) - 1)
    triple_owner, third = (triples >> np.uint64(TRIPLE_BITS)).astype(np.int64), triples & np.uint64((1 << TRIPLE_BITS) - 1)

    # The model has what was learned; a learned triple's pair was learned with it.
    known, kept = pair_totals > 0, triple_totals > 0
    followed = np.bincount(pair_owner, pair_totals, len(contexts)).astype(np.int64)
    trained = np.flatnonzero(followed)
    renumbered = np.cumsum(followed > 0) - 1, np.cumsum(known) - 1
    book = Codebook()
    below_each = np.bincount(triple_owner[kept], triple_totals[kept], len(pairs))[known]
    distinct = np.bincount(triple_owner[kept], minlength=len(pairs))[known]
    weights = np.where(below_each > 0, book.encode(D * distinct / np.maximum(1, below_each)), 0).astype(np.uint8)
    trie = Trie(
        contexts[trained],
        CONTEXT_BITS,
        [
            (renumbered[0][pair_owner[known]], second[known], PAIR_BITS, book.encode(pair_totals[known] / followed[pair_owner[known]])),
            (renumbered[1][triple_owner[kept]], third[kept], TRIPLE_BITS, book.encode((triple_totals[kept] - D) / pair_totals[triple_owner[kept]])),
        ],
    )
    # Each distinct n-gram is searched once, below the place where its context was found.
    at = trie.context(contexts)
    at_pair = trie.children(0, at[pair_owner], second)
    at_triple = trie.children(1, at_pair[triple_owner], third)
    pair_codes, triple_codes = trie.code(0, at_pair), trie.code(1, at_triple)
    pair_weights = np.where(at_pair >= 0, weights[np.maximum(at_pair, 0)] if len(weights) else 0, 0).astype(np.uint8)

    out = []
    cuts = [np.concatenate([[0], np.cumsum(x)]) for x in (sizes, [len(p[2]) * 8 // CONTEXT_BITS for p in parts], [len(p[4]) // 4 for p in parts], [len(p[7]) * 8 // TRIPLE_BITS for p in parts])]
    for k in range(len(parts)):
        w, c, p, t = (slice(x[k], x[k + 1]) for x in cuts)
        out.append(_packed(_small(counts[place[w]]), _small(followed[of[c]]), *(_dense(x.tobytes()) for x in (pair_codes[pair[p]], pair_weights[pair[p]], triple_codes[triple[t]]))))
    return out, [int(counts.sum()), int((counts > 0).sum())]


def _probabilities(unit: Unit, answers: list[tuple[int, bytes]], n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token whether it is known, its base probability and its probability after the two before."""
    counts, followed = np.zeros(len(unit.words)), np.zeros(len(unit.contexts))
    codes, weights = np.zeros((2, len(unit.successors)), np.uint8)
    triples = np.zeros(len(unit.thirds), np.uint8)
    for shard, data in answers:
        w, c, p, t = unit.slices(shard)
        own = _unpacked(data, ANSWERED)
        counts[w], followed[c] = _unsmall(own[0]), _unsmall(own[1])
        codes[p], weights[p], triples[t] = (np.frombuffer(_undense(x), np.uint8) for x in own[2:])
    decode = Codebook().decode
    alone = ((counts + 0.1) / (n + 0.1 * (v + 1)))[unit.token]
    two = ((decode(codes) * followed[unit.owner])[unit.pair] + MU * alone) / (counts[unit.context] + MU)
    three = two.copy()
    parent = unit.pair[unit.third - 1]
    weight = np.where(weights > 0, decode(weights), 1.0)[parent]
    three[unit.third] = decode(triples)[unit.triple] + weight * two[unit.third]
    return counts[unit.token] > 0, alone, three


def _scored(unit: Unit, answers: list[tuple[int, bytes]], n: int, v: int) -> list[np.ndarray]:
    """Each text's known tokens, base score and score."""
    known, alone, three = _probabilities(unit, answers, n, v)
    return [np.add.reduceat(x, unit.starts) for x in (known.astype(np.int64), np.log10(alone), np.log10(three))]


def _parts(units: int):
    """Rows as compressed parts of PART_BYTES or a longer text, each dealt to a unit by its content."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = W.buffers(batch.column(1))[1]
            unit, data = [], []
            for a, b in W.chunks(np.diff(offsets), PART_BYTES):
                part = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), W.as_text(batch.column(1).slice(a, b - a)), batch.column(2).slice(a, b - a)], ["doc", "text", "train"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=_codec())) as out:
                    out.write_batch(part)
                data.append(sink.getvalue().to_pybytes())
                unit.append(int.from_bytes(blake2b(data[-1], digest_size=7).digest(), "little") % units)
                if sum(map(len, data)) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(data, pa.binary())], ["unit", "data"])
                    unit, data = [], []
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(data, pa.binary())], ["unit", "data"])

    return mapped


def _opened(table: pa.Table) -> pa.Table:
    """A unit's rows, in an order that does not depend on how they came."""
    parts = sorted(x.as_py() for x in table.column("data"))
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in parts]).combine_chunks()


def score(df: DataFrame, train: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``id, trained, n_tokens, n_known, train_tokens, base_score, score`` for each row; other columns are ignored.

    The model is learned from the whole texts of all rows for which ``train`` holds (null: does not). A-Z are lower-cased;
    tokens are the words ``[^\\x20\\x09-\\x0D]+`` and one end for each text; null texts count as empty. ``n_known`` counts
    tokens with a training count, ``train_tokens`` all training tokens, ``base_score`` sums log10 P(token), and ``score``
    log10 P(token | the two before), with the text's start before its first. Repeated rows stay, each with its own score.

    Words are told apart by 64 bits; in pairs a context has 48 bits and a successor 32 within it, in triples 24 within the
    pair. Nothing is gathered on the driver but the text's total size. A unit asks a shard only if it has something to ask,
    so there are never more questions than n-grams, and a pair's followers meet its shard once for each unit.
    """
    spark = df.sparkSession
    rows = df.select(quoted(id).cast("long").alias("doc"), F.coalesce(quoted(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = shards = max(partitions(spark), -(-total // UNIT_BYTES))
    dealt = rows.mapInArrow(_parts(units), "unit int, data binary").repartition(units, "unit")

    def ask(table: pa.Table) -> pa.Table:
        own = _opened(table)
        unit = Unit(own.column("text"), own.column("train").to_numpy(), shards)
        questions = [(s, q) for s in range(shards) if (q := unit.question(s)) is not None]
        del unit, own
        W.give_back()
        return pa.table(
            {
                "unit": pa.array([table.column("unit")[0].as_py()] * len(questions), pa.int32()),
                "shard": pa.array([s for s, _ in questions], pa.int32()),
                "question": pa.array([q for _, q in questions], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        answers, sums = _answers([q.as_py() for q in table.column("question")])
        W.give_back()
        return pa.table({"unit": table.column("unit"), "shard": table.column("shard"), "answer": pa.array(answers, pa.binary()), "sums": pa.array([sums] * len(answers), pa.list_(pa.int64()))})

    asked = dealt.groupBy("unit").applyInArrow(ask, "unit int, shard int, question binary")
    answered = asked.groupBy("shard").applyInArrow(answer, "unit int, shard int, answer binary, sums array<long>").repartition(units, "unit")
    # The sums refer to every column, so that both uses of the answers read one exchange.
    each = answered.groupBy("shard").agg(F.max("sums").alias("sums"), F.sum(F.octet_length("answer") + F.col("unit")).alias("used"))
    all_sums = each.agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(2)]).alias("all_sums"), F.sum("used").alias("used"))
    for_each = all_sums.select(F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"), "all_sums", "used")
    with_sums = answered.join(for_each, "unit", "left")  # an inner join would put a filter below one of the two uses

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = _opened(texts)
        unit = Unit(own.column("text"), own.column("train").to_numpy(), shards)
        n, v = answers.column("all_sums")[0].as_py()
        sums = _scored(unit, [(s, a.as_py()) for s, a in zip(answers.column("shard").to_pylist(), answers.column("answer"), strict=True)], n, v)
        return pa.table(
            {
                "doc": own.column("doc"),
                "trained": own.column("train"),
                "n_tokens": pa.array(unit.lengths, pa.int64()),
                "n_known": pa.array(sums[0], pa.int64()),
                "train_tokens": pa.array([n] * unit.docs, pa.int64()),
                "base_score": pa.array(sums[1], pa.float64()),
                "score": pa.array(sums[2], pa.float64()),
            }
        )

    schema = "doc long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = dealt.groupBy("unit").cogroup(with_sums.groupBy("unit")).applyInArrow(scored, schema)
    return found.withColumnRenamed("doc", id)

"""Near-duplicate groups by a chosen-path set similarity join on word shingles.

Independent trees branch documents by selected minwise tokens. A node chooses a third more than one of its level's hash
functions on average (1 / 0.75), and a document follows the token that is smallest under each; a pair at the threshold so
keeps meeting in about one child of each node where it meets, however deep the tree. Small nodes are compared exhaustively.
Comparisons inside trees estimate similarity from all tokens; links are then confirmed on full sets.

Nodes never become pairs outside a task. First each document's likeliest partners are confirmed, at most two for each
document. Then the leaves whose documents are still in different groups get the full sets, and a task compares all pairs of
a leaf between those groups exactly, so what an estimate or a failed link hid inside a leaf is decided there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.frames import cut, partitions, possible, quoted

NO_ID = (1 << 63) - 1
#: Kinds of a task's findings: a likely link to the smallest sure partner, one to the nearest partner, a leaf's member.
SURE, NEAREST, MEMBER = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """Sets of ``shingle`` words are linked if ``per`` * intersection >= ``share`` * union.

    A pair at the threshold of 0.75 meets at depth d of one tree with probability of about 0.75 / (1 + 0.14 * (d - 1)):
    0.75 at the first level, 0.58 at the third, 0.33 at the tenth and last. 12 trees miss it with probabilities of 6e-8,
    3e-5 and 0.008; closer pairs are missed more rarely. Few leaves are deeper than the third level.
    """

    shingle: int = 5
    share: int = 75
    per: int = 100
    trees: int = 12
    depth: int = 10
    #: Documents that a leaf compares exhaustively by estimates.
    small: int = 64
    #: Documents of a node that a task branches; Spark branches nodes with more.
    hot: int = 20_000
    #: Pairs whose estimate is below ``unsure`` are no candidates of a small leaf, those above ``sure`` are tried first. Both
    #: are three standard deviations of an estimate from 120 tokens away from 0.75.
    unsure: float = 0.63
    sure: float = 0.87
    #: Mean similarity at which branching separates nothing, so that a node is a leaf whatever its size.
    tight: float = 0.7
    #: Documents with which the others of a large leaf are first compared.
    leaders: int = 16
    #: Documents and shingles, about, of a block of a leaf that is compared on full sets.
    block_docs: int = 400
    block_shingles: int = 1 << 20


def shingles(words: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's shingles, repeats included; the whole sequence where there are fewer words."""
    h, counts = W.hashes(words), words.counts
    per_doc = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(per_doc)])
    out = np.zeros(offsets[-1], np.uint64)
    long = np.flatnonzero(counts >= size)
    take = np.repeat(words.first[:-1][long] - (np.cumsum(per_doc[long]) - per_doc[long]), per_doc[long]) + np.arange(per_doc[long].sum())
    put = np.repeat(offsets[:-1][long] - (np.cumsum(per_doc[long]) - per_doc[long]), per_doc[long]) + np.arange(per_doc[long].sum())
    if len(take):
        out[put] = W.runs(h, size)[take]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            out[offsets[:-1][short]] = W.mix(W.runs(h, n)[words.first[:-1][short]] + np.uint64(n))
    return out, offsets


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, sorted within each document."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(offsets) - 1))]).astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch], text: int, settings: Settings):
    for batch in batches:
        data, offsets = W.buffers(batch.column(text))
        for a, b in W.chunks(np.diff(offsets)):
            words = W.find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.SPACES, lower=True)
            yield batch.slice(a, b - a), *distinct(*shingles(words, settings.shingle))


def _bytes_of(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _signatures(settings: Settings):
    """For each text: set size, a 128-bit hash of the set, the first token of each tree, 16 bits of every level's tokens."""
    draw = np.random.default_rng(20)
    masks = draw.integers(0, 1 << 63, settings.trees * settings.depth, dtype=np.uint64)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, offsets in _each(batches, 1, settings):
            counts = np.diff(offsets)
            some = np.flatnonzero(counts)
            starts = offsets[:-1][some]
            one, two = _digest(sets, offsets)
            tokens = np.zeros((len(counts), len(masks)), np.uint16)
            firsts = np.zeros((len(counts), settings.trees), np.uint64)
            if len(some):
                for j, mask in enumerate(masks):
                    v = (sets ^ mask) * np.uint64(0x9E3779B97F4A7C15)
                    v ^= v >> np.uint64(32)
                    v *= np.uint64(0xD6E8FEB86659FD93)
                    least = np.minimum.reduceat(v, starts)
                    tokens[some, j] = (W.mix(least) >> np.uint64(48)).astype(np.uint16)
                    if j < settings.trees:
                        firsts[some, j] = W.mix(least + np.uint64(j))
            size = tokens.shape[1] * 2
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(one.view(np.int64)),
                    pa.array(two.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * settings.trees), pa.array(firsts.reshape(-1).view(np.int64))),
                    pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.arange(len(counts) + 1, dtype=np.int32) * size), pa.py_buffer(tokens.tobytes())]),
                ],
                ["doc", "n", "one", "two", "firsts", "tokens"],
            )

    return mapped


def _digest(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart; 0 for empty ones."""
    one, two = np.zeros((2, len(offsets) - 1), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        one[some] = np.add.reduceat(W.mix(sets), offsets[:-1][some])
        two[some] = np.add.reduceat(W.mix(sets + np.uint64(1)), offsets[:-1][some])
    return one, two


def _sets(settings: Settings):
    """Each text's 128-bit hash and its set: the sorted hashes of its shingles."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, offsets in _each(batches, 1, settings):
            one, two = _digest(sets, offsets)
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(one), [None, pa.py_buffer(offsets * 8), pa.py_buffer(sets.tobytes())])
            columns = [batch.column(0), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(offsets), pa.int64()), values.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "one", "two", "n", "set"])

    return mapped


class _Trees:
    """Branches the nodes of one task and gathers what it finds."""

    def __init__(self, settings: Settings, ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray):
        self.s, self.ids, self.sizes, self.tokens = settings, ids, sizes, tokens
        self.pairs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # small leaf, rows, rows, estimates
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []  # x, y, estimate, kind
        self.leaves = 0

    def estimate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of rows a and b, 0 where the sizes alone rule a link out."""
        same = (self.tokens[a] == self.tokens[b]).mean(-1)
        low, high = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        return np.where(self.s.per * low >= self.s.share * high, same, 0.0)

    def branch(self, rows: np.ndarray, level: int, path: int) -> None:
        open_ = [(rows, level, path)]
        while open_:
            rows, level, path = open_.pop()
            if len(rows) <= self.s.small:
                self.small(rows)
            elif level >= self.s.depth or self.tight(rows):
                self.large(rows)
            else:
                for c in self.chosen(path, level):
                    token = self.tokens[rows, c]
                    order = np.argsort(token, kind="stable")
                    cuts = np.flatnonzero(np.diff(token[order])) + 1
                    for part in np.split(rows[order], cuts):
                        if len(part) > 1:
                            open_.append((part, level + 1, hash((path, c, int(self.tokens[part[0], c])))))

    def chosen(self, path: int, level: int) -> list[int]:
        """One or two of the level's hash functions, per / share on average, drawn by the node's path."""
        draw = int(W.mix(np.array([path & (1 << 63) - 1], np.uint64))[0])
        one, rest = draw % self.s.trees, draw // self.s.trees
        out = [level * self.s.trees + one]
        if self.s.trees > 1 and rest % self.s.share < self.s.per - self.s.share:
            out.append(level * self.s.trees + (one + 1 + rest // self.s.share % (self.s.trees - 1)) % self.s.trees)
        return out

    def tight(self, rows: np.ndarray) -> bool:
        """Whether two of the rows agree on most tokens, on average over a fifth of the hash functions."""
        shares = []
        for c in range(0, self.tokens.shape[1], 5):
            counts = np.unique(self.tokens[rows, c], return_counts=True)[1]
            shares.append((counts.astype(float) ** 2).sum() / len(rows) ** 2)
        return float(np.mean(shares)) >= self.s.tight

    def small(self, rows: np.ndarray) -> None:
        i, j = np.triu_indices(len(rows), 1)
        self.compare(rows[i], rows[j], np.zeros(len(i), np.int64))

    def compare(self, a: np.ndarray, b: np.ndarray, leaf: np.ndarray) -> None:
        """Note the candidates among pairs of leaves 0, 1, ... that are numbered on from those before."""
        same = self.estimate(a, b)
        keep = same >= self.s.unsure
        if keep.any():
            self.pairs.append((leaf[keep] + self.leaves, a[keep], b[keep], same[keep]))
        self.leaves += int(leaf[-1]) + 1 if len(leaf) else 0

    def large(self, rows: np.ndarray, leaf: int | None = None) -> None:
        """A leaf of many: each of some leaders is compared with all rows; what that misses is left to the full sets.

        All rows are members, as any of them may be linked to any other.
        """
        rows = rows[np.argsort(self.ids[rows], kind="stable")]
        rest = np.ones(len(rows), bool)
        best, partner, least = np.zeros(len(rows)), np.full(len(rows), -1), np.full(len(rows), -1)
        for _ in range(self.s.leaders):
            left = np.flatnonzero(rest)
            if not len(left):
                break
            k = left[0]
            same = self.estimate(np.full(len(rows), rows[k]), rows)
            same[k] = 0.0
            better = same > best
            best[better], partner[better] = same[better], k
            first = (same >= self.s.sure) & (least < 0) & (np.arange(len(rows)) > k)
            least[first] = k
            rest[k] = False
            rest &= same < self.s.sure
        ids = self.ids[rows]
        sure, near = np.flatnonzero(least >= 0), np.flatnonzero(best >= self.s.unsure)
        self.found.append((ids[least[sure]], ids[sure], np.ones(len(sure)), SURE))
        self.found.append((ids[partner[near]], ids[near], best[near], NEAREST))
        if leaf is None:
            leaf = int((W.mix(ids.astype(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(ids))).view(np.int64))
        self.found.append((np.full(len(ids), leaf), ids, np.zeros(len(ids)), MEMBER))

    def settle(self) -> None:
        """Turn the candidates of all small leaves into findings; a leaf's unconnected parts become leaves of their own."""
        if not self.pairs:
            return
        leaf, a, b, same = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        vertex, at = np.unique(np.concatenate([leaf * len(self.ids) + a, leaf * len(self.ids) + b]), return_inverse=True)
        ids = self.ids[vertex % len(self.ids)]
        i, j = at[: len(a)], at[len(a) :]
        part = _components(len(vertex), i, j)
        order = np.argsort(part, kind="stable")
        begin = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1])
        sizes = np.diff(np.concatenate([begin, [len(order)]]))
        # Named by its members, a leaf that several trees find is one.
        names = np.add.reduceat(W.mix(ids[order].astype(np.uint64)), begin) + sizes.astype(np.uint64)
        self.found.append((np.repeat(names.view(np.int64), sizes), ids[order], np.zeros(len(order)), MEMBER))
        x, y, same = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([same, same])
        order = np.lexsort((ids[x], -same, y))
        order = order[np.concatenate([[True], np.diff(y[order]) != 0])]
        self.found.append((ids[x[order]], ids[y[order]], same[order], NEAREST))
        sure = np.flatnonzero((same >= self.s.sure) & (ids[x] < ids[y]))
        order = sure[np.lexsort((ids[x[sure]], y[sure]))]
        if len(order):
            order = order[np.concatenate([[True], np.diff(y[order]) != 0])]
        self.found.append((ids[x[order]], ids[y[order]], same[order], SURE))


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            return label
        label = new[new]


def _streamed(key: str, limit: int, size, answer):
    """Hand whole groups of rows that are in the order of ``key`` to ``answer``, as soon as they weigh ``limit`` together."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            for part in (batch.slice(a, 4000) for a in range(0, len(batch), 4000)):
                held.append(part)
                weight += size(part)
                if weight < limit:
                    continue
                table = pa.Table.from_batches(held)
                keys = table.column(key).to_numpy()
                other = np.flatnonzero(keys != keys[-1])
                whole = int(other[-1]) + 1 if len(other) else 0
                if whole:
                    yield from answer(table.slice(0, whole).combine_chunks())
                held = table.slice(whole).combine_chunks().to_batches()
                weight = sum(map(size, held))
        if held and sum(map(len, held)):
            yield from answer(pa.Table.from_batches(held).combine_chunks())
        W.give_back()

    return mapped


def _grow(settings: Settings):
    """From rows (node, level, leaf, doc, n, tokens) in the order of node: ``x, y, same, kind``.

    Of a likely link x and y are documents, of a member x is the leaf. Rows with a ``leaf`` are a piece of one.
    """
    width = settings.trees * settings.depth

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, level, ids, sizes = (table.column(c).to_numpy() for c in ("node", "level", "doc", "n"))
        leaf = table.column("leaf").to_numpy(zero_copy_only=False) if table.column("leaf").null_count < len(table) else None
        tokens = _bytes_of(table.column("tokens"))[0].view(np.uint16).reshape(-1, width)
        trees = _Trees(settings, ids, sizes, tokens)
        begin = np.concatenate([[0], np.flatnonzero(np.diff(node) != 0) + 1, [len(node)]])
        counts = np.diff(begin)
        whole = np.ones(len(counts), bool) if leaf is None else np.isnan(leaf[begin[:-1]].astype(float))
        two = begin[:-1][(counts == 2) & whole]  # most nodes: compared all at once
        trees.compare(two, two + 1, np.arange(len(two)))
        for k in np.flatnonzero((counts > 2) | ~whole):
            rows = np.arange(begin[k], begin[k + 1])
            if whole[k]:
                trees.branch(rows, int(level[begin[k]]), int(node[begin[k]]))
            else:
                trees.large(rows, int(table.column("leaf")[int(begin[k])].as_py()))
        trees.settle()
        for x, y, same, kind in trees.found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(same, pa.float64()), pa.array(np.full(len(x), kind, np.int8))], ["x", "y", "same", "kind"])

    return _streamed("node", 2 * settings.hot, len, answer)


def placed(nodes: DataFrame, settings: Settings) -> DataFrame:
    """``node, level, leaf, doc``: the nodes of more than one and at most ``hot`` documents, and pieces of large leaves.

    Larger nodes are branched here, level by level, like the smaller ones in tasks: a node that is ``tight`` or at the last
    level is a leaf. Its piece holds about ``hot`` documents and the leaf's smallest one, which connects the pieces.
    """
    key = F.xxhash64("tree", "token").alias("node")
    slim = nodes.select("doc", F.posexplode("firsts").alias("tree", "token")).select("doc", key, F.lit(1).alias("level"))
    none = F.lit(None).cast("long").alias("leaf")
    parts, leaves = [], []
    for level in range(1, settings.depth + 1):
        counts = slim.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = slim.join(counts, "node")
        parts.append(sized.where(F.col("size") <= settings.hot).select("node", "level", none, "doc"))
        if not counts.where(F.col("size") > settings.hot).head(1):
            break
        large = sized.where(F.col("size") > settings.hot).join(nodes.select("doc", "tokens"), "doc")
        large = cut(large.select("node", "size", "doc", "tokens"))
        if level == settings.depth:
            leaves.append(large.select("node", "size", "doc"))
            break

        def token(c: Column) -> Column:
            return F.hex(F.substring(F.col("tokens"), (2 * c + 1).cast("int"), F.lit(2)))

        # The share of pairs that agree, over a few hash functions spread over all.
        probes = [settings.trees * settings.depth * i // 8 for i in range(8)]
        each = large.select("node", "size", F.posexplode(F.array(*[token(F.lit(c)) for c in probes])).alias("probe", "token"))
        share = each.groupBy("node", "size", "probe", "token").agg(F.count(F.lit(1)).alias("m")).groupBy("node").agg((F.sum(F.col("m") * F.col("m") / F.col("size") / F.col("size")) / len(probes)).alias("share"))
        tight = share.where(F.col("share") >= settings.tight).select("node")
        leaves.append(large.join(tight, "node", "left_semi").select("node", "size", "doc"))
        # One or two hash functions of the level, per / share on average, drawn by the node.
        t = settings.trees
        one = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(t))
        more = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(settings.share)) < settings.per - settings.share
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(3)), F.lit(max(1, t - 1))), F.lit(t))
        picks = F.when(more & F.lit(t > 1), F.array(one, two)).otherwise(F.array(one))
        slim = large.join(tight, "node", "left_anti").select("doc", "node", "tokens", F.explode(picks).alias("pick"))
        slim = slim.select("doc", F.xxhash64("node", "pick", token(F.col("pick") + level * t)).alias("node"), F.lit(level + 1).alias("level"))
    for leaf in leaves:
        pieces = F.ceil(F.col("size") / settings.hot)
        piece = F.pmod(F.xxhash64("doc", F.lit(1)), pieces)
        least = leaf.groupBy("node", "size").agg(F.min("doc").alias("doc"))
        mine = leaf.select("node", "doc", piece.alias("piece")).union(least.select("node", "doc", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))))
        parts.append(mine.distinct().select(F.xxhash64("node", "piece").alias("node"), F.lit(settings.depth).alias("level"), F.col("node").alias("leaf"), "doc"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def likely(nodes: DataFrame, settings: Settings) -> DataFrame:
    """What the trees find among ``nodes`` (node as doc, n, firsts, tokens): ``x, y, same, kind``; see :func:`_grow`.

    There are at most three rows for each document of a leaf, whatever the leaf's size.
    """
    rows = placed(nodes, settings).join(nodes.select("doc", "n", "tokens"), "doc").select("node", "level", "leaf", "doc", "n", "tokens")
    rows = rows.repartition(partitions(nodes.sparkSession), "node").sortWithinPartitions("node", "doc")
    return rows.mapInArrow(_grow(settings), "x long, y long, same double, kind byte")


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked; ``sets`` has ``doc, set``. A frequent ``a`` is dealt to parts by its partners."""
    share, per = settings.share, settings.per

    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both > 0 and per * both >= share * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 200).alias("parts"))
    left = sets.join(parts, F.col("doc") == F.col("a")).select("a", "parts", F.col("set").alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = pairs.join(parts, "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("right")), "b").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "right")
    return right.join(left.select("a", "part", "left"), ["a", "part"]).where(linked("left", "right")).select("a", "b")


def _exact(settings: Settings):
    """From rows (group, label, set) in the order of group: label pairs ``a, b`` that connect what is linked in a group."""

    def linked(labels: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of rows of different labels that are linked."""
        n = len(labels)
        sizes = np.diff(offsets)
        if n == 2:
            both = np.array([[0, len(np.intersect1d(values[: offsets[1]], values[offsets[1] :], assume_unique=True))], [0, 0]])
        else:
            order = np.argsort(values, kind="stable")
            sorted_ = values[order]
            new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
            code = np.cumsum(new) - 1
            shared = np.bincount(code)[code] > 1
            row, code = np.repeat(np.arange(n), sizes)[order][shared], code[shared]
            code = np.cumsum(np.concatenate([[True], code[1:] != code[:-1]])) - 1 if len(code) else code
            both = np.zeros((n, n))
            width = max(1, (1 << 21) // n)
            for a in range(0, int(code[-1]) + 1 if len(code) else 0, width):
                low, high = np.searchsorted(code, [a, a + width])
                part = np.zeros((n, width), np.float32)
                part[row[low:high], code[low:high] - a] = 1
                both += part @ part.T
        i, j = np.triu_indices(n, 1)
        common = both[i, j]
        keep = (labels[i] != labels[j]) & (common > 0) & (settings.per * common >= settings.share * (sizes[i] + sizes[j] - common))
        return i[keep], j[keep]

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group, labels = table.column("group").to_numpy(), table.column("label").to_numpy()
        data, offsets = _bytes_of(table.column("set"))
        values, offsets = data.view(np.uint64), offsets // 8
        begin = np.concatenate([[0], np.flatnonzero(np.diff(group) != 0) + 1, [len(group)]])
        found = []
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            if labels[a:b].min() == labels[a:b].max():
                continue
            i, j = linked(labels[a:b], values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if len(i):
                names, at = np.unique(labels[a:b], return_inverse=True)
                top = _components(len(names), at[i], at[j])
                joined = np.flatnonzero(top != np.arange(len(names)))
                found.append(np.stack([names[top[joined]], names[joined]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return _streamed("group", 8 << 20, lambda part: part.nbytes, answer)


def across(leaves: DataFrame, labels: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs ``a, b`` of labels that some link in a leaf connects; ``leaves`` has ``leaf, doc``, ``labels`` ``doc, label``.

    Leaves of one label have nothing to tell. Of the others small ones are compared in one task; larger ones are cut into
    blocks, and only those of the most frequent label never meet each other, so a few strangers in a leaf of many cost no
    more than reading it.
    """
    found = leaves.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    facts = found.groupBy("leaf").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("leaf")
    found = cut(found.join(facts, "leaf").join(sets.select("doc", "n"), "doc"))
    each = found.groupBy("leaf", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    top = each.groupBy("leaf").agg(F.max(F.struct("m", "label", "n")).alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"))

    def blocks(m: Column, n: Column) -> Column:
        return F.greatest(F.ceil(m / settings.block_docs), F.ceil(n / settings.block_shingles), F.lit(1).cast("long"))

    top = top.select("leaf", F.col("top.label").alias("most"), blocks(F.col("top.m"), F.col("top.n")).alias("tops"), blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("rests"))
    zero = F.lit(0).cast("long")
    place = F.xxhash64("doc", F.lit(2))
    meet = lambda n, kind, a, b: F.transform(F.sequence(zero, n - 1), lambda k: F.xxhash64("leaf", F.lit(kind), a(k), b(k)))
    own_top, own_rest = F.pmod(place, F.col("tops")), F.pmod(place, F.col("rests"))
    with_tops = meet(F.col("tops"), 0, lambda k: k, lambda k: own_rest)
    with_rests = meet(F.col("rests"), 0, lambda k: own_top, lambda k: k)
    with_others = F.filter(meet(F.col("rests"), 1, lambda k: F.least(k, own_rest), lambda k: F.greatest(k, own_rest)), lambda g: g != F.xxhash64("leaf", F.lit(1), own_rest, own_rest))
    where = F.when(F.col("label") == F.col("most"), with_rests).otherwise(F.concat(with_tops, with_others))
    rows = found.join(top, "leaf").select("doc", "label", F.explode(where).alias("group")).join(sets.select("doc", "set"), "doc").select("group", "label", "set")
    rows = rows.repartition(partitions(leaves.sparkSession), "group").sortWithinPartitions("group", "label")
    return rows.mapInArrow(_exact(settings), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: for each end of an edge (a, b) the smallest node reachable. Each round's labels are cut.

    A round takes the smallest label among neighbours and then that label's own label, so paths shorten by half or more.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("seen")).withColumnRenamed("a", "node")
        lower = labels.join(seen, "node").select("node", "component", F.least("component", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        new = cut(lower.join(jump, "next", "left").select("node", F.col("component").alias("old"), F.least("next", "beyond").alias("component")))
        if not new.where("old <> component").head(1):
            return new.select("node", "component")
        labels = new.select("node", "component")


def groups(df: DataFrame, id: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """Return ``id, n_shingles, component_id, kept`` for each row; other columns of ``df`` are ignored.

    Texts are read whole, A-Z lower-cased, and cut into words ``[^\\x20\\x09-\\x0D]+``; a set has the distinct shingles, or
    the whole sequence where there are fewer words. Texts without words, and null ones, have an empty set and are linked
    with nothing. ``component_id`` is the smallest id reachable over links, ``kept`` says that it is the row's own. Rows
    with one id are one document and in one component, which belongs to the sets of all its texts; a null id is larger
    than all others. An empty table gives an empty result.

    Equal sets become one node before anything is compared, so copies make no pairs. A node goes by the smallest id that
    has its set, or by a hash where one id is the smallest of several sets.
    """
    settings = settings or Settings()
    rows = df.select(F.coalesce(quoted(id).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    signed = cut(rows.mapInArrow(_signatures(settings), "doc long, n long, one long, two long, firsts array<long>, tokens binary"))
    some = signed.where("n > 0")
    digest = ["one", "two"]
    sets = some.groupBy(*digest).agg(F.min("doc").alias("rep"))
    first = sets.groupBy("rep").agg(F.min(F.struct(*digest)).alias("first"))
    sets = sets.join(first, "rep").withColumn("node", F.when(F.struct(*digest) == F.col("first"), F.col("rep")).otherwise(F.xxhash64("rep", *digest))).drop("first")
    sets = cut(sets.select("rep", *digest, "node"))
    member = some.select("doc", *digest).distinct().join(sets, digest).select("doc", "node")
    keyed = sets.select(F.col("rep").alias("doc"), *digest, "node")
    own = cut(some.join(keyed, ["doc", *digest]).dropDuplicates(["node"]).select(F.col("node").alias("doc"), "n", "firsts", "tokens"))
    found = cut(likely(own, settings))

    leaves = cut(found.where(F.col("kind") == MEMBER).select(F.col("x").alias("leaf"), F.col("y").alias("doc")).distinct())
    ends = leaves.select(F.col("doc").alias("node")).distinct().join(sets, "node").select(F.col("rep").alias("doc"), *digest, "node")
    ends = cut(ends)
    full = possible(rows, ends, "doc").mapInArrow(_sets(settings), "doc long, one long, two long, n long, set binary")
    full = cut(full.join(ends, ["doc", *digest]).dropDuplicates(["node"]).select(F.col("node").alias("doc"), "n", "set"))

    sure = found.where(F.col("kind") == SURE).groupBy("y").agg(F.min("x").alias("x"))
    near = found.where(F.col("kind") == NEAREST).groupBy("y").agg(F.max(F.struct("same", (-F.col("x")).alias("x"))).alias("best")).select("y", (-F.col("best.x")).alias("x"))
    tried = sure.select("x", "y").union(near.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = confirmed(cut(tried), full, settings)
    # A document under one id with several texts belongs to the sets of all of them.
    least = member.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    shared_ids = member.join(least, "doc").where("a <> node").select("a", F.col("node").alias("b"))
    labels = components(links.union(shared_ids)).select(F.col("node").alias("doc"), F.col("component").alias("label"))

    more = components(across(leaves, labels, full, settings)).select(F.col("node").alias("label"), F.col("component").alias("top"))
    label = member.join(labels.withColumnRenamed("doc", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    label = label.join(more, "label", "left").select("doc", F.coalesce("top", "label").alias("label"))
    label = label.groupBy("doc").agg(F.min("label").alias("label"))
    # A group whose smallest node goes by a hash is the only one that needs another name.
    smallest = label.groupBy("label").agg(F.min("doc").alias("component")).where("component <> label")
    out = signed.select("doc", "n").join(label, "doc", "left").join(smallest, "label", "left").select("doc", "n", F.coalesce("component", "label", "doc").alias("component"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("doc").alias(id), F.col("n").alias("n_shingles"), back("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))

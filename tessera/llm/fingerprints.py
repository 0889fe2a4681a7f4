"""SimHash document fingerprints and the search for all fingerprints within a Hamming radius. Only DataFrame functions are used.

Terms are pairs of consecutive words, the first word paired with the start of the text; a term's weight is its number of
occurrences. Each term's hashes vote on signed bits: a bit is 1 where more than half of the weight says so.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.frames import cut, partitions

#: Bits that vote together: three counters of LANE bits in a long, so LANE longs count 3 * LANE bits.
LANE = 21
WORD_BITS = 3 * LANE
#: Terms of one row counted in one set of counters, so that no counter runs over.
CHUNK_TERMS = (1 << LANE) - 1
#: Ids that the driver looks at to deal rows into buckets, and a bucket's bytes.
QUANTILES, BUCKET_BYTES = 2048, 16 << 20
LANES = (1 << 2 * LANE) | (1 << LANE) | 1
SEPARATORS = r"[ \t-\r]+"


def term_hashes(text: Column) -> Column:
    """An array with a 64-bit hash of each term occurrence of the whole text; null and blank texts have none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    pairs = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), hashed), hashed, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.slice(pairs, 1, F.size(hashed))


def fingerprints(df: DataFrame, keys: list[str], texts: list[str], words: int = 2) -> DataFrame:
    """Return ``keys``, ``copies`` and, for each column t of ``texts``, ``t_bits``: an array of ``words`` longs of 63 bits each.

    Rows that agree on ``keys`` must agree on ``texts`` and become one; ``copies`` counts them, and as each adds the same
    votes the bits are those of one. Texts are read whole; a text without words has all bits 0. Equal texts have equal bits.
    """
    # Rows that repeat their keys have counters of their own, or many of them would run over together.
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    rows = rows.select(*keys, "__row", F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.col(t).alias("text")) for i, t in enumerate(texts)])).alias("__t"))
    terms = rows.select(*keys, "__row", F.col("__t.of").alias("__of"), F.posexplode_outer(term_hashes(F.col("__t.text"))).alias("__at", "__term"))
    terms = terms.withColumn("__chunk", F.floor(F.coalesce(F.col("__at"), F.lit(0)) / CHUNK_TERMS))
    sums = []
    for w in range(words):
        source = F.col("__term") if w == 0 else F.when(F.col("__term").isNotNull(), F.xxhash64(F.col("__term"), F.lit(w)))
        sums += [F.sum(F.shiftrightunsigned(source, i).bitwiseAND(F.lit(LANES))).alias(f"__s{w}_{i}") for i in range(LANE)]
    counted = terms.groupBy(*keys, "__row", "__of", "__chunk").agg(F.count("__term").alias("__n"), F.count_if(F.coalesce(F.col("__at"), F.lit(0)) == 0).alias("__copies"), *sums)

    def lane(column: Column, k: int) -> Column:
        return F.shiftrightunsigned(column, k * LANE).bitwiseAND(F.lit((1 << LANE) - 1))

    total = counted.groupBy(*keys, "__of").agg(
        F.sum("__n").alias("__n"), F.sum("__copies").alias("copies"), *[F.sum(lane(F.col(f"__s{w}_{i}"), k)).alias(f"__b{w}_{k * LANE + i}") for w in range(words) for k in range(3) for i in range(LANE)]
    )

    def packed(w: int) -> Column:
        bits = [F.when(2 * F.col(f"__b{w}_{j}") > F.col("__n"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j in range(WORD_BITS)]
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=False)] + ([bits[-1]] if len(bits) % 2 else [])
        return bits[0]

    bits = total.select(*keys, "__of", "copies", F.array(*[packed(w) for w in range(words)]).alias("__bits"))
    return bits.groupBy(*keys).agg(F.max("copies").alias("copies"), *[F.max(F.when(F.col("__of") == i, F.col("__bits"))).alias(f"{t}_bits") for i, t in enumerate(texts)])


def as_text(bits: Column) -> Column:
    """16 hex digits for each 63 bits."""
    return F.array_join(F.transform(bits, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def distance(a: Column, b: Column) -> Column:
    """Bits that differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """The share of bits that agree, 0 to 1; 1 for equal texts, near one half for unrelated ones."""
    return 1.0 - distance(a, b) / (F.size(a) * float(WORD_BITS))


def with_next(df: DataFrame, id: str, payload: str, tie: str, size: Column, bucket_bytes: int | None = None) -> DataFrame:
    """Add ``next_`` + payload: the payload of the next row in descending ``id``, after the last row that of the first.

    Rows with the same id stand in the order of ``tie`` (a long); null ids stand below all others. Rows are dealt into
    buckets of at most about ``bucket_bytes`` (BUCKET_BYTES), as many as shuffle partitions at least, as ``size`` gives a row's bytes: ids by approximate quantiles and evenly between them, an
    id that fills a quantile alone by its ties. Order within a bucket is a window; across buckets it needs the head of each
    bucket, which is dealt to the bucket before it as well. The driver holds at most QUANTILES ids; the heads are a table, 40
    bytes for each bucket, which Spark broadcasts if it is small.
    """
    key, at, copy = "__key", "__bucket", "__copy"
    rows = df.withColumn(key, F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))))
    found = rows.agg(F.sum(size).alias("bytes"), F.percentile_approx(key, [i / QUANTILES for i in range(QUANTILES + 1)], 20 * QUANTILES).alias("ids")).first()
    rows = rows.withColumn(at, _bucket(F.col(key), F.col(tie), found["ids"] or [], max(partitions(df.sparkSession), -(-(found["bytes"] or 0) // (bucket_bytes or BUCKET_BYTES)))))
    # Of each bucket the first row in the order, and the bucket that comes before it.
    first = rows.groupBy(at).agg(F.max(F.struct(F.col(key), F.bitwise_not(F.col(tie)).alias("not_tie"))).alias("first"))
    ring = Window.orderBy(at)
    before = F.coalesce(F.lead(at).over(ring), F.first(at).over(ring))
    heads = cut(first.select(F.col(f"first.{key}").alias(key), F.bitwise_not(F.col("first.not_tie")).alias(tie), before.alias("__lent")))
    places = F.array(F.struct(F.col(at).alias("at"), F.lit(0).alias("copy")))
    places = F.when(F.col("__lent").isNull(), places).otherwise(F.array(places[0], F.struct(F.col("__lent").alias("at"), F.lit(1).alias("copy"))))
    dealt = rows.join(heads, [key, tie], "left").withColumn("__to", F.explode(places)).withColumns({at: F.col("__to.at"), copy: F.col("__to.copy")}).drop("__to", "__lent")
    order = Window.partitionBy(at).orderBy(copy, F.col(key).desc(), tie)
    ringed = dealt.withColumn(f"next_{payload}", F.coalesce(F.lead(payload).over(order), F.col(payload))).where(F.col(copy) == 0)
    return ringed.drop(key, at, copy)


def _bucket(id: Column, tie: Column, quantiles: list[int], buckets: int) -> Column:
    """A number that falls, or stays, from each row to the next in descending id and ascending tie; about ``buckets`` of them.

    Quantiles are thinned to as many as there are buckets, or the room between them is divided evenly. Ids that several
    neighbouring quantiles agree on have a room of their own, which is divided by the ties.
    """
    parts = max(1, -(-buckets // QUANTILES))
    ends = {quantiles[0], quantiles[-1]} if quantiles and parts > 1 else set()
    quantiles = quantiles[1:-1]
    step = max(1, (len(quantiles) + 1) // buckets)
    bounds = {*quantiles[step - 1 :: step], *ends}
    heavy = {v: n for v in dict.fromkeys(quantiles) if (n := quantiles.count(v)) > max(1, step)} if len(set(quantiles)) < len(quantiles) else {}
    bounds = sorted({*bounds, *heavy, *(min(v + 1, (1 << 63) - 1) for v in heavy)})
    if not bounds:
        return F.lit(0).cast("long")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(b).cast("long") for b in bounds])

    def down(at: Column, s: Column) -> Column:
        return at + F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) <= id), s).otherwise(0)

    room = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), down)
    split = {v: max(1, -(-n * buckets // QUANTILES)) for v, n in heavy.items()}
    most = max([parts, *split.values()])
    part = F.lit(0).cast("long")
    if parts > 1:
        low, high = F.get(table, room - 1).cast("double"), F.get(table, room).cast("double")
        part = F.coalesce(parts - 1 - F.least(F.floor((id.cast("double") - low) / (high - low) * parts), F.lit(parts - 1)), F.lit(0))
    if split:
        share = tie.cast("double") / 2.0**64 + 0.5
        own = F.element_at(F.create_map(*[F.lit(x) for v, n in split.items() for x in (v, n)]), id)
        part = F.when(own.isNotNull(), F.least(F.floor(share * own), own - 1)).otherwise(part)
    return (room.cast("long") * most - part).cast("long")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def within(df: DataFrame, queries: DataFrame, id: str, bits: str, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs ``query_id, id, distance`` of a row of ``queries`` and a row of ``df`` at most ``radius`` bits apart.

    The bits are cut into ``blocks``; within the radius at least ``blocks - radius`` blocks agree, so one table for each
    choice of that many blocks, joined on those blocks, finds every pair. Equal fingerprints are joined once and expanded
    to ids only in the result, which leaves out a row's pair with itself. Rows with null bits have no pairs.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be at least 0 and less than blocks")
    kept = blocks - radius

    def table(rows: DataFrame, name: str) -> DataFrame:
        prints = rows.where(F.col(bits).isNotNull()).select(F.col(bits).alias(name)).distinct()
        text = F.array_join(F.transform(F.col(name), lambda x: F.lpad(F.bin(x), WORD_BITS, "0")), "")
        n = F.size(F.col(name)) * WORD_BITS

        def block(i: int) -> Column:
            begin, end = F.floor(n * i / blocks), F.floor(n * (i + 1) / blocks)
            return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))

        keys = [F.concat_ws(":", F.lit(str(t)), *[block(i) for i in chosen]) for t, chosen in enumerate(combinations(range(blocks), kept))]
        return prints.select(name, F.explode(F.array(*keys)).alias("__key"))

    pairs = table(queries, "__q").join(table(df, "__d"), "__key").where(distance(F.col("__q"), F.col("__d")) <= radius).select("__q", "__d").distinct()
    asked = queries.select(F.col(id).alias("query_id"), F.col(bits).alias("__q"))
    there = df.select(F.col(id).alias(id), F.col(bits).alias("__d"))
    return asked.join(pairs, "__q").join(there, "__d").where(~F.col("query_id").eqNullSafe(F.col(id))).select("query_id", id, distance(F.col("__q"), F.col("__d")).alias("distance"))


def compare_with_edited(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 2) -> DataFrame:
    """Fingerprint each text and its edited text (see :func:`edited`) and compare it with that and with the next document.

    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts count as
    empty. Rows that share an id are kept, in the order of their texts; null ids come last in the descending order. One
    document alone is its own next.
    """
    rows = df.select(F.col(id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("a")).withColumn("__tie", F.xxhash64("a"))
    rows = with_next(rows, "__id", "a", "__tie", F.octet_length("a") + 16).withColumn("b", edited(F.col("a"), F.col("next_a")))
    rows = rows.select("__id", "__tie", F.length("a").cast("long").alias("n_chars"), F.sha2("b", 256).alias("edited_sha256"), "a", "b")
    found = fingerprints(rows, ["__id", "__tie", "n_chars", "edited_sha256"], ["a", "b"], words)
    found = cut(found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
    return with_next(found, "__id", "a_bits", "__tie", F.lit(200)).select(
        F.col("__id").alias(id),
        "n_chars",
        "edited_sha256",
        as_text(F.col("a_bits")).alias("fingerprint"),
        as_text(F.col("b_bits")).alias("edited_fingerprint"),
        likeness(F.col("a_bits"), F.col("b_bits")).alias("near_edited"),
        likeness(F.col("a_bits"), F.col("next_a_bits")).alias("near_next"),
    )

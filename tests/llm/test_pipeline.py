"""The registered queries of the subpackage, and the pipeline stage by stage."""

import math
import os
import random
from ast import literal_eval

import corpus_pipeline
import duckdb
import pyarrow as pa
import pytest
from test_operators import ALNUM, contamination, documents, near_groups, removed, text_of

import __spark_entry__ as registered
from tessera.llm import quality, queries
from tessera.llm import words as W

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    found = registered.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in found) == 1 for n in range(1, 11)) and "pipeline" in found


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    found = queries.queries()[name](spark, SMALL)
    duck = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    columns = sorted(found.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in found.collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        found = stage(spark, docs, SMALL)
        found.write.parquet(path)
        last, docs = docs, spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before and 0 < docs.count() <= last.count()
    assert docs.select("doc_id").distinct().count() == last.count()
    assert sorted(map(str, docs.drop("sequence_id", "offset").collect())) == sorted(map(str, corpus_pipeline.run(spark, SMALL).drop("sequence_id", "offset").collect()))
    assert os.path.exists(tmp_path / "0")


CLASHING = {"score": "double", "kept": "string", "dedup": "int", "n_words": "long", "items": "array<string>", "spans": "string", "row": "string", "component_id": "long", "contaminated": "boolean", "a.b": "string"}


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Tables with nulls, empty and blank texts, ties, repeated rows, and columns that clash with the operators' names."""
    draw = random.Random(21)
    at = f"file://{tmp_path_factory.mktemp('awkward')}"
    texts = documents(31, 50)
    rows = [*texts, *texts[3:6], (7, "another text under an id that is there"), (None, texts[8][1]), (None, None), (90, texts[9][1])]
    bench = [(f"b{k}", text_of(draw, n, 9999)) for k, n in enumerate((30, 13, 4, 0))] + [("b9", None), (None, "only in null")]
    rows += [(100 + k, " ".join([text_of(draw, 40, 9999), t or "", text_of(draw, n, 9999)])) for k, ((_, t), n) in enumerate([(b, n) for b in bench for n in (0, 5, 900)])]
    rows = [(i, t, "en", "web", None if t is None else len(t), *[None] * len(CLASHING)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` {k}" for c, k in CLASHING.items())
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def plain(df):
    return sorted(str((r.doc_id, r.text, r.n_chars)) for r in df.collect())


def test_stages_against_brute_force(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    rows = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]

    good = corpus_pipeline.keep_good(spark, docs, awkward)
    model = quality.fit(docs, spark.read.parquet(f"{awkward}/labels.parquet"), label="quality")
    want = []
    for i, t, n in rows:
        words = W.find(*W.buffers(pa.array([t or ""])), W.SPACES)
        share = sum(model.weights[k] for k in quality.features(words, model.bits).reshape(-1)) / max(1, len(words)) if len(words) else 0.0
        if 1 / (1 + math.exp(-model.bias - quality.SCALE * share)) >= corpus_pipeline.QUALITY:
            want.append((i, t, n))
    assert good.columns == docs.columns and plain(good) == sorted(map(str, want))

    # The other stages on all rows, so that none is spared by those before it.
    one = corpus_pipeline.keep_one_of_each_group(spark, docs, awkward)
    parts = near_groups([(10**6 if i is None else i, t) for i, t, _ in rows])
    stay = {literal_eval(x)[0] for x in parts if literal_eval(x)[3]}
    assert one.columns == docs.columns and plain(one) == sorted(str(r) for r in rows if (10**6 if r[0] is None else r[0]) in stay)

    less = corpus_pipeline.cut_repeats(spark, docs, awkward)
    want = []
    kept_of = removed_of(rows)
    for i, t, n in rows:
        _, words, gone, kept = literal_eval(kept_of[str((i, t))][0])
        if not gone:
            want.append((i, t, n))
        elif gone < words:
            want.append((i, kept, len(kept)))
    assert less.columns == docs.columns and plain(less) == sorted(map(str, want))

    clean = corpus_pipeline.keep_uncontaminated(spark, docs, awkward)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{awkward}/benchmark.parquet").collect()]
    found = {str((i, t)): literal_eval(x) for i, t, _ in rows for x in contamination([(i, t)], items)}
    got = {(r.doc_id, r.text, r.n_chars) for r in clean.collect()}
    for i, t, n in rows:
        _, words, hit, _ = found[str((i, t))]
        if hit and 20 * hit >= words:
            assert not any(g[0] == i and g[1] == t for g in got)
        elif not hit:
            assert (i, t, n) in got
    touched = [(i, t) for i, t, _ in rows if 0 < 20 * found[str((i, t))][2] < found[str((i, t))][1]]
    for i, t in touched:
        left = [g for g in got if g[0] == i and g[1] != t]
        assert left and all(len(ALNUM.findall(g[1])) == len(ALNUM.findall(t)) - found[str((i, t))][2] and g[2] == len(g[1]) for g in left)
    assert touched and clean.count() == sum(not (h and 20 * h >= w) for _, w, h, _ in (found[str((i, t))] for i, t, _ in rows))


def removed_of(rows):
    """What brute force keeps of each row, by its id and text."""
    out = {}
    for i, t, _ in rows:
        earlier = [(j, u) for j, u, _ in rows if j is not None and (i is None or j < i)]
        out[str((i, t))] = [x for x in removed([*earlier, (i, t)]) if literal_eval(x.replace("inf", "None"))[0] == i]
    return out


def test_pipeline_of_awkward_and_empty_tables(spark, awkward, tmp_path):
    found = corpus_pipeline.run(spark, awkward)
    assert found.count() > 0 and found.columns[:3] == ["doc_id", "piece", "start"]
    at = f"file://{tmp_path}"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{awkward}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    empty = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, at)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.run(spark, at).count() == 0


def test_stages_evaluate_their_functions_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        plan = stage(spark, docs, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") <= 1

"""All opN queries and the pipeline: oracles on test data, odd tables, empty tables."""

import pytest

import __spark_entry__
import corpus_pipeline
from foldmill.llm import queries

from . import tables

SMALL = "/root/testdata/sf0.001"
NAMES = [*queries.QUERIES, "pipeline"]
#: Queries that return one row for each document.
PER_DOCUMENT = [n for n in queries.QUERIES if n.split("_")[0] in ("op3", "op4", "op5", "op6", "op7", "op9", "op10")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables.write(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables.write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in queries.QUERIES}
    assert set(NAMES) <= set(__spark_entry__.queries())
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracle(spark, duck, same_rows, name):
    same_rows(queries.QUERIES[name](spark, SMALL).toPandas(), duck.sql(queries.ORACLES[name]).df())


@pytest.fixture(scope="module")
def odd_but_short(spark, tmp_path_factory):
    """The odd tables with texts of which SQL can list all windows."""
    docs = [(d[0], d[1] and d[1][:4000], *d[2:]) for d in tables.DOCS]
    return tables.write(spark, tmp_path_factory.mktemp("short"), docs)


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_url_filter", "op4_sharding", "op6_quality_rules", "op8_license_scan"])
def test_oracle_on_odd_tables(spark, odd_but_short, name):
    """Nulls, empty texts, repeated rows and clashing columns give the rows that SQL gives."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS FROM '{odd_but_short}/{t}.parquet/*.parquet'")
    expect = con.sql(queries.ORACLES[name])
    out = queries.QUERIES[name](spark, odd_but_short).select(*[f"`{c}`" for c in expect.columns]).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, expect.fetchall()))


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, odd, name):
    out = __spark_entry__.queries()[name](spark, odd).collect()
    if name in PER_DOCUMENT:
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d[0]) for d in tables.DOCS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert __spark_entry__.queries()[name](spark, empty).collect() == []


def test_native_operators_use_no_python(spark):
    for name in ("op1_decontamination", "op2_url_filter", "op8_license_scan"):
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name


def test_pipeline_keeps_columns_and_shrinks(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert len(kept) <= docs.count()
        docs = spark.createDataFrame(kept, out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_by_brute_force(spark):
    """Each stage against plain Python over the same input; then the whole run."""
    import hashlib

    from tokenizers import Tokenizer

    from .brute import contaminated, similar_classes

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        after[name] = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(list(after[name].values()), docs.schema)
    # Fitted stages: prose stays, junk goes.
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    gone = {k: t for k, t in source.items() if k not in after["language_id"]}
    lettered = [t.split() for t in gone.values() if any(c.isalpha() for c in t)]
    # Of texts with letters only such go as say one word over and over.
    assert all(len(set(w)) < 0.2 * len(w) for w in lettered) and len(lettered) <= 0.01 * len(source)
    assert not any(t is None or not any(c.isalpha() for c in t) for t in (r["text"] for r in after["language_id"].values()))
    right = [(k in after["quality_classifier"]) == bool(q) for k, q in labels.items() if k in after["language_id"]]
    assert sum(right) >= 0.97 * len(right)
    # Exact stages.
    before = after["quality_classifier"]
    classes = similar_classes([(k, r["text"]) for k, r in before.items()])
    assert set(after["simhash_dedup"]) == set(classes.values())
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(after["decontamination"]) == {k for k, r in after["simhash_dedup"].items() if not any(contaminated(r["text"], i) for i in items)}
    lib = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    for k, r in after["bpe_encoding"].items():
        ids = lib.encode(source[k], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    run = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, after["bpe_encoding"].values()))

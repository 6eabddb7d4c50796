import ast
import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from cohortline.llm import queries
from cohortline.llm.common import durable, table
from cohortline.llm.simhash import simhash_groups
from tests.compare import connect, differences
from tests.llm.fixtures import SMALL, documents

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.SQL[name]) == []


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_query_has_a_row_per_document(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in table(spark, SMALL, "documents").select("doc_id").collect()}


def test_registered():
    names = contract.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names


def test_stages_keep_the_columns_and_do_their_work(spark):
    docs, rows = documents(spark)
    docs = docs.withColumn("n_chars", docs["doc_id"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "secret scans", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    lined = corpus_pipeline.drop_boilerplate_lines(spark, docs, SMALL)
    assert lined.count() == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lined.select("text", "n_chars").collect())


def test_run_follows_the_stages(spark):
    """The rows of run() are those that each stage alone, checked in its own tests, gives from the one before."""
    docs = table(spark, SMALL, "documents")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    docs = durable(corpus_pipeline.reject_low_quality(spark, docs, SMALL))
    rejected = before - {r.doc_id for r in docs.select("doc_id").collect()}
    low = {r.doc_id for r in queries.op5_nbsvm(spark, SMALL).filter("predicted = 0").collect()}
    assert rejected == low
    docs = durable(corpus_pipeline.drop_boilerplate_lines(spark, docs, SMALL))
    groups = {r.component_id for r in simhash_groups(docs).collect()}
    docs = durable(corpus_pipeline.keep_one_of_near_copies(spark, docs, SMALL))
    assert {r.doc_id for r in docs.select("doc_id").collect()} == groups
    docs = durable(corpus_pipeline.mask_secrets(spark, docs, SMALL))
    want = {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.pack_sequences(spark, docs, SMALL).collect()}
    assert {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SMALL).collect()} == want


def _table(folder, name, columns, rows):
    import pyarrow as pa
    import pyarrow.parquet as pq

    fields = [pa.field(c, t) for c, t in columns]
    arrays = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    pq.write_table(pa.Table.from_arrays(arrays, schema=pa.schema(fields)), f"{folder}/{name}.parquet")


def test_run_bears_odd_and_no_rows(spark, tmp_path):
    """Nulls, repeated rows, clashing columns and an empty table go through run(); what it wrote on the way is gone."""
    import pyarrow as pa

    from cohortline.session import release, written

    names = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    labels = [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]
    _, rows = documents(spark, 120)
    for name, given in (("odd", rows), ("none", [])):
        folder = tmp_path / name
        folder.mkdir()
        _table(folder, "documents", names + [("row", pa.string()), ("score", pa.string()), ("_text", pa.string())],
               [(i, t, None, s, len(t or ""), "x", "y", "z") for i, t, s in given])
        _table(folder, "labels", labels, [(i, n % 2, 0) for n, (i, _, _) in enumerate(given) if n % 3])
        release(spark)
        pieces = corpus_pipeline.run(spark, str(folder))
        found = pieces.collect()
        assert len(written(spark)) <= 4 and (found == []) == (given == [])
        whole = {}
        for r in found:
            whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        assert {i for i, _ in whole} <= {i for i, _, _ in given}
        for (_, tokens), parts in whole.items():
            assert sum(n for _, n in parts) % tokens == 0


def test_nothing_else_needs_the_package():
    root = Path(contract.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" in path.parts or path.name in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or n == "corpus_pipeline" for n in names), path

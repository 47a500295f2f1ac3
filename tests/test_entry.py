import subprocess
import sys

import duckdb

import __spark_entry__ as entry
from lodeweave import plans

DATA = "/root/testdata/sf0.001"


def test_every_query_has_a_name_and_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 60


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "dense_rank", "bm25_rank", "rrf_score", "rerank_score", "final_rank"]


def test_sql_of_the_core_at_the_smallest_scale(spark):
    c = duckdb.connect()
    for t in ("chunks", "customer", "documents", "embedding_records", "embeddings", "events", "legal_metadata_updates", "lineitem", "source_documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("bm25_topk", "dense_topk", "chunk_recursive", "supersession", "claim_verify", "eval_summary", "baseline_compare", "p3_found", "rate_limit"):
        got = plans.queries()[name](spark, DATA)
        want = c.sql(plans.oracle_sql()[name])
        order = [want.columns.index(x) for x in got.columns]
        shown = lambda rows: sorted(tuple("None" if v is None else str(round(float(v), 5)) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
        assert shown(got.collect()) == shown([tuple(r[i] for i in order) for r in want.fetchall()]), name


def test_core_does_not_need_the_subpackage():
    code = "import sys; sys.modules['lodeweave.llm'] = None; import __spark_entry__ as e; assert not any(q.startswith('p2_') for q in e.queries()); assert 'p3_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])

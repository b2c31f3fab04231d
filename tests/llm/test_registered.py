"""The registered queries of this folder: those with a check in SQL against it, the others by their contract."""

import os
import subprocess
import sys
import zlib

import pytest

import __spark_entry__ as entry_points
import verify
from adjudica.llm import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return verify.warehouse(sf_dir)


@pytest.mark.parametrize("name", list(queries.CHECKS))
def test_query_matches_check(spark, con, sf_dir, name):
    status, note = verify.compare(spark, con, name, sf_dir)
    assert status == "same", note


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert {*queries.QUERIES, "pipeline"} <= set(entry_points.queries())


def test_other_queries_survive_a_missing_package():
    code = """
import sys
sys.modules["public_tokenizers"] = None
import __spark_entry__ as e
assert len(e.queries()) > 100 and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry_points.__file__))


@pytest.mark.parametrize("name", ["op2_chat_format", "op4_mixing", "op5_exact_dedup", "op6_topk_search"])
def test_native_plans(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_languages_held_out(spark, con, sf_dir):
    lang = dict(con.execute("select doc_id, lang from documents").fetchall())
    rows = queries.op1_language_id(spark, sf_dir).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)


def test_token_counts(spark, con, sf_dir):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    encode = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode
    want = [(i, len(t.encode()), n := len(encode(t)), n > 4096) for i, t in con.execute("select doc_id, text from documents").fetchall()]
    assert sorted(map(tuple, queries.op3_token_counts(spark, sf_dir).collect())) == sorted(want)


def test_quality_held_out(spark, con, sf_dir):
    label = dict(con.execute("select doc_id, quality from labels").fetchall())
    rows = queries.op10_quality(spark, sf_dir).collect()
    assert len(rows) == con.execute("select count(*) from documents").fetchone()[0]
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in out) >= 0.9 * len(out)

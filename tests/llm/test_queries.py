from __future__ import annotations

from quarrylight.llm import queries


def test_every_query_runs_and_has_its_columns(spark, data):
    expected = {"p1_found": ["file_id", "line_no"], "p2_found": ["file_id"], "p3_found": ["chunk_id_a", "chunk_id_b"], "p4_found": ["symbol_id"], "p5_found": ["chunk_id"], "p8_found": ["doc_id"]}
    for name, query in queries.queries().items():
        df = query(spark, data)
        if name in expected:
            assert df.columns == expected[name] and {t for _, t in df.dtypes} == {"bigint"}
            assert df.count() == df.distinct().count()
        assert df.count() > 0, name

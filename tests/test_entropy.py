import duckdb

from tests.harness import compare
from veilgauge.plans import all_queries


def test_documents_without_text_have_a_row(spark, tmp_path):
    rows = [(1, "aab"), (2, ""), (3, None), (4, " "), (5, "é")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    queries, oracles = all_queries()
    got = {r.doc_id: r.entropy for r in queries["fn_entropy_all"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[2] == 0 and got[3] is None and got[4] == 0 and got[1] > 0
    assert compare(queries["fn_entropy_all"](spark, str(tmp_path)), oracles["fn_entropy_all"], con) is None

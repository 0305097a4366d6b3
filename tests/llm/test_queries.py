"""Registered queries of the corpus operators on tables of their own."""

from motifspark.llm import queries


def test_personal_data_counts(spark, tmp_path):
    rows = [(1, "write to a.b@c.org or 10.0.0.1"), (2, None), (3, "call +1 (555) 010-9999"), (4, 'token = "aB3dE6gH9jK2mN5pQ8sT1vW4"')]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op4_personal_data(spark, str(tmp_path)).collect()}
    assert [(found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone) for i in (1, 2, 3, 4)] == [(1, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0)]
    assert found[1].spans == "email:9:18,ip:22:30" and found[2].spans == ""

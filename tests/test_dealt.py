from vecindario.operators import weights as Wt, windows as Wn
from vecindario.plans import catalog as Q

KEYS = ("doc_id", "line_no", "pos")


def test_terms_of_dealt_lines_are_not_shuffled(spark, tmp_path):
    texts = ["sol mar pan sol luna mar sol", "río sol mar casa pan", None, "", "sol mar pan sol luna mar sol"]
    rows = [(i % 4 or None, t) for i, t in enumerate(texts * 3)]  # ids come twice, and one is null
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    lines = Q.doc_lines(spark, str(tmp_path))
    plain = Wt.hashed_terms(Wn.token_windows(lines), keys=KEYS)
    dealt = Wt.hashed_terms(Wn.token_windows(lines.repartition(5, "doc_id")), keys=KEYS, dealt=True)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect())) and plain.count() > 5
    want = {r["bucket"]: r["df"] for r in Wt.plain_idf(plain, Wn.token_windows(lines)).collect()}
    found = Q.plain_idf(spark, str(tmp_path))
    assert {r["bucket"]: r["df"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert "hashpartitioning(doc_id" in initial and "line_no" not in "".join(
        x.split("hashpartitioning(")[1] for x in initial.split("\n") if "Exchange hashpartitioning(" in x)

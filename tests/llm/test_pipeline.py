import corpus_pipeline
from test_decontaminate import brute as leaks
from test_minhash import brute as near
from test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, spark.createDataFrame(docs.collect(), docs.schema), SF)
        if k == 4:
            from hyperloom.llm.packing import digests

            check(digests(out).collect(), before)
            break
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":
            assert all(before[i] == t for i, t in after.items())
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in after for i in good) >= 0.95 * len(good)
        elif name == "lines":
            for i, t in after.items():
                own, left = before[i].split("\n"), t.split("\n")
                it = iter(own)
                assert all(line in it for line in left)  # lines in order, none new
        elif name == "near duplicates":
            groups = near(list(before.items()))
            assert set(after) == {i for i, (_, _, kept) in groups.items() if kept}
        elif name == "decontamination":
            assert set(after) == set(before) - {d for d, _ in leaks(bench, list(before.items()))}
        before = after


def test_run_is_its_stages(spark):
    first, again = (sorted((r["doc_id"], r["start"], r["length"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first and first == again


def test_stages_take_odd_rows(spark, docs, clashing):
    odd = clashing(docs([(1, None), (2, ""), (None, "a b c"), (3, "x " * 50_000), (3, "x " * 50_000), (4, "plain words stand here")]))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_columns_of_any_name_pass_through(spark, docs):
    from pyspark.sql import functions as F

    names = ["before", "lines", "dropped", "n_lines", "n_dropped", "__copy", "__drop", "__before", "copy", "gone", "leaky", "row", "count"]
    own = lambda i: " ".join("abcdefgh"[i] * k for k in range(1, 12)) + "\nread more here"
    df = docs([(i, own(i)) for i in range(8)] + [(3, own(3))]).withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES[:4]:
        df = spark.createDataFrame(stage(spark, df, SF).collect(), df.schema)
        assert all(r[n] == n for r in df.collect() for n in names)
    assert sorted(r["doc_id"] for r in df.collect()) == list(range(8)) and df.where("text like '%read more here'").count() == 1


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)

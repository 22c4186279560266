"""Every stage on its own input, and the registered queries."""

import re


def test_stages(spark, folder, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(P.STAGES):
        given = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
            assert {r["doc_id"] for r in out.collect()} <= set(given)
            before = out.count()
        else:
            assert {r["doc_id"] for r in out.collect()} == set(given) and before == len(given)
        docs = out
    assert [n for n, _ in P.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]


def test_near_duplicate_stage_against_all_pairs(spark, folder):
    import corpus_pipeline as P
    from test_links import classes, plain_links, plain_set

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sets = {r["doc_id"]: plain_set(r["text"]) for r in docs.collect()}
    roots = classes(sets, plain_links(sets, 80))
    kept = {r["doc_id"] for r in P.near_duplicates(spark, docs, folder).collect()}
    assert kept == {i for i in sets if roots[i] == i}


def test_decontamination_stage_against_plain_search(spark, folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    goals = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in items]

    def leaked(text):
        w = re.findall(r"\w+", (text or "").lower())
        have = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        return any(len(g & have) >= 0.8 * len(g) for g in goals)

    kept = {r["doc_id"] for r in P.not_leaked(spark, docs, folder).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if not leaked(r["text"])}


def test_pipeline_of_an_empty_table(spark, folder, make):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_queries_are_registered_once():
    import __spark_entry__ as E

    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()

"""Trained operators by held-out accuracy, and the host filter by plain arithmetic."""

import math
import zlib

import numpy as np
import pytest


def crc(i):
    return zlib.crc32(str(i).encode())


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_language_of_held_out_documents(spark):
    from treesift.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in table(spark, folder, "documents").select("doc_id", "lang").collect()}
    rows = QUERIES["op8_language_id"](spark, folder).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if crc(i) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.01
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark, make):
    from treesift.llm import language_id as L

    texts = ["the cat and the dog went home", "der hund und die katze gehen heim"] * 20
    model = L.train(texts, ["en", "de"] * 20)
    rows = {r["doc_id"]: r for r in L.predict(make([(1, None), (2, ""), (3, "12 _ !"), (4, "The DOG"), (None, "die katze"), (5, "the dog " * 150_000)]), model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4, None, 5)] == ["und", "und", "und", "en", "de", "en"]
    assert rows[1]["rejected"] and rows[1]["score"] == 0
    assert L.predict(make([]), model).count() == 0
    docs = make([(1, None), (4, "the dog"), (4, "the dog")])
    kept = L.known_languages(docs, model)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [4, 4]
    nothing = L.train([], [])
    assert [r["lang_pred"] for r in L.predict(make([(1, "the dog")]), nothing).collect()] == ["und"]


def test_language_rejects_what_it_never_saw():
    from treesift.llm import language_id as L

    texts = ["the cat and the dog went home", "der hund und die katze gehen heim"] * 20
    model = L.train(texts, ["en", "de"] * 20)
    logits = L._Scorer(model).logits("привет мир как дела")
    assert L._softmax(logits / model.temperature).max() < 0.9


def test_toxicity_of_held_out_documents(spark):
    from treesift.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}
    rows = QUERIES["op1_toxicity"](spark, folder).where("held_out").collect()
    scored = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in truth]
    assert np.mean([p == t for _, t, p in scored]) > 0.97
    assert sum(p for _, t, p in scored if t) / sum(t for _, t, _ in scored) > 0.85


@pytest.mark.xfail(reason="6 of the 97 held-out toxic rows are texts whose words were replaced by junk: at most 0.969")
def test_toxicity_order_of_held_out_documents(spark):
    from treesift.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}
    rows = QUERIES["op1_toxicity"](spark, folder).where("held_out").collect()
    scored = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in truth]
    bad, good = [s for s, t, _ in scored if t], [s for s, t, _ in scored if not t]
    assert np.mean([x > y for x in bad for y in good]) > 0.97


def test_gapped_insults(spark, make):
    from treesift.llm import toxicity as T

    rng = np.random.default_rng(1)
    plain = [" ".join("".join(rng.choice(list("aeioustrlnm"), int(rng.integers(2, 9)))) for _ in range(60)) for _ in range(300)]
    texts, labels = [], []
    for k, text in enumerate(plain):
        toxic = k % 3 == 0
        texts.append(text + (" you grubling" if k % 2 else " what a Wexhead!") if toxic else text)
        labels.append(int(toxic))
    model = T.train(texts, labels)
    rows = [(1, "x grubling"), (2, "a g.r.u.b.l.i.n.g b"), (3, "a g r u b l i n g b"), (4, "gru-bling"), (5, "x grubxling"), (6, plain[4]), (7, None), (8, ""), (None, "12"), (9, plain[5] * 50)]
    scores = {r["doc_id"]: r["score"] for r in T.score(make(rows), model).collect()}
    assert all(scores[i] > 0.5 for i in (1, 2, 3, 4)) and scores[5] > scores[6]
    assert all(scores[i] < 0.5 for i in (6, 7, 8, None)) and scores[7] == scores[8]
    assert all(0 <= s <= 1 for s in scores.values())
    docs = make([(1, "x grubling"), (2, None)])
    kept = T.without_toxic(docs, model)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert T.score(make([]), model).count() == 0
    assert T.score(make(rows), T.train([], [])).where("score <> 0").count() == 0


def test_kernel_against_its_definition():
    from itertools import combinations

    from treesift.llm import toxicity as T

    def plain(s, t):
        def maps(u):
            out = {}
            for a, b, c in combinations(range(len(u)), 3):
                if c - a < T.SPAN and all(T.code_of(u[x]) for x in (a, b, c)):
                    key = (T.code_of(u[a]), T.code_of(u[b]), T.code_of(u[c]))
                    out[key] = out.get(key, 0) + T.DECAY ** (c - a + 1)
            return out

        x, y = maps(s), maps(t)
        dot = sum(v * y.get(k, 0) for k, v in x.items())
        return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    units = ["banana", "bandana", "b-a-n-a-n-a", "cabana", "aaaaaaaaaaaa"]
    got = T.kernel_columns(units, units)
    assert np.allclose(got, [[plain(s, t) for t in units] for s in units], atol=1e-6)


def test_licence_paragraphs(spark, make, folder):
    from treesift.llm import licence_scan as S
    from treesift.llm.licence_templates import NO_LICENCE, TEMPLATES

    rng = np.random.default_rng(2)
    noise = [(1000 + k, " ".join(f"and{int(x)} the of" for x in rng.integers(0, 50, 20))) for k in range(300)]
    cases = [(k, f"Some words.\n  {t.upper() if k % 2 else t} \nMore words.") for k, (_, _, t) in enumerate(TEMPLATES)]
    refused = [(500 + k, t) for k, t in enumerate(NO_LICENCE)]
    odd = [(900, None), (901, ""), (902, "\n\n"), (None, "Released under the MIT License."), (903, "Released under the MIT License.\n" * 2 + "word " * 200_000)]
    docs = make(noise + cases + refused + odd + odd[-1:])
    rows = S.scan(docs, S.fit(docs)).collect()
    found = {(r["doc_id"], r["paragraph"]): r for r in rows}
    for k, (family, _, _) in enumerate(TEMPLATES):
        assert found[k, 1]["family"] == family and found[k, 1]["confirmed"], TEMPLATES[k]
    assert {r["doc_id"] for r in rows if r["confirmed"]} == set(range(len(TEMPLATES))) | {None, 903}
    assert len(rows) == len(found) and {p for i, p in found if i == 903} == {0, 1}
    assert not {r["doc_id"] for r in rows} & {i for i, _ in noise}
    assert S.scan(make([]), S.fit(make([]))).count() == 0


def test_licence_anchors_do_not_depend_on_the_corpus(spark, make):
    from treesift.llm import licence_scan as S

    footer = "Text is available under the Creative Commons Attribution-ShareAlike License"
    docs = make([(k, footer if k % 3 == 0 else f"and{k % 50} the of plain words") for k in range(600)] + [(1000, "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.")])
    model = S.fit(docs)
    assert {"creative", "commons", "attribution", "sharealike"} <= set(model.anchors)
    rows = S.scan(docs, model).collect()
    assert [(r["family"], r["confirmed"]) for r in rows if r["doc_id"] == 1000] == [("cc-by-sa", True)]
    assert {r["doc_id"] for r in rows if r["family"] == "cc-by-sa"} == {1000, *range(0, 600, 3)}


@pytest.mark.parametrize("seed", range(4))
def test_licence_footer_in_any_corpus(spark, make, seed):
    from treesift.llm import licence_scan as S

    footer = "Text is available under the Creative Commons Attribution-ShareAlike License"
    rng = np.random.default_rng(seed)
    plain = [" ".join(f"word{int(x)}" for x in rng.integers(0, [30, 300, 3000, 9][seed], 15)) for _ in range(200)]
    docs = make([(k, f"{t}\n{footer if k % 4 == 0 else t}") for k, t in enumerate(plain)])
    rows = S.scan(docs, S.fit(docs)).collect()
    assert {(r["doc_id"], r["paragraph"]) for r in rows if r["family"] == "cc-by-sa"} == {(k, 1) for k in range(0, 200, 4)}
    assert {r["family"] for r in rows} == {"cc-by-sa"}


@pytest.mark.parametrize("mark", ["# ", " * "])
def test_wrapped_licence_headers(spark, make, mark):
    import textwrap

    from treesift.llm import licence_scan as S
    from treesift.llm.licence_templates import TEMPLATES

    rng = np.random.default_rng(3)
    noise = [(1000 + k, " ".join(f"and{int(x)} the of" for x in rng.integers(0, 50, 20))) for k in range(300)]
    long = [x for x in TEMPLATES if len(x[2]) > 76]
    cases = []
    for k, (_, _, t) in enumerate(long):
        rows = ["int main;", "", "Copyright (c) 2020 Someone", *textwrap.wrap(t, 70), "", "More words."]
        cases.append((k, "\n".join((mark + r).rstrip() for r in rows)))
    docs = make(noise + cases)
    rows = [r for r in S.scan(docs, S.fit(docs)).collect() if r["confirmed"]]
    assert {(r["doc_id"], r["paragraph"], r["family"], r["template"]) for r in rows} == {
        (k, 3, family, name) for k, (family, name, _) in enumerate(long)
    }
    assert len(rows) == len(long)


def test_licence_scan_runs_no_python(spark, folder):
    from treesift.llm.queries import QUERIES

    plan = QUERIES["op3_licence_scan"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_digamma_and_bounds(spark):
    from pyspark.sql import functions as F

    from treesift.llm.host_reputation import _digamma, _trigamma

    row = spark.range(1).select(_digamma(F.lit(0.5)).alias("d"), _trigamma(F.lit(0.5)).alias("t")).first()
    assert math.isclose(row["d"], -1.9635100260214235, rel_tol=1e-6)
    assert math.isclose(row["t"], math.pi**2 / 2, rel_tol=1e-5)


def test_hosts(spark):
    from treesift.llm.host_reputation import Rule, judged

    rows, outcomes, i = [], [], 0
    for host, bad, good in (("good.example.com", 2, 200), ("bad.example.com", 90, 10), ("small.example.com", 2, 0), ("worse.spam.net", 40, 2), ("new.spam.net", 0, 0), ("calm.org", 1, 120), ("a.b.co.uk", 3, 60)):
        for k in range(bad + good + 1):
            i += 1
            rows.append((i, f"https://{host.upper()}/en/{k}?q#f"))
            if k:
                outcomes.append((i, int(k <= bad)))
    urls = ["http://x.example.com/en/1", "http://www.example.com/en/1", "http://example.com", "no scheme", None, "ftp://EXAMPLE.com?x/y", "a://b://c/d", "http://notexample.com/en/1"]
    rows += [(10_000 + k, u) for k, u in enumerate(urls)] + [(None, "http://calm.org/x"), (1, rows[0][1])]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id bigint, url string, host string, low string")
    known = spark.createDataFrame(outcomes + [(None, 1), (2, 0)], "page_id bigint, bad int")
    rules = [Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/")]
    found = judged(pages, known, rules).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    assert [(by[10_000 + k]["host"], by[10_000 + k]["path"], by[10_000 + k]["rule"]) for k in range(len(urls))] == [
        ("x.example.com", "/en/1", "example.com/en/"),
        ("www.example.com", "/en/1", "www.example.com/en/"),
        ("example.com", "", None),
        ("", "", None),
        ("", "", None),
        ("example.com", "", None),
        ("b:", "//c/d", None),
        ("notexample.com", "/en/1", "com/"),
    ]
    plain = {r["host"]: r for r in judged(pages, known, []).collect()}
    assert plain["bad.example.com"]["verdict"] == plain["worse.spam.net"]["verdict"] == "block"
    assert plain["good.example.com"]["verdict"] == plain["calm.org"]["verdict"] == plain["small.example.com"]["verdict"] == "allow"
    assert plain["new.spam.net"]["verdict"] == "allow"  # a bad domain alone is no bound
    assert judged(pages.limit(0), known, rules).count() == 0
    assert {r["verdict"] for r in judged(pages, known.limit(0), []).collect()} == {"allow"}


def test_training_samples_are_bounded(spark, make):
    from pyspark.sql import functions as F

    from treesift.llm.sampling import sample_by_class, sampled_texts

    docs = make([(k, f"t{k}") for k in range(3000)]).select(F.col("doc_id").alias("id"), "text")
    keys = docs.select("id", (F.col("id") % 7 == 0).alias("label"))
    sample = sample_by_class(keys, 100, "s")
    sizes = [sum(y == c for _, y in sample) for c in (True, False)]
    assert all(80 <= s <= 100 for s in sizes)
    assert sample == sample_by_class(keys.repartition(7), 100, "s")
    assert sorted(sampled_texts(docs, sample)) == sorted((f"t{i}", y) for i, y in sample)


@pytest.mark.parametrize("a,b", [(2.0, -1.0), (0.5, 3.0)])
def test_platt(a, b):
    from treesift.llm.sampling import platt

    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, 20_000)
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-(a * x + b)))).astype(float)
    got = platt(x, y)
    assert abs(got[0] - a) < 0.15 and abs(got[1] - b) < 0.2


def test_letterless_texts_are_undetermined(spark, make):
    from treesift.llm import language_id as L

    model = L.train(["the house and the garden"] * 20 + ["das haus und der garten"] * 20, ["en"] * 20 + ["de"] * 20)
    rows = [(1, "² ½ 123"), (2, "Ⅷ ③ ٣"), (3, "the garden²"), (4, "12_34"), (5, None)]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(make(rows), model).collect()}
    assert all(found[i] == ("und", 0.0) for i in (1, 2, 4, 5)) and found[3][0] == "en"


def test_sampling_is_bounded_by_ids(spark):
    from treesift.llm.sampling import sample_by_class, sampled_texts

    docs = spark.createDataFrame([(1, f"text {k}", "a") for k in range(500)] + [(2, "x" * 120_000, "b"), (3, None, "b")], "id bigint, text string, label string")
    sample = sample_by_class(docs.select("id", "label"), 10, "s")
    assert sorted(sample) == [(1, "a"), (2, "b"), (3, "b")]
    got = sorted(sampled_texts(docs.select("id", "text"), sample))
    assert got == [("text 0", "a"), ("x" * 50_000, "b")]


def test_insults_split_over_words(spark, make):
    from treesift.llm import toxicity as T

    rng = np.random.default_rng(1)
    plain = [" ".join("".join(rng.choice(list("aeioustrlnm"), int(rng.integers(2, 9)))) for _ in range(60)) for _ in range(300)]
    texts = [t + (" you grubling" if k % 2 else " what a Wexhead!") if k % 3 == 0 else t for k, t in enumerate(plain)]
    model = T.train(texts, [int(k % 3 == 0) for k in range(300)])
    rows = [(1, "a gru bling"), (2, "g  r  u  b  l  i  n  g"), (3, "the wex head"), (4, "gr\tubling"), (5, plain[7])]
    scores = {r["doc_id"]: r["score"] for r in T.score(make(rows), model).collect()}
    assert all(scores[i] > 0.5 for i in (1, 2, 3, 4)) and scores[5] < 0.5


def test_near_copies_teach_once():
    from treesift.llm import toxicity as T

    base = " ".join(f"w{k}" for k in range(200))
    texts = [base, base + " more", "other words here", base, ""]
    assert T.unlike(texts, [1, 1, 1, 0, 0]) == [0, 2, 3, 4]

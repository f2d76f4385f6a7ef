"""Core operators on small frames, against values worked out by hand or by plain Python."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import metadata as M
from quire.functions import text as T
from quire.operators import exports, ingest, jobs, library, retrieval, taxonomy, vectors
from quire.operators.components import components


def value(spark, column, **cols):
    row = spark.range(1)
    for name, v in cols.items():
        row = row.withColumn(name, F.lit(v))
    return row.select(column.alias("v")).first()["v"]


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, None), (5, 5), (300, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_terms_and_coverage(spark):
    assert value(spark, T.query_terms("t"), t="The follow-up, the FOLLOW-UP a x's") == ["the", "follow-up", "x's"]
    assert value(spark, T.content_terms("t"), t="The paper about airway stents") == ["airway", "stents"]
    assert value(spark, T.fts_query("t"), t="air ways") == '"air" OR "ways"*'
    assert value(spark, T.fts_query("t"), t=None) == '""'
    assert value(spark, T.coverage("airway stents", "t"), t="one stent in an airways model") == 1.0
    assert value(spark, T.coverage("airway stents", "t"), t=None) == 0.0


@pytest.mark.parametrize(("text", "near"), [("airway stent", True), ("airway " + " ".join(f"w{i}" for i in range(30)) + " stent", False), ("airway only", False), ("", False)])
def test_terms_within_window(spark, text, near):
    assert value(spark, T.within_window(["airway", "stent"], "t", 12), t=text) is near
    assert value(spark, T.lexical_evidence("airway stent", "t"), t=text) is near


def test_numbers(spark):
    text = "In 2019, 218 patients; severe bleeding 1.4 % and five percent, v1.2.3"
    assert value(spark, T.percentages("t"), t=text) == [1.4, 5.0]
    assert value(spark, T.plain_numbers("t"), t=text) == [218.0]
    want = (math.exp(-0.9 * math.log(1.4)) + math.exp(-0.9 * math.log(218 / 200))) / 2
    assert value(spark, T.numeric_bonus([1.0], [200.0], "t"), t="218 patients, 1.4%") == pytest.approx(want)
    assert value(spark, T.numeric_bonus([0.0], [], "t"), t="0% of all") == 1.0
    assert value(spark, T.lexical_evidence("around 200 patients severe bleeding trial", "t", [], [200.0]), t="218 patients had bleeding") is True


def test_passages_and_snippets(spark):
    assert value(spark, T.is_reference_passage("t"), t="text\nReferences\n1. x") is True
    assert value(spark, T.is_reference_passage("t"), t="2001;3:4 then 2002;5(1):6 and 1999") is True
    assert value(spark, T.is_back_matter("t"), t="Declaration  of\ninterest: none") is True
    long = "word " * 200 + "needle " + "tail " * 200
    cut = value(spark, T.snippet("needle", "t"), t=long)
    assert "needle" in cut and len(cut) <= 480 and cut in long
    assert value(spark, T.snippet("needle", "t"), t=" short ") == "short"
    assert value(spark, T.truncate("t", 10), t="abcdefghijkl") == "abcdefghi…"
    assert value(spark, T.slug("t"), t="Évolution: a Study!") == "evolution-a-study"


def test_bm25_equals_formula(spark):
    texts = ["airway stent stent", "airway", "other words here", None, "stents in airway airway"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(rows, "airway stent", "body").collect()}
    tokens = [(t or "").split() for t in texts]
    mean = sum(map(len, tokens)) / len(tokens)
    for i, words in enumerate(tokens):
        score = 0.0
        for term in ("airway", "stent"):
            f = [sum(w.startswith(term) for w in ws) for ws in tokens]
            n = sum(x > 0 for x in f)
            score += max(math.log((5 - n + 0.5) / (n + 0.5)), 1e-6) * f[i] * 2.2 / (f[i] + 1.2 * (0.25 + 0.75 * len(words) / mean))
        assert got.get(i, 0.0) == pytest.approx(score)
    assert retrieval.bm25(rows, "the", "body").count() == 0


def test_fusion_and_roll_up(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = {r["id"]: r["fused"] for r in retrieval.fuse([(a, 1.0), (b, 0.5)], ["id"]).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 0.5 / 61, 3: 0.5 / 62})
    hits = spark.createDataFrame([(1, 3, 2.0), (1, 1, 2.0), (1, 2, 1.0)], "doc long, page int, score double")
    assert tuple(retrieval.roll_up(hits, "doc", "page").first()) == (1, 1, 2.0, 3)


def test_neighbours_equal_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(50)] + [(50, [0.0] * 6), (51, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in vectors.neighbours(frame, frame.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    live = {i: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v] for i, v in frame.where("embedding is not null").collect()}
    for q in (0, 20, 40):
        ranked = sorted(live, key=lambda i: (-round(sum(a * b for a, b in zip(live[q], live[i], strict=True)), 12), i))
        assert [i for _, i in sorted(got[q])] == [i for i in ranked if i != q][:5]
    assert vectors.neighbours(frame.limit(0), frame.limit(0)).count() == 0


def test_library_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    assert sorted(map(tuple, library.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, library.insert_new(old, new.union(new), ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    wanted = spark.createDataFrame([(1,), (3,), (3,)], "id long")
    assert tuple(library.bulk_add(old, wanted, wanted, ["id"], "id").first()) == (2, 1, 1, 0)
    assert tuple(library.bulk_add(old, wanted, old, ["id"], "id").first()) == (2, 0, 1, 1)
    docs = spark.createDataFrame([(1, None, 2000), (2, datetime(2024, 1, 1), 2001)], "doc_id long, deleted_at timestamp, publication_year int")
    assert [r["doc_id"] for r in library.search_filter(docs, year_min=1990).collect()] == [1]
    assert library.search_filter(docs, ids=docs.limit(0).select("doc_id")).count() == 0


def test_chunks_and_layout(spark):
    text = "First sentence here. " * 40
    pieces = ingest.cut_text(text, 200, 40)
    assert all(len(p) <= 200 for p in pieces) and pieces[0].endswith(".") and ingest.cut_text(None, 200, 40) == []
    frame = spark.createDataFrame([(1, "x" * 1300), (2, ""), (3, None)], "id long, body string")
    assert [(r["chunk_no"], len(r["chunk"])) for r in ingest.fixed_windows(frame, "id", "body").orderBy("chunk_no").collect()] == [(0, 600), (1, 600), (2, 260)]
    blocks = [(1, n, x0, y, x1, y + 5.0, 100.0) for n, x0, x1, y in (("title", 5.0, 95.0, 0.0), ("l1", 5.0, 45.0, 10.0), ("r1", 55.0, 95.0, 10.0), ("l2", 5.0, 45.0, 20.0), ("r2", 55.0, 95.0, 20.0))]
    ordered = ingest.reading_order(spark.createDataFrame(blocks, "page int, name string, x0 double, y0 double, x1 double, y1 double, width double"), ["page"])
    assert [r["name"] for r in ordered.orderBy("position").collect()] == ["title", "l1", "l2", "r1", "r2"]
    lines = [(1, p, line) for p in range(1, 5) for line in (f"Journal {p}", f"body {'abcd'[p - 1]}")]
    assert [tuple(r) for r in ingest.repeated_margins(spark.createDataFrame(lines, "document_id long, page_number int, line string")).collect()] == [(1, "journal #", 4)]


def test_states_and_conflicts(spark):
    lit = lambda *v: ingest.review_state(*[F.lit(x) for x in v])
    assert value(spark, lit(True, False, True, False, False)) == "possible_duplicate"
    assert value(spark, lit(True, True, True, True, True)) == "needs_ocr"
    assert value(spark, lit(False, False, False, False, False)) == "ready"
    pairs = spark.createDataFrame([(1, " A ", "a", 2000, 2001)], "id long, t_a string, t_b string, y_a int, y_b int")
    assert [tuple(r) for r in ingest.conflicts(pairs, "id", ["t", "y"]).collect()] == [(1, "y", "2000", "2001")]


def test_exports(spark):
    frame = spark.createDataFrame([("Eapen, George; Ann Lee and Bo", 2010, "50% of {all} A&B", None, "10.1/x")], "authors string, publication_year int, title string, journal string, doi string")
    record = frame.select(exports.bibtex().alias("r")).first()["r"]
    assert record.startswith("@article{eapen201050,") and "author = {Eapen, George and Ann Lee and Bo}" in record and r"50\% of \{all\} A\&B" in record and "journal" not in record
    assert frame.select(exports.ris().alias("r")).first()["r"].split("\n")[1:4] == ["AU  - Eapen, George", "AU  - Ann Lee", "AU  - Bo"]
    assert value(spark, exports.markdown_row("a", "b"), a="x|y_z", b=None) == r"| x\|y z |  |"
    assert 'coords="1.0000,2.5000"' in spark.createDataFrame([(1, [1.0, 2.5], "a<b")], "page int, quad array<double>, t string").select(exports.xfdf_highlight("page", "quad", "t").alias("x")).first()["x"]


def test_metadata(spark):
    assert value(spark, M.doi_in("t"), t="see https://doi.org/10.1234/AB.c). then") == "10.1234/ab.c"
    assert value(spark, M.pmid_in("t"), t="PMID: 12345678") == "12345678"
    assert value(spark, M.source_type("a", "b"), a="A randomised trial", b=None) == "randomized_trial"
    assert value(spark, M.plausible_title("t"), t="Editorial") is False


def test_jobs(spark):
    t0 = datetime(2024, 1, 1)
    log = [(1, 1, "start", t0), (2, 1, "failure", t0 + timedelta(minutes=1)), (3, 1, "start", t0 + timedelta(minutes=2)), (4, 1, "success", t0 + timedelta(minutes=3)), (5, 2, "start", t0)]
    got = {r["job"]: (r["status"], r["attempts"]) for r in jobs.job_states(spark.createDataFrame(log, "event_id long, job long, kind string, at timestamp"), "job", "kind", "at", "event_id").collect()}
    assert got == {1: ("succeeded", 2), 2: ("running", 1)}
    ticks = [(i, "p", t0 + timedelta(seconds=s)) for i, s in enumerate((0, 4, 9, 10, 19, 21))]
    kept = jobs.throttled(spark.createDataFrame(ticks, "event_id long, path string, ts timestamp"), "path", "ts", 10)
    assert sorted(r["event_id"] for r in kept.collect()) == [0, 3, 5]
    assert value(spark, jobs.progress(F.lit(5), F.lit(0))) == 0.0 and value(spark, jobs.progress(F.lit(5), F.lit(4))) == 1.0


def test_taxonomy(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 1), ("c", 2), ("d", 1)], "id string, v int")
    assert {r["id"]: r["action"] for r in taxonomy.install_plan(old, new, "id", ["v"]).collect()} == {"a": "retire", "b": "keep", "c": "update", "d": "insert"}
    was = spark.createDataFrame([("a", True, 1), ("b", False, 1)], "id string, locked boolean, v int")
    got = {r["id"]: (r["v"], r["changed"]) for r in taxonomy.protected_upsert(was, spark.createDataFrame([("a", 9), ("b", 9), ("c", 9)], "id string, v int"), ["id"], "locked", "v").collect()}
    assert got == {"a": (1, False), "b": (9, True), "c": (9, True)}


def test_metadata_of_first_pages(spark):
    head = "Thorax 2014; 69: 1\nPublished online 3 May 2015\nABSTRACT: Sleep was\nbetter.\nMethods\nWe slept. copyright 2016"
    pages = [(1, 1, head), (1, 2, "text"), (2, 1, "doi: 10.1234/a1\nfirst"), (2, 2, "Abstract:\ndoi: 10.1234/b2"), (3, 1, "doi: 10.1234/a1"), (3, 2, "Abstract\ndoi: 10.1234/A1."), (4, 1, "in 2011 copyright 2090, (2012) 7-9"), (4, 2, "see doi: 10.1234/c3")]
    frame = spark.createDataFrame(pages, "document_id long, page_number int, text string")
    rows = ingest.first_pages(frame, 2).select("document_id", M.publication_year("head", F.lit(2031)).alias("y"), M.journal_in("head").alias("j"), M.abstract_in("head").alias("a")).collect()
    got = {r["document_id"]: (r["y"], r["j"], r["a"]) for r in rows}
    assert got[1] == (2014, "Thorax", "Sleep was better.") and got[4] == (2012, "", "") and got[3][0] is None
    assert {tuple(r) for r in ingest.multi_articles(frame).collect()} == {(1, False), (2, True), (3, False), (4, False)}


def test_passages_are_fused_over_survivors(spark):
    rows = [(1, 1, "References\nsevere bleeding", 9.0), (1, 2, "severe bleeding in 5% of cases", 8.0), (2, 1, "severe pain", 7.0), (3, 1, "bleeding that was severe", 6.0)]
    found = retrieval.fused_passages(spark.createDataFrame(rows, "d int, p int, text string, score double"), "severe bleeding", "text", ["d", "p"], [5.0])
    got = {(r["d"], r["p"]): r["score"] for r in found.collect()}
    assert set(got) == {(1, 2), (3, 1)}
    assert got[(1, 2)] == pytest.approx(1 / 61 + 0.5 / 62 + 1 / 61)
    final = retrieval.final_documents(found, spark.createDataFrame([(7, 1 / 61)], "d int, fused double"), "d", "p", 10).collect()
    assert final[0]["d"] == 1 and [r["reasons"] for r in final if r["d"] == 7] == [["related library metadata"]]


def test_positions_equal_a_window(spark):
    """Numbering over range partitions gives what one window gives, with ties, nulls and a hot group."""
    rnd = random.Random(3)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", rnd.choice([None, 1, 2, 3])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, g string, v int")
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    got = {tuple(r) for r in library.positions(frame, ["g"], order).select("id", "position").collect()}
    want = {tuple(r) for r in frame.select("id", F.row_number().over(Window.partitionBy("g").orderBy(*order)).alias("position")).collect()}
    assert got == want and library.positions(frame.limit(0), ["g"], order).count() == 0


def test_indexed_scores_equal_scanned_ones(spark, tmp_path):
    rows = [(1, "Iron therapy for anaemia; iron again"), (2, "iron"), (2, "iron"), (3, None), (4, ""), (5, "nothing of it"), (6, "Ironing and therapy")]
    frame = spark.createDataFrame(rows, "id long, text string")
    path = retrieval.write_index(frame, ["id"], "text", f"file://{tmp_path}/index")
    for query in ("iron therapy", "the", "of anaemia"):
        scanned = sorted((r["id"], round(r["score"], 9)) for r in retrieval.bm25(frame, query, "text").collect())
        assert sorted((r["id"], round(r["score"], 9)) for r in retrieval.bm25_indexed(spark, path, query).collect()) == scanned


def test_inverted_file_recalls_nine_in_ten(spark, data):
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    queries = frame.where("vec_id % 20 = 0")
    exact = vectors.neighbours(frame, queries, 10)
    found = vectors.recall_at(vectors.approximate(frame, queries, 10), exact, 1, 10).collect()
    assert all(r["recall"] >= 0.9 for r in found)
    whole = vectors.approximate(frame, queries, 10, share=1.0)
    assert {(r["query_id"], r["id"], r["rank"]) for r in whole.collect()} == {(r["query_id"], r["id"], r["rank"]) for r in exact.collect()}


def test_merge_and_topic(spark):
    row = spark.createDataFrame([(1, ("Title", None), ("", "x")), (2, ("Title", "x"), (None, "x"))], "id long, a struct<t:string,j:string>, b struct<t:string,j:string>")
    assert [(r["t"], r["j"], r["revision"]) for r in library.merged(row, "a", "b", ["t", "j"]).orderBy("id").collect()] == [("Title", "x", 2), ("Title", "x", 1)]
    frame = spark.createDataFrame([("bronchoscopy in pregnancy",), ("bronchoscopy " + " ".join(f"w{i}" for i in range(40)) + " pregnancy",), ("bronchoscopy only",), (None,)], "t string")
    assert [r[0] for r in frame.select(T.topic_matches("bronchoscopy pregnancy", "t")).collect()] == [True, False, False, False]
    page = spark.createDataFrame([("My Title\nA. Eapen\n\nAbstract\nEapen is cited", "my title")], "p string, h string")
    assert page.select(T.author_zone("p", "h")).first()[0].strip() == "A. Eapen"

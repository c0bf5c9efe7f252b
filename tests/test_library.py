"""Registered queries against DuckDB, and operators against hand-made rows."""

from __future__ import annotations

import duckdb
import pytest

from gleaner import schema
from gleaner.functions import folding, text
from gleaner.operators import answers, corpus, planner, search, steps
from gleaner.plans import flagship, library
from gleaner.sources import corpus as corpus_source
from gleaner.sources import html, records
from gleaner.sources import text as text_source
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_against_sql(spark, duck, name):
    got = library.QUERIES[name](spark, DATA)
    cur = duck.execute(library.ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = sorted((tuple(plain(x) for x in r) for r in cur.fetchall()), key=str)
    assert set(cols) == set(got.columns)
    assert sorted((tuple(plain(x) for x in r) for r in got.select(*cols).collect()), key=str) == want


def test_flagship(spark):
    assert flagship.run(spark, DATA).count() > 0


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_folding(spark):
    assert one(spark, folding.ascii_key, "  Étage n°2 — cœur Straße ﬁn ") == "etage n2 cur strae fin"  # what has no ASCII form leaves no gap
    assert one(spark, folding.phrase_key, "Straße, ÉTÉ!") == "strasse ete"
    assert one(spark, folding.question_fold, " Où  est-ce ?  ") == "ou est-ce ?"
    assert one(spark, folding.clean_lines, "\n a \t b\r\n\r\n\r\nc\x00 \nPowered by TCPDF (www.tcpdf.org)\n") == "a b\n\nc"
    assert one(spark, folding.slug, "Réserver — la chambre!") == "reserver-la-chambre"
    assert one(spark, folding.spatial_terms, "en haut à GAUCHE") == ["left", "top"]


def test_uuid5(spark):
    import uuid

    assert one(spark, text.uuid5, "doc-1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc-1"))


@pytest.mark.parametrize(("question", "fee"), [("départ à 14h30 ?", 70), ("14h00", 50), ("12h", 15), ("10h30", None), ("17h01", None), ("sans heure", None)])
def test_fee(spark, question, fee):
    assert one(spark, lambda c: text.late_checkout_fee(text.question_time(c)), question) == fee


def test_chunks(spark):
    rows = [("d", "s", "official_doc", "First paragraph.\n\nSecond one here.", "b"), ("q", "s", "qa", "x" * 90, "b"), ("l", "s", "official_doc", "y" * 60 + ". " + "z" * 10, None)]
    df = spark.createDataFrame(rows, "id string, source_id string, source_type string, content string, breadcrumb string")
    got = corpus.chunk(df, {"official_doc": 25}).orderBy("parent_document_id", "chunk_index").collect()
    assert [(r["parent_document_id"], r["chunk_index"], r["chunk_count"]) for r in got] == [("d", 1, 2), ("d", 2, 2), ("l", 1, 2), ("l", 2, 2), ("q", 1, 1)]
    assert got[0]["content"] == "First paragraph." and got[0]["breadcrumb"] == "b > partie 1/2" and got[-1]["id"] == "q"


def test_search_rules(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "a", 0.8), (1, 3, "b", 0.7), (1, 4, "c", 0.6)], "query_id long, vec_id long, source_id string, score double")
    assert [r["vec_id"] for r in search.diversify(hits, 3).orderBy("rank").collect()] == [1, 3, 4]
    pools = spark.createDataFrame([(1, 1, "hotel", 0.6), (1, 2, "software", 0.9), (1, 3, "software", 0.8)], "query_id long, vec_id long, domain string, score double")
    assert [r["vec_id"] for r in search.balanced(pools, ("hotel", "software"), 3).orderBy("rank").collect()] == [1, 2, 3]


def test_thinning(spark):
    f = spark.createDataFrame([(1, t, i) for i, t in enumerate([0.0, 0.15, 0.30])], "segment int, t double, frame_id long")
    assert sorted(r["frame_id"] for r in steps.thin(f, 0.2).collect()) == [0, 2]


def test_planner(spark):
    q = spark.createDataFrame([("Et ensuite, comment le faire ?", "Quel bouton pour le check-in ?"), ("Bonjour", None)], "question string, previous string")
    a, b = planner.plan(q).collect()
    assert a["used_history"] and a["route"] == "software" and a["procedural_detail"] and a["aliases"] == ["effectuer un check-in reservation"]
    assert b["route"] == "both" and b["domain_filter"] is None and b["max_chunks_per_source"] is None


def test_schema(spark):
    row = spark.createDataFrame([("i", "c", "other", "t", "qa", "s", "official", 2, 1)], "id string, content string, domain string, topic string, source_type string, source_id string, authority string, page_start int, page_end int")
    assert {r["violation"] for r in schema.violations(schema.conform(row)).collect()} == {"enum:domain", "pages:order"}
    with pytest.raises(ValueError):
        schema.strict(schema.conform(row))


def test_html():
    page = "<h1>A</h1><p>x <b>y</b></p><script>no</script><h2>B</h2><ul><li>one<p>in</p></li></ul><p>long " + "z" * 2100
    (t1, b1), (t2, b2) = html.parse_sections(page)
    assert (t1, b1, t2, b2[0]) == (["A"], ["x y"], ["A", "B"], "- one in") and len(b2[1]) == 2105


def test_markdown(spark):
    d = spark.createDataFrame([("s", "intro\n# One #\na\nb\n## Two\nc")], "source_id string, text string")
    got = [(r["heading"], r["blocks"]) for r in text_source.sections(d).orderBy("section").collect()]
    assert got == [(None, ["intro"]), ("One", ["a", "b"]), ("Two", ["c"])]


def test_publish(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        records.publish(spark.range(n), path)
        assert records.published(spark, path).count() == n


def test_compatibility_forms(spark):
    assert one(spark, folding.clean_lines, "ﬁn de ｓéjour ²") == "fin de séjour 2"
    assert one(spark, folding.chunk_hash, " ﬁN\n") == one(spark, folding.chunk_hash, "fin")
    assert one(spark, folding.phrase_key, "İç Ǆ קָמָץ") == "ic dz"
    assert one(spark, folding.drop_marks, "Ελλάδα й") == "Ελλαδα и"
    assert one(spark, folding.ascii_key, None) is None


def _documents(spark, rows):
    return spark.createDataFrame(rows, "id string, domain string, content_hash string, authority string, status string, source_type string")


def test_two_step_dedup(spark):
    rows = [("a", "hotel", "1", "community", "draft", "qa"), ("a", "hotel", "1", "official", "draft", "qa"), ("a", "hotel", "1", "official", "draft", "qa"), ("b", "hotel", "1", "official", "verified", "qa"), ("c", "software", "1", "community", "draft", "qa")]
    kept, trace = corpus.deduplicate(_documents(spark, rows))
    assert sorted(r["id"] for r in kept.collect()) == ["b", "c"] and [(r["dropped_id"], r["kept_id"]) for r in trace.collect()] == [("a", "b")]
    clash = _documents(spark, [*rows, ("c", "software", "2", "community", "draft", "qa")])
    with pytest.raises(Exception, match="one id with two contents: c"):
        corpus.deduplicate(clash)[0].collect()
    assert [r["id"] for r in corpus.id_conflicts(clash).collect()] == ["c"]
    assert [r["id"] for r in corpus.deduplicate(clash, on_conflict="list")[0].collect()] == ["b"]


def test_normalize(spark):
    rows = [("1", "s", "L'arrivée  tardive ﬁnale", "Titre", "hotel", "payments", "refund", "qa", "A > a", "/data/x/y.md"), ("2", "s", " \n ", None, "hotel", "payments", None, "qa", None, None), ("3", "s", "ok", None, "hotel", "unknown", None, "qa", None, None)]
    df = spark.createDataFrame(rows, "id string, source_id string, content string, title string, domain string, topic string, subtopic string, source_type string, breadcrumb string, source_path string")
    (r,) = corpus.normalize(df, hotel="h1").collect()
    assert (r["content"], r["topic"], r["subtopic"], r["source_category"], r["source_path"], r["hotel_id"]) == ("L'arrivée tardive finale", "payments", "refund", "refund", "x/y.md", "h1")
    assert r["breadcrumb"] == "h1 > payments > refund > A > Titre"
    assert {(e["id"], e["error"]) for e in corpus.normalization_errors(df).collect()} == {("2", "empty"), ("3", "taxonomy")}


def test_only_verified_is_served(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "a", "draft"), (2, [0.9, 0.1], "b", "verified"), (3, None, "c", "verified")], "vec_id long, embedding array<double>, source_id string, status string")
    points = points.withColumn("title_tokens", F.array().cast("array<string>"))
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>").withColumn("question_tokens", F.array().cast("array<string>"))
    assert [r["vec_id"] for r in search.search(points, q, k=None, threshold=0.1).collect()] == [2]


def test_verifier_outputs(spark):
    raw = [
        ("<decision>supported</decision><answer>Yes</answer><sources>2</sources>", 2, "supported", "Yes [2]\n\nSources\n[2]"), ("<decision>supported</decision><answer>Yes [3]</answer>", 2, "invalid_format", None),
        ('```json\n{"decision": "supported", "answer": "Oui [1]", "sources": [1]}\n```', 1, "supported", "Oui [1]"), ('{"decision": "abstain"}', 1, "abstain", None), ("nothing", 1, "invalid_format", None),
        ("<decision>supported</decision><answer>1. a\n2. b [1]</answer>", 1, "invalid_format", None), ("<decision>supported</decision><answer>x [99999999999]</answer>", 1, "invalid_format", None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(raw)], "k int, raw string, n int, decision string, text string")
    for r in df.withColumn("x", answers.parse_verifier(F.col("raw"), F.col("n"))).collect():
        assert (r["x"]["decision"], r["x"]["text"]) == (r["decision"], r["text"]), r


def test_proposal_hash(spark):
    import hashlib
    import json

    row = {"b": "é \"x\" / y", "a": None, "c": [1, 2], "d": True, "e": 1.5}
    df = spark.createDataFrame([(row["b"], None, row["c"], True, 1.5)], "b string, a string, c array<int>, d boolean, e double")
    want = hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert df.select(steps.proposal_hash(list(row))).first()[0] == want


def test_document_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.html").write_text("<h1>T</h1><p>body of the page</p>")
    (tmp_path / "b.md").write_text("# One\nline one\nline two\n")
    (tmp_path / "c.txt").write_text("plain\n\ntext\n")
    (tmp_path / "d.docx").write_text("ignored")
    (tmp_path / "_sources.yaml").write_text("sources:\n  b.md:\n    source_id: named\n    status: verified\n")
    got = {r["source_id"]: r for r in corpus_source.load_documents(spark, str(tmp_path)).collect()}
    assert got["named"]["status"] == "verified" and got["named"]["content"] == "line one\nline two"
    assert got["a/x"]["content"] == "body of the page" and got["c"]["content"] == "plain\ntext" and got["c"]["status"] == "review_required" and len(got) == 3
    assert corpus_source.discover(spark, str(tmp_path / "none")).count() == 0


def test_record_files(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"id": "1", "content": "a"}\n\n{"id": "2", "content": ""}\n')
    kind = "id string, content string"
    assert corpus_source.read_jsonl(spark, str(tmp_path / "rows.jsonl"), kind).count() == 2 and corpus_source.read_jsonl(spark, str(tmp_path / "none"), kind).count() == 0
    with pytest.raises(ValueError):
        corpus_source.read_jsonl(spark, str(tmp_path / "rows.jsonl"), kind, lambda: {"empty": F.col("content") == ""})
    good, bad = records.faq_lines(records.numbered_lines(spark, str(tmp_path / "rows.jsonl")))
    assert good.count() == 0 and sorted((r["line_number"], r["problem"]) for r in bad.collect()) == [(1, "question"), (3, "question")]
    (tmp_path / "v1").mkdir()
    (tmp_path / "v2").mkdir()
    (tmp_path / "v1" / "steps.json").write_text('{"video_id": "v1", "steps": [{"step_number": 1}, {"step_number": 2}]}')
    (tmp_path / "v2" / "steps.json").write_text('[{"step_number": 3}]')
    assert sorted(r["step_number"] for r in corpus_source.read_steps(spark, f"{tmp_path}/*/steps.json", "step_number int").collect()) == [1, 2, 3]


def test_runs(spark, tmp_path):
    rows = [("1", "s", "one text", "T", "hotel", "payments", None, "qa", "official", "verified"), ("2", "s", "One  text", "T", "hotel", "payments", None, "qa", "official", "verified")]
    df = spark.createDataFrame(rows, "id string, source_id string, content string, title string, domain string, topic string, subtopic string, source_type string, authority string, status string")
    df = df.withColumns({"language": F.lit("fr"), "last_reviewed": F.lit("2024-01-01"), "source_path": F.lit("x")})
    kept, report = corpus_source.normalization_run(df, f"file://{tmp_path}/n")
    (r,) = report.collect()
    assert [k["id"] for k in kept.collect()] == ["2"] and (r["inputs"], r["outputs"], r["duplicates_removed"], r["ready_for_chunking"]) == (2, 1, 1, True)
    chunks, report = corpus_source.chunk_run(kept, f"file://{tmp_path}/c")
    assert chunks.count() == 1 and report.first()["broken_qa"] == 1


def test_pages_and_taxonomy(spark):
    assert one(spark, corpus_source.clean_page, "FAQ logiciel de gestion hôtelière\n\nA &amp;  b\n\n\nc\nPage 2 / 3\n") == "A & b\n\nc"
    strip = lambda c: corpus_source.without_question(c, F.lit("Comment annuler une réservation ?"))
    assert one(spark, strip, "\nComment annuler\nune reservation\n\nCliquez.") == "Cliquez." and one(spark, strip, "Autre chose.\n\nCliquez.") == "Autre chose.\n\nCliquez."
    assert corpus_source.taxonomy_errors({"a": {"t": ["x", "x"], "u": ["y"], "v": [""]}, "b": None}) == ["a/t: repeated subtopic", "a/v: subtopics are not names", "b: no topics"]

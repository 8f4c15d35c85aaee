import json

from corpuslab.operators import corpus
from corpuslab.sources import corpora


def test_keyed_corpus(spark, tmp_path):
    doc = {"title": "T", "abstract": "A", "text": {"Intro": "x", "Body": "", "End": "z"}, "doi": "10/1", "file_name": "f", "rd": "Mixed"}
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({"k2": doc, "k1": {**doc, "doi": "10/2", "rd": "Qualitative"}}, indent=4))
    rows = corpora.read_keyed_corpus(spark, str(path)).orderBy("seq").collect()
    assert [(r.seq, r.key, r.doi, r.label) for r in rows] == [(0, "k2", "10/1", "Mixed"), (1, "k1", "10/2", "Qualitative")]
    assert [(s.name, s.text) for s in rows[0].sections] == [("Intro", "x"), ("Body", ""), ("End", "z")]
    words = spark.createDataFrame([("x", "NOUN", "x")], "word string, pos string, lemma string")
    flat = corpus.assemble(corpora.read_keyed_corpus(spark, str(path)), "doi", "label", "title", words).orderBy("id").first()
    assert flat.full_text == "a SBA x SBA z"


def test_corpus_lines(spark, tmp_path):
    line = {"seq": 0, "key": "k", "title": "T", "abstract": "A", "text": {"I": "x"}, "doi": "d", "file_name": "f", "rd": "R"}
    (tmp_path / "c.jsonl").write_text(json.dumps(line) + "\n" + json.dumps({**line, "seq": 1, "key": "m"}) + "\n")
    rows = corpora.read_corpus_lines(spark, str(tmp_path / "c.jsonl")).orderBy("seq").collect()
    assert [(r.key, r.label, r.sections[0].name) for r in rows] == [("k", "R", "I"), ("m", "R", "I")]


def test_parallel_lists(spark, tmp_path):
    data = {"id": ["a", "b"], "title": ["t", "u"], "abstract": ["x", "y"], "full_text": ["x SBA", "y"],
            "label": ["L", "M"], "sections": [["Abstract", "One"], ["Abstract"]]}
    (tmp_path / "d.json").write_text(json.dumps(data, indent=4))
    rows = corpora.read_parallel_lists(spark, str(tmp_path / "d.json")).orderBy("seq").collect()
    assert [(r.seq, r.id, r.label, r.sections) for r in rows] == [(0, "a", "L", ["Abstract", "One"]), (1, "b", "M", ["Abstract"])]


def test_graph_files(spark, tmp_path):
    (tmp_path / "net.json").write_text(json.dumps({"a": ["b", "c"], "b": []}))
    edges = corpora.read_adjacency(spark, str(tmp_path / "net.json")).collect()
    assert sorted((r.src, r.dst) for r in edges) == [("a", "b"), ("a", "c")]
    (tmp_path / "meta.json").write_text(json.dumps({"a": {"publisher": "P", "subject": ["s"]}, "b": {"type": None}}))
    rows = {r.id: r for r in corpora.read_node_metadata(spark, str(tmp_path / "meta.json")).collect()}
    assert rows["a"].publisher == "P" and rows["a"].subject == ["s"] and rows["b"].type is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0), ("a", 1.5)], "name string, f1 double")
    corpora.write_json(df, str(tmp_path / "j"))
    assert sorted(r.name for r in spark.read.json(str(tmp_path / "j")).collect()) == ["a", "b"]
    corpora.write_table(df, str(tmp_path / "p"), partition_by=["name"])
    assert corpora.read_table(spark, str(tmp_path / "p")).filter("name = 'a'").first().f1 == 1.5
    corpora.write_report(df, str(tmp_path / "r"), ["name"])
    lines = next((tmp_path / "r").glob("*.csv")).read_text().splitlines()
    assert lines == ["index,name,f1", "0,a,1.5", "1,b,2.0"]

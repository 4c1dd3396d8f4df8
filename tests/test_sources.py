import json

from treeline.sources import readers as S
from treeline.sources import writers as W
from treeline.streaming.assertions import running_salience

from .test_graph import edges, rows


def test_tsv_csv_json(spark, tmp_path):
    (tmp_path / "a.taxo").write_text("1\tDog\tAnimal\n2\tbad\n3\tCat\tAnimal\textra\n4\tCat!\tAnimal\n")
    assert rows(S.read_taxo_tsv(spark, str(tmp_path / "a.taxo")), "parent", "child") == {("animal", "dog"), ("animal", "cat")}
    (tmp_path / "e.csv").write_text("Source,Target,Weight\nDog (canine),Pup|whelp,1\nA,B,0.5\nA,C,x\n")
    assert rows(S.read_edge_csv(spark, str(tmp_path / "e.csv")), "parent", "child") == {("dog", "pup")}
    assert rows(S.read_edge_csv(spark, str(tmp_path / "e.csv"), use_synsets=True), "child") == {("pup (pup, whelp)",)}
    (tmp_path / "p.json").write_text(json.dumps([{"parent": "A", "child": "b"}, {"parent": "", "child": "c"}]))
    assert rows(S.read_pairs_json(spark, str(tmp_path / "p.json")), "parent", "child") == {("a", "b")}


def test_obo_and_graphml(spark, tmp_path):
    (tmp_path / "x.obo").write_text('format-version: 1.2\n\n[Term]\nid: X:1\nname: Cell\n\n[Term]\nid: X:2\nname: T cell\nsynonym: "T lymphocyte" EXACT []\nis_a: X:1 ! Cell\n\n[Typedef]\nid: r\n')
    assert rows(S.read_obo(spark, str(tmp_path / "x.obo")), "parent", "child") == {("cell", "t cell")}
    assert rows(S.read_obo(spark, str(tmp_path / "x.obo"), True), "child") == {("t cell (t cell, t lymphocyte)",)}
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="a"/><node id="b"/><node id="virtual_root"/><edge source="a" target="b"/><edge source="virtual_root" target="a"/></graph></graphml>')
    nodes, e = S.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert rows(nodes, "node") == {("a",), ("b",)} and rows(e, "parent", "child") == {("a", "b")}


def test_results_and_logs(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"dataset": "D.csv", "use_synsets": True, "explode_nodes": False, "results": [{"method": "m", "Cond_Clos_F1": 0.5}, {"method": "n", "model": "x"}]}]))
    got = {r.method: r for r in S.read_results_json(spark, str(tmp_path / "r.json")).collect()}
    assert got["m"].dataset == "D" and got["m"].Cond_Clos_F1 == 0.5 and got["n"].Cond_Red_F1 == 0 and got["n"].Cond_Red_Recall is None
    head = "dataset,parent,child,leverage,neighborhood_agreement,votes,salience,is_fp\n"
    (tmp_path / "D__full.csv").write_text(head + "D,a,b,4,0.5,1,2,0\n")
    (tmp_path / "D__full_json.csv").write_text(head + "D,a,c,4,0.5,1,2,1\n")
    assert rows(S.read_diagnostics(spark, str(tmp_path / "D__*.csv"), "full"), "child") == {("b",)}
    (tmp_path / "D__full.jsonl").write_text(json.dumps({"target": "t", "chunk": 0, "reasoning_chars": 7, "diag": {"n_strict": 0, "n_line": 3}}) + "\n")
    r = S.read_reply_log(spark, str(tmp_path / "D__full.jsonl")).first()
    assert (r.dataset, r.variant, r.edges, r.produced) == ("D", "full", 3, True)


def test_writers_round_trip(spark, tmp_path):
    e = edges(spark, [("a", "b")])
    W.write_benchmark(e, e, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out/graphs")), "parent", "child") == {("a", "b")}


def test_streamed_counts_equal_batch(spark, tmp_path):
    replies = [{"run_id": "r", "target": "t", "chunk": i, "text": "cat <= animal\ndog <= animal" if i % 2 else "cat <= animal"} for i in range(6)]
    src = tmp_path / "in"
    src.mkdir()
    for i, r in enumerate(replies):
        (src / f"{i}.json").write_text(json.dumps(r) + "\n")
    vocab = spark.createDataFrame([(x, x) for x in ("cat", "dog", "animal")], "primary string, node string")
    stream = spark.readStream.schema("run_id string, target string, chunk int, text string").option("maxFilesPerTrigger", 2).json(str(src))
    q = running_salience(stream, vocab).writeStream.outputMode("complete").format("memory").queryName("salience").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("salience"), "child", "n") == {("cat", 6), ("dog", 3)}


def test_names_part_at_the_last_double_underscore(spark, tmp_path):
    head = "dataset,parent,child,leverage,neighborhood_agreement,votes,salience,is_fp\n"
    (tmp_path / "a__b__full_json.csv").write_text(head + "D,a,b,4,0.5,1,2,0\n")
    assert rows(S.read_diagnostics(spark, str(tmp_path / "*.csv"), "full_json"), "child") == {("b",)}
    (tmp_path / "a__b__full.jsonl").write_text(json.dumps({"target": "t", "chunk": 0}) + "\n")
    r = S.read_reply_log(spark, str(tmp_path / "*.jsonl")).first()
    assert (r.dataset, r.variant, r.edges, r.produced) == ("a__b", "full", 0, False)


def test_obo_with_other_line_ends(spark, tmp_path):
    text = 'format-version: 1.2\n\n[Term]\nid: X:1\nname: Cell\n\n[Term]\nid: X:2\nname: T cell\nis_a: X:1 ! Cell\n\n[Typedef]\nid: r\nname: rel\nis_a: X:1\n\n[Term]\nid: X:3\nname: B cell\nis_a: X:2\n'
    for i, end in enumerate(("\n", "\r\n")):
        (tmp_path / f"{i}.obo").write_bytes(text.replace("\n", end).encode())
        assert rows(S.read_obo(spark, str(tmp_path / f"{i}.obo")), "parent", "child") == {("cell", "t cell"), ("t cell", "b cell")}


def test_graphml_written_and_read(spark, tmp_path):
    e = edges(spark, [("a & b", 'c "d" <e>'), ("a & b", "f")])
    W.write_graphml(e, str(tmp_path / "g"))
    nodes, got = S.read_graphml(spark, str(tmp_path / "g"))
    assert rows(got, "parent", "child") == {("a & b", 'c "d" <e>'), ("a & b", "f")} and nodes.count() == 3
    import xml.etree.ElementTree as ET

    (path,) = (tmp_path / "g").glob("graph_id=g/*.txt")
    assert len(ET.parse(path).getroot()[0]) == 5

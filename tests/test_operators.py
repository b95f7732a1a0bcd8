"""Operators that SQL can't express, awkward inputs, and expected values of small fixtures."""

import io
import json
import time
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import parse as P
from corpusloom.functions import text as X
from corpusloom.operators import chunk, curate, evaluate, events, graph, lexical, retrieve, scorers, sets, vector
from corpusloom.sources import files
from tests.conftest import DATA


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_inverted_lists_have_recall(spark):
    from corpusloom.plans import search

    t, q = search._vectors(spark, f"{DATA}/sf0.01")
    index = vector.InvertedLists(t, lists=search.IVF_LISTS)
    assert index.table.count() == t.count()
    assert vector.recall(index.topk(q, 10, search.IVF_PROBES), vector.topk(t, q, 10)) >= 0.9


def test_topk_is_the_same_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    t = spark.createDataFrame(rows, "id long, vector array<double>")
    q = t.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query_vector"))
    m = np.array([v for _, v in rows])
    for block in (4096, 32):
        monkeypatch.setattr(vector, "ROWS", block)
        got = {(r.qid, r["rank"]): r.id for r in vector.topk(t, q, 3, exclude_self=True).collect()}
        for qid in range(0, 300, 10):
            sim = m @ m[qid] / (np.linalg.norm(m, axis=1) * np.linalg.norm(m[qid]))
            sim[qid] = -9
            assert [got[qid, k] for k in (1, 2, 3)] == np.argsort(-sim)[:3].tolist()


@pytest.mark.parametrize(("vectors", "threshold", "want"), [
    ([[0.5, 0.5, 0.5]] * 4, 0.9, {1: 0, 2: 0, 3: 0}),
    ([[1, 0, 0], [0, 1, 0], [0, 0.99, 0], [0, 0, 1]], 0.95, {2: 1}),
    ([[1, 0], [0.87, 0.5], [0.5, 0.87], [0, 1]], 0.8, {1: 0, 2: 1, 3: 2}),
    ([[1.0, 0.0]], 0.5, {}),
])
def test_semantic_duplicates(spark, vectors, threshold, want):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")
    assert {r.id: r.target_id for r in vector.semantic_duplicates(df, threshold).collect()} == want


def test_greedy_dedup_is_the_plain_loop(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(120, 5))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    kept = []
    for i in range(len(m)):
        if all(m[i] @ m[j] < 0.7 for j in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    assert sorted(r.id for r in sets.greedy_diverse(df, 0.7).collect()) == kept


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rouge_filter_is_all_pairs(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["w" + "abcdefghijkl"[i] for i in range(12)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(3, 14))) for _ in range(60)] + ["", "..."]
    base = [" ".join(rng.choice(vocabulary, rng.integers(3, 14))) for _ in range(40)]
    base += [t + " wa" for t in texts[:10]]
    want = set()
    for i, t in enumerate(texts):
        for b in base:
            x, y = t.split(), b.split()
            if t not in ("", "...") and 2 * lcs(x, y) / (len(x) + len(y)) > 0.7:
                want.add(i)
    a = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    b = spark.createDataFrame(list(enumerate(base)), "id long, text string")
    assert {r.id for r in sets.rouge_rejects(a, b).collect()} == want and 10 <= len(want) < 60


def test_rouge_filter_leaves_out_lengths_of_no_item(spark):
    long = [(i, " ".join(f"w{j % 50} x{i}" for j in range(2000))) for i in range(200)]
    near = " ".join(f"w{j}" for j in range(20))
    a = spark.createDataFrame([*long, (1000, near), (1001, near + " y" * 17), (1002, near + " y" * 18), (1003, " ".join(near.split()[:11])), (1004, " ".join(near.split()[:10]))], "id long, text string").repartition(2)
    b = spark.createDataFrame([(0, near), (1, None), (2, "z " * 300)], "id long, text string")
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    moved = lambda: sum(x.shuffleWriteRecords() for i in range(stages().size()) for x in [stages().apply(i)])
    before = moved()
    assert {r.id for r in sets.rouge_rejects(a, b).collect()} == {1000, 1001, 1003}
    time.sleep(1)  # the store is behind
    assert moved() - before < 2000  # the long texts have 10,000 different words


def test_letters_are_counted_in_one_pass(spark):
    texts = ["", None, "aAbz", "\u0130i \u212a\u00df\u4e2d\U0001f600 ~`{@[", "Zz" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", vector.letter_embedding(F.col("text")).alias("v"))
    want = df.sparkSession.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.array(*[(F.length(F.lower("text")) - F.length(F.replace(F.lower("text"), F.lit(c), F.lit("")))).cast("double") for c in vector.LETTERS]).alias("v"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    assert "replace(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_random_walks(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c")]
    e = spark.createDataFrame(edges, "src string, dst string")
    near = {frozenset(x) for x in edges}
    starts = spark.createDataFrame([("a",), ("d",)], "id string")
    for how in (False, True):
        got = sorted(map(tuple, sets.random_walk(e, starts, 5, restart=0.3, by_neighbours=how).collect()))
        assert got == sorted(map(tuple, sets.random_walk(e.repartition(3), starts, 5, restart=0.3, by_neighbours=how).collect()))
        for root in "ad":
            path = [i for r, _, i in got if r == root]
            assert len(path) == 6 and all(frozenset((x, y)) in near or y == root for x, y in zip(path, path[1:]))


def test_steps_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    from corpusloom import session

    monkeypatch.setattr(session, "TASK", 50)
    edges = [(f"p{i}", f"s{(i * j) % 40}") for i in range(120) for j in range(1, 6)]
    e = spark.createDataFrame(edges, "src string, dst string")
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    roots = spark.createDataFrame([(f"p{i}",) for i in range(0, 120, 10)], "id string")
    tasks, keep = [], session.Scratch.keep
    monkeypatch.setattr(session.Scratch, "keep", lambda self, df: tasks.append(df.rdd.getNumPartitions()) or keep(self, df))
    got = {(r.root, r.id): r.depth for r in graph.k_hops(e, roots, 2).collect()}
    want = {}
    for i in range(0, 120, 10):
        one = near[f"p{i}"]
        two = set().union(*(near[x] for x in one))
        want |= {(f"p{i}", x): 2 for x in two} | {(f"p{i}", x): 1 for x in one} | {(f"p{i}", f"p{i}"): 0}
    assert got == want and max(tasks) > 8, tasks
    tasks.clear()
    assert sets.random_walk(e, roots, 2).count() == 36 and max(tasks) > 8, tasks


def test_trees_and_cycles(spark):
    nodes = spark.createDataFrame([("0", None), ("0.1", "0"), ("0.2", "0"), ("0.1.1", "0.1")], "id string, parent string")
    assert {r.id: r.depth for r in sets.depths(nodes).collect()} == {"0": 1, "0.1": 2, "0.2": 2, "0.1.1": 3}
    order = [r.id for r in sets.post_order(nodes).orderBy("place").collect()]
    assert order.index("0.1.1") < order.index("0.1") < order.index("0") and order[-1] == "0"
    with pytest.raises(ValueError, match="cycle"):
        sets.depths(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"))


def test_heading_paths(spark):
    heads = [(1, i, lv, t) for i, (lv, t) in enumerate([(1, "A"), (2, "B"), (3, "C"), (2, "D"), (1, "E"), (3, "F")])]
    got = sets.heading_paths(spark.createDataFrame(heads, "doc int, pos long, level int, title string"))
    assert [r.path for r in got.orderBy("pos").collect()] == ["A", "A > B", "A > B > C", "A > D", "E", "E > F"]


def test_boxed_answers(spark):
    cases = {r"\boxed{nested {braces} test}": "nested {braces} test", r"\boxed{content with \{ escaped \} braces}": r"content with \{ escaped \} braces", r"\boxed{unclosed": None, r"\boxed{}": "", "nothing": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", P.boxed("t").alias("x"))
    assert {r.t: r.x for r in df.collect()} == cases


def test_literals_and_tool_calls(spark):
    assert one(spark, "['b', 'a', 3]", lambda t: P.literal(t)) == "[3, 'a', 'b']"
    assert one(spark, "{'b': 1, 'a': 2}", lambda t: P.literal(t, "dict")) == "{'a': 2, 'b': 1}"
    assert one(spark, "__import__('os')", lambda t: P.literal(t)) is None and one(spark, None, lambda t: P.literal(t)) is None
    text = 'x {"a": 1} ```json\n[{"tool_name": "f", "x": {"y": "}"}}]\n``` {\'tool_name\': \'g\'} {'
    assert [json.loads(x)["tool_name"] for x in one(spark, text, P.tool_calls)] == ["f", "g"]
    assert one(spark, None, P.tool_calls) == []


def test_cleaners_and_extractors(spark):
    for t in ("  Hello  World  ", "\x88  Hello  World  "):
        assert one(spark, t, lambda c: X.clean(c)) == "Hello World"
    with pytest.raises(ValueError):
        X.clean(F.lit("x"), ("polish",))
    assert one(spark, "Contact me at example@email.com.", X.emails) == ["example@email.com"]
    assert one(spark, "call 555-123-4567 now", X.us_phones) == ["555-123-4567"] or one(spark, "call 555-123-4567 now", X.us_phones) == [" 555-123-4567"]


def test_filters(spark):
    texts = ["This is four words", "Hello", "An image of five words here", "!Invalid start of the text", "1. Start with a number here", "¿Qué hora es ahora mismo?", "文字が違います"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    fails = {r.i: r.f for r in df.select("i", curate.failed_filters(F.col("t"), ("length", "keyword", "punctuation", "non_english")).alias("f")).collect()}
    assert fails[0] == ["length"] and fails[1] == ["length"] and fails[2] == ["keyword"] and fails[3] == ["punctuation", "non_english"] and fails[4] == ["non_english"]
    assert "non_english" in fails[5] and "non_english" in fails[6]
    curate.register_filter("never", lambda t: F.lit(False))
    first = df.select(curate.failed_filters(F.col("t"), ("never", "length"), first_only=True).alias("f")).first().f
    assert first == ["never"]


def test_missing_score_fails(spark):
    df = spark.createDataFrame([({"a": 1.0},)], "s map<string,double>")
    assert df.where(curate.all_at_least(F.col("s"), {"a": 0.5})).count() == 1
    with pytest.raises(Exception, match="no score b"):
        df.where(curate.all_at_least(F.col("s"), {"b": 0.5})).collect()


def test_strict_then_relaxed(spark):
    df = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3), ("b", 1), (None, 3)], "k string, v int")
    got = sorted((r.k or "", r.v) for r in curate.strict_then_relaxed(df, "k", F.col("v") >= 5, F.col("v") >= 3).collect())
    assert got == [("", 3), ("a", 5), ("b", 3)]
    assert [r.v for r in curate.strict_then_relaxed(df, None, F.col("v") >= 5, F.col("v") >= 3).collect()] == [5]
    assert curate.strict_then_relaxed(df.limit(0), None, F.col("v") >= 5, F.col("v") >= 3).count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, "D1", 1), (1, "D2", 2)], "qid int, id string, rank long")
    b = spark.createDataFrame([(1, "D2", 1), (1, "D3", 2)], "qid int, id string, rank long")
    got = lexical.reciprocal_rank_fusion(a, b, k=2).orderBy("rank").collect()
    assert [r.id for r in got] == ["D2", "D1"] and abs(got[0].rrf - (0.8 / 62 + 0.2 / 61)) < 1e-12
    twice = spark.createDataFrame([(1, "T", 1), (1, "T", 3)], "qid int, text string, rank long")
    assert abs(lexical.fused_by_text(twice, twice).first().rrf - (0.8 / 63 + 0.2 / 61)) < 1e-12


def test_graph(spark):
    e = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0)], "src string, dst string, weight double")
    assert {r.id: r.path for r in graph.shortest_paths(e, "A").collect()}["C"] == ["A", "B", "C"]
    assert {r.id: r.centrality for r in graph.degree_centrality(e).collect()} == {"A": 0.5, "B": 1.0, "C": 0.5}
    long = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(40)], "src string, dst string, weight double")
    assert {r.id: r.cost for r in graph.shortest_paths(long, "n000").collect()}["n040"] == 40.0
    with pytest.raises(RuntimeError):
        graph.shortest_paths(long, "n000", most_rounds=5)
    assert "X" not in {r.id for r in graph.shortest_paths(e, "A").collect()}


def test_delta_merge_numbers_on(spark):
    base = spark.createDataFrame([(i, i) for i in range(10)], "k long, n long")
    delta = spark.createDataFrame([(i, 0) for i in range(5, 300)], "k long, n long")
    got = {r.k: r.n for r in graph.delta_merge(base, delta, "k", "n").collect()}
    assert got == {**{i: i for i in range(5)}, **{k: 10 + at for at, k in enumerate(range(5, 300))}}


def test_answers(spark):
    cases = [("$1,200", "1200", True), ("about", "3", False), ("a, b; 3.0", "a,b;3", True), ("a, b", "a,b,c", False), (" The End! ", "the end", True)]
    df = spark.createDataFrame(cases, "a string, t string, w boolean")
    assert all(r.w == r.s for r in df.select("w", evaluate.same_answer(F.col("a"), F.col("t")).alias("s")).collect())


def test_scorers(spark):
    import hashlib
    from base64 import b64encode

    key = hashlib.sha256(b"pw").digest()
    cipher = b64encode(bytes(c ^ key[i % 32] for i, c in enumerate("héllo".encode()))).decode()
    df = spark.createDataFrame([(cipher, "pw"), (None, "pw")], "c string, p string")
    assert [r.x for r in df.select(scorers.decrypt("c", "p").alias("x")).collect()] == ["héllo", None]
    two = spark.createDataFrame([(1, 1), (1, 2)], "index int, answer int")
    with pytest.raises(Exception, match="several actions"):
        scorers.step_environment(two.select("index").distinct(), two, F.lit(1.0)).collect()


def test_title_chunks(spark):
    text = "Heading\n" + "\n".join(f"Sentence number {i} of the text." for i in range(60)) + "\nAnother heading\n" + "x" * 1200 + "."
    got = chunk.title_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")).orderBy("id", "chunk").collect()
    assert {r.id for r in got} == {1} and all(len(r.text) <= 500 for r in got)
    assert Counter("".join(r.text for r in got).replace("\n", "")) == Counter(text.replace("\n", ""))
    assert any(r.text.startswith("Another heading") for r in got)


def test_code_and_markdown_chunks(spark):
    assert one(spark, None, lambda t: chunk.code_chunks(t)) == [] and one(spark, "a\n![x](y.png)\nb", lambda t: chunk.code_chunks(t)) == ["a\nb"]
    assert len(one(spark, "y" * 1000, lambda t: chunk.code_chunks(t, 64))) == 4
    assert one(spark, "# A\nshort\n# B\n" + "b" * 60, lambda t: chunk.markdown_sections(t))[0].startswith("# A")


def test_html_text(spark):
    page = "<html><head><style>p{}</style><script>var a='<b>';</script></head><body><p>One &amp;\n\n  two</p><p>three"
    assert one(spark, page, files.html_text) == "One &\ntwothree" and one(spark, None, files.html_text) == ""


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_office_and_archives(spark):
    sheet = '<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="AB1"><v>2.5</v></c></row></sheetData></worksheet>'
    book = archive(**{"xl__sharedStrings.xml": '<sst xmlns="x"><si><t>no</t></si><si><t>yes</t></si></sst>', "xl__worksheets__sheet1.xml": sheet})
    word = archive(**{"word__document.xml": '<w:document xmlns:w="x"><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/></w:document>'})
    df = spark.createDataFrame([("a.xlsx", bytearray(book)), ("b.docx", bytearray(word)), ("c.xlsx", bytearray(b"junk"))], "name string, raw binary")
    got = {(r.name, r.row, r.col): r.value for r in files.office_cells(df).collect()}
    assert got == {("a.xlsx", 1, 1): "yes", ("a.xlsx", 1, 28): "2.5", ("b.docx", 1, 1): "Hello there", ("b.docx", 2, 1): "", ("c.xlsx", 0, 0): None}
    chats = archive(**{"1.json": json.dumps({"role_ASSISTANT": "doctor", "role_USER": "nurse", "message_1": "hi", "message_2": "yes"}), "2.json": json.dumps({"role_USER": "x", "message_1": "lost"})})
    rows = files.zip_chats(spark.createDataFrame([("z.zip", bytearray(chats))], "name string, raw binary")).orderBy("place").collect()
    assert [(r.chat, r.roles, r.message) for r in rows] == [("1.json", "doctor_nurse", "hi"), ("1.json", "doctor_nurse", "yes")]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in {"a.txt": "one \n\n two", "b.json": '{"k": "é"}', "c.html": "<p>x</p>", "d.bin": "?"}.items():
        (tmp_path / "in" / name).write_text(body)
    found = files.read_files(spark, str(tmp_path / "in"))
    assert {r.name: r.page_content for r in files.text_documents(found).collect()} == {"a.txt": "one\ntwo", "b.json": '{"k":"é"}', "c.html": "x"}
    assert [r.name for r in files.unsupported(found).collect()] == ["d.bin"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int", strict=False)
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["{bad"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int")[0].collect()
    (tmp_path / "arr.json").write_text('[{"a": 1}, {"a": 3}]')
    assert sorted(r.a for r in files.read_json_array(spark, str(tmp_path / "arr.json"), "a int").collect()) == [1, 3]
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id long, text string")
    files.write_json_array(df, str(tmp_path / "out"), "id")
    whole = "\n".join(p.read_text().strip() for p in sorted((tmp_path / "out").glob("part-*")) if p.read_text().strip())
    assert [x["id"] for x in json.loads(whole)] == list(range(40))
    with pytest.raises(ValueError):
        files.exports(df, "nowhere")
    assert json.loads(files.exports(df, "prodigy").first().json) == {"text": "t0", "meta": {"id": 0}}


def test_payload_operators(spark):
    t = spark.createDataFrame([("a", [1.0, 0.0], {"k": "1"}), ("b", [0.0, 1.0], None)], "id string, vector array<double>, payload map<string,string>")
    new = spark.createDataFrame([("a", {"k": "2", "m": "x"}), ("b", {"n": "y"}), ("z", {"n": "y"})], "id string, payload map<string,string>")
    assert {r.id: r.payload for r in vector.update_payload(t, new).collect()} == {"a": {"k": "2", "m": "x"}, "b": {"n": "y"}}
    assert [r.id for r in vector.unknown_ids(t, new).collect()] == ["z"]
    with pytest.raises(Exception, match="length 2"):
        vector.add(t, t.withColumn("vector", F.array(F.lit(1.0))), 2).collect()
    with pytest.raises(ValueError):
        vector.delete(t)


def test_retrieval_rounds(spark):
    first = spark.createDataFrame([(1, 10, "create the pool"), (2, 20, "create and verify")], "qid int, id int, text string")
    more = spark.createDataFrame([(1, 11, "verify it"), (2, 21, "more")], "qid int, id int, text string")
    assert sorted((r.qid, r.id) for r in retrieve.adaptive([first, more], ("create", "verify")).collect()) == [(1, 10), (1, 11), (2, 20)]


def test_streams(spark, tmp_path):
    from corpusloom.streaming import events as S

    rows = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.read_events(spark, str(tmp_path / "in"), files_per_trigger=1)
    counts = S.drain(stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert sum(r.n for r in counts.collect()) == rows.count()
    S.append_batches(stream, str(tmp_path / "copy"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "copy")).count() == rows.count()
    for made in (S.windowed_load(stream, "user_id"), S.sessions(stream, "user_id")):
        made.writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / made.columns[0])).trigger(availableNow=True).start().awaitTermination()
        assert spark.table("held").columns == made.columns


def test_tasks_appear_once(spark):
    pieces = spark.createDataFrame([(1, 0, "<task>a</ta"), (1, 1, "sk><task>b"), (1, 2, "</task> <task>c</task><task>open")], "k int, at int, p string")
    assert [(r.at, r.i, r.content) for r in events.new_tasks(pieces, "k", "at", "p").orderBy("i").collect()] == [(1, 0, "a"), (2, 1, "b"), (2, 2, "c")]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from corpusloom.session import shared_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(fake)


def test_pages_of_files(spark):
    from corpusloom.sources import pages as K

    texts = ["héllo\nwörld (x) \\", "", "日本語 😀\n\n\nend "]
    plain, packed = K.write_pdf(texts), K.write_pdf(texts, packed=True)
    simple = b"""%PDF-1.4
1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj
2 0 obj <</Type/Pages/Kids[3 0 R 2 0 R]/Count 1>> endobj
3 0 obj <</Type/Page/Parent 2 0 R/Resources<</Font<</F 4 0 R>>/XObject<</X 6 0 R>>>>/Contents[5 0 R]>> endobj
4 0 obj <</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>> endobj
5 0 obj <</Length 999>> stream
BT /F 9 Tf 10 10 Td (a\\(b\\)\\351) Tj 5 0 Td [(c) -300 (d) -20 (e)] TJ 0 -12 Td <66> Tj ET /X Do BI /W 1 ID \xff\x00 EI BT 0 30 Td (g) Tj ET
endstream endobj
6 0 obj <</Type/XObject/Subtype/Form/Length 29>> stream
BT /F 9 Tf 0 40 Td (h) Tj ET
endstream endobj
trailer <</Root 1 0 R>>
"""
    no_table = packed[: packed.rfind(b"startxref")]
    locked = plain.replace(b"/Root 1 0 R", b"/Encrypt 1 0 R/Root 1 0 R")
    files = {"plain": plain, "packed": packed, "no_table": no_table, "simple": simple, "locked": locked, "cut": packed[:60], "text": b"no pages here", "none": None, "empty": b"", "zero": K.write_pdf([])}
    rows = K.pdf_pages(spark.createDataFrame([(k, v) for k, v in files.items()], "name string, raw binary")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.name, r.page or 0)):
        got.setdefault(r.name, []).append((r.page, r.page_content))
        assert (r.error is None) == (r.page is not None)
    want = [(1, "héllo\nwörld (x) \\"), (2, ""), (3, "日本語 😀\nend")]
    assert got["plain"] == got["packed"] == got["no_table"] == want
    assert got["simple"] == [(1, "a(b)é c de\nf\nh\ng")]
    assert all(got[k] == [(None, None)] for k in ("locked", "cut", "text", "none", "empty")) and "zero" not in got
    bomb = spark.createDataFrame([("b", K.write_pdf(["x" * 100000], packed=True))], "name string, raw binary")
    assert "more than 1000 bytes" in K.pdf_pages(bomb, most_bytes=1000).first().error


def test_fonts_of_a_file_are_read_once(monkeypatch):
    from corpusloom.sources import pages as K

    maps, read = [], K._unicode_map
    monkeypatch.setattr(K, "_unicode_map", lambda body: [maps.append(1), read(body)][1])
    texts = [f"page {i} \ud83d\ude00é".encode("utf-16", "surrogatepass").decode("utf-16") for i in range(30)]
    assert [list(K._texts(K.write_pdf(texts, packed=packed), 1 << 20)) for packed in (False, True)] == [texts, texts] and len(maps) == 2
    some = b"begincmap 1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <41> <0042> endbfchar 1 beginbfrange <61> <63> <0078> endbfrange endcmap"
    decode = K._decoder(type("F", (), {"get": lambda self, v: v, "stream": lambda self, info, raw: raw})(), {"ToUnicode": ({}, some)})
    assert decode(b"Aabcd") == "Bxyz\ufffd" and decode(b"") == ""


def _least(edges, root, directed):
    """Costs, hops and paths by plain relaxation."""
    both = [(a, b, w) for a, b, w in edges] + ([] if directed else [(b, a, w) for a, b, w in edges])
    best = {root: (0, 0)}
    for _ in range(len(both)):
        for a, b, w in both:
            if a in best and (best[a][0] + w, best[a][1] + 1) < best.get(b, (float("inf"), 0)):
                best[b] = (best[a][0] + w, best[a][1] + 1)

    def path(v):
        if v == root:
            return [v]
        return path(min(a for a, b, w in both if b == v and a in best and (best[a][0] + w, best[a][1] + 1) == best[v])) + [v]

    return {v: (*best[v], path(v)) for v in best}


def test_many_paths(spark):
    import random

    from corpusloom.operators import graph as N

    rng = random.Random(5)
    chain = [(f"n{i:02}", f"n{i + 1:02}", 1) for i in range(25)]
    edges = chain + [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}", rng.randrange(4, 9)) for _ in range(15)] + [("n00", "n00", 0), ("n00", "n01", 7), ("x", "y", 0)]
    df = spark.createDataFrame(edges + [("n00", None, 1), ("n00", "z", None)], "src string, dst string, weight long")
    roots = spark.createDataFrame([("n00",), ("n13",), ("x",), ("alone",), (None,), ("n00",)], "id string")
    for directed, delta in ((False, None), (True, 3)):
        rows = N.many_paths(df, roots, directed=directed, delta=delta).collect()
        for root in ("n00", "n13", "x", "alone"):
            assert {r.id: (r.cost, r.hops, r.path) for r in rows if r.root == root} == _least(edges, root, directed), (root, directed)
        assert len({(r.root, r.id) for r in rows}) == len(rows)
    below = [("a", "b", 4), ("a", "c", 2), ("c", "b", -3), ("b", "d", 1)]
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string, weight long")
    start = spark.createDataFrame([("a",)], "id string")
    paths = N.many_paths(frame(below), start, directed=True)
    assert {r.id: (r.cost, r.hops, r.path) for r in paths.collect()} == _least(below, "a", True)
    pairs = spark.createDataFrame([("a", "d"), ("a", "q")], "root string, target string")
    assert {r.target: (r.cost, r.path) for r in N.path_answers(pairs, paths).collect()} == {"d": (0, ["a", "c", "b", "d"]), "q": (None, ["No path exists between 'a' and 'q'"])}
    for bad, directed in (([*below, ("d", "c", 1)], True), (below, False), ([("a", "b", 1), ("b", "a", -2)], True)):
        with pytest.raises(ValueError, match="negative"):
            N.many_paths(frame(bad), start, directed=directed)


def test_many_paths_without_edges_that_landmarks_rule_out(spark, monkeypatch):
    import random

    from corpusloom.operators import graph as N
    from corpusloom.session import Scratch

    rng = random.Random(8)
    edges = [(f"n{i:02}", f"n{j:02}", rng.randrange(0, 40)) for i in range(12) for j in range(i)] + [("x", "y", 30), ("y", "z", 0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight long")
    monkeypatch.setattr(N, "LANDMARKS", 3)
    dropped = []
    on = N._on_least_paths
    monkeypatch.setattr(N, "_on_least_paths", lambda e, costs, scratch: [kept := on(e, costs, scratch), dropped.append(e.count() - kept.count())][0])
    roots = [*sorted({v for edge in edges for v in edge[:2]} - {"y"})]
    rows = N.many_paths(df, spark.createDataFrame([(r,) for r in roots], "id string"), delta=9).collect()
    for root in roots:
        assert {r.id: (r.cost, r.hops, r.path) for r in rows if r.root == root} == _least(edges, root, False), root
    assert dropped[0] > 0 and len(rows) == 12 * 12 + 2 * 3
    doubles = N.many_paths(df.withColumn("weight", F.col("weight") / 2), spark.createDataFrame([("n05",)], "id string"))  # compared as structs
    assert {r.id: (2 * r.cost, r.hops, r.path) for r in doubles.collect()} == _least(edges, "n05", False)
    numbers = N.numbered(df.select(F.col("src").alias("id")), Scratch(spark)).orderBy("no").collect()
    assert [(r.id, r.no) for r in numbers] == [(v, i) for i, v in enumerate(sorted({a for a, _, _ in edges}))]


def test_many_paths_over_blocks(spark, monkeypatch):
    """Over 64 sources, edges in many blocks, a node whose edges lie in several of them, and trees too large for a task; costs too great for a block's keys."""
    import random

    from corpusloom.operators import blocks as B
    from corpusloom.operators import graph as N

    rng = random.Random(6)
    edges = [(f"n{i:02}", f"n{rng.randrange(70):02}", rng.randrange(0, 9)) for i in range(70) for _ in range(2)] + [("hub", f"n{i:02}", rng.randrange(20, 30)) for i in range(70)]
    df = spark.createDataFrame(edges, "src string, dst string, weight int")
    roots = sorted({v for e in edges for v in e[:2]})
    start = spark.createDataFrame([(r,) for r in roots], "id string")
    monkeypatch.setattr(B, "BLOCK", 40)
    rounds = []
    least = N._least_costs
    monkeypatch.setattr(N, "_least_costs", lambda *args: [least(*args), rounds.append(1)][0])
    want = {r: _least(edges, r, False) for r in roots}
    for most in (B.WALKED, 200):
        monkeypatch.setattr(B, "WALKED", most)
        rows = N.many_paths(df, start)
        assert rows.schema["cost"].dataType.typeName() == "integer"
        rows = rows.collect()
        assert len(rows) == len(roots) ** 2
        for root in roots:
            assert {r.id: (r.cost, r.hops, r.path) for r in rows if r.root == root} == want[root], root
    assert not rounds
    with pytest.raises(RuntimeError):
        N.many_paths(df, start, most_rounds=1)
    large = [(a, b, w << 45) for a, b, w in edges[:60]]
    rows = N.many_paths(spark.createDataFrame(large, "src string, dst string, weight long"), start.where("id = 'n00'")).collect()
    assert {r.id: (r.cost, r.hops, r.path) for r in rows} == _least(large, "n00", False) and rounds


def test_two_hops(spark, monkeypatch):
    import itertools
    import random

    from corpusloom.operators import graph as N

    rng = random.Random(4)
    rows = [(rng.randrange(20), rng.randrange(60)) for _ in range(200)] + [(5, m) for m in range(30)] * 2 + [(99, 7), (99, 7), (None, 1), (3, None)]
    want = {p for mid in range(100) for p in itertools.combinations(sorted({m for k, m in rows if k == mid and m is not None}), 2)}
    df = spark.createDataFrame(rows, "mid int, member int")
    for held in (4096, 20):  # within rows, and of hot nodes by a join
        monkeypatch.setattr(N, "HELD", held)
        got = N.two_hops(df).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_step_search(spark):
    from corpusloom.operators import generate as G

    rows = [(i, [("good" if j != i % 7 else "wrong") + str(j) for j in range(i)]) for i in range(14)]
    df = spark.createDataFrame([(i, "q", ". ".join(s) + "。") for i, s in rows], "id int, question string, solution string")
    calls = []

    def verify(part):
        calls.append(1)
        return part.select("id", (~F.contains("solution", F.lit("wrong"))).alias("ok"))

    got = {r.id: r.error_position for r in G.first_wrong_sentence(df, verify).collect()}
    for i, s in rows:  # without a wrong sentence the search ends behind the last probe
        bad = [j + 1 for j, t in enumerate(s) if t.startswith("wrong")]
        assert got[i] == (bad[0] if bad else len(s)), i
    assert len(calls) <= 4

    answers = {0: "right.", 1: "a. right.", 2: "a. b. wrong.", 3: "a. wrong."}
    text = lambda at: F.element_at(F.create_map(*[F.lit(x) for kv in answers.items() for x in kv]), at)
    rounds = []

    def answer(part):
        rounds.append(1)
        return part.select("id", F.when(F.col("round") > 3, F.concat("start", F.lit(" anew."))).when(F.col("round") == 0, F.when(F.col("id") == 0, text(F.lit(0))).otherwise("wrong.")).otherwise(text(F.col("id"))).alias("solution"))

    score = lambda part: part.select("id", F.when(F.col("id") == 1, 0.95).when(F.col("id") == 2, 0.5).when(F.col("id") == 3, None).otherwise(0.0).alias("score"))
    asked = spark.createDataFrame([(i, "q") for i in range(4)], "id int, question string")
    out = {r.id: (r.solution, r.how, r.error_position, r.tries) for r in G.step_search(asked, answer, lambda p: p.select("id", ((F.col("solution") != "") & ~F.contains("solution", F.lit("wrong"))).alias("ok")), score, most_tries=3).collect()}
    assert out == {0: ("right.", "direct", None, 0), 1: ("a. right.", "early", None, 1), 2: ("a. b. wrong.. anew.", "rewritten", 3, 3), 3: (". anew.", "rewritten", 0, 3)}
    assert len(rounds) == 5


def test_step_search_in_place_joins_nothing(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from corpusloom.operators import generate as G
    from corpusloom.session import Scratch

    asked = spark.createDataFrame([(i, i % 9) for i in range(40)], "id int, question int")

    def run(give, **how):
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("question") + 1), lambda i: F.concat(F.lit("s"), F.when(i > F.col("round") + 2, " wrong").otherwise(""))), ". ")
        answer = lambda df: give(df, "solution", F.when(F.col("round") <= 3, F.concat(text, F.lit("."))).otherwise(F.concat("start", F.lit(" anew."))))
        score = lambda df: give(df, "score", F.when(F.col("id") % 5 > 0, 1 - F.regexp_count("solution", F.lit("wrong")) / (F.col("question") + 1)))
        verify = lambda df: give(df, "ok", ~F.contains("solution", F.lit("wrong")) & (F.col("id") % 7 > 0))
        return sorted(map(tuple, G.step_search(asked, answer, verify, score, most_tries=3, **how).collect()), key=str)

    want = run(lambda df, name, c: df.select("id", c.alias(name)))
    written, keep = [], Scratch.keep
    monkeypatch.setattr(DataFrame, "join", None)
    monkeypatch.setattr(Scratch, "keep", lambda self, df: written.append(1) or keep(self, df))
    assert run(lambda df, name, c: df.withColumn(name, c), in_place=True) == want and len(want) == 40
    assert {r[2] for r in want} == {"direct", "early", "whole", "rewritten"} and len(written) <= 10


def test_code_chunks_keep_definitions_whole(spark):
    run = lambda t, n, **k: one(spark, t, lambda c: chunk.code_chunks(c, n, **k))
    define = lambda name, n: "\n".join([f"def {name}():"] + ["    x = 1"] * n)  # noqa: E731  3 or 4 tokens a line
    a, b, big = define("a", 3), define("b", 2), define("big", 20)
    assert run(f"import x\n{a}\n{b}", 100) == [f"import x\n{a}\n{b}"]
    assert run(f"import x\n{a}\n{b}", 20) == [f"import x\n{a}", b]  # b does not fit beside a and is not cut
    assert run(f"{a}\n{big}\n{b}", 20) == [a, big, b]  # larger than a chunk, but whole
    assert run("l\n" * 5 + "l", 2) == ["l\nl"] * 3  # lines outside definitions are cut anywhere
    assert run(f"{a}\n{'y' * 100}\n    x = 1\n{b}", 20) == [a, "y" * 80, "y" * 20, f"    x = 1\n{b}"]
    text = "![i](a.png) gone\nkept ![i](a.png)\n  ![j](b.png)"
    assert run(text, 100) == ["kept ![i](a.png)\n  ![j](b.png)"] and run(text, 100, images=True) == [text]
    for line in ("class A:", "  function f(x) {", "public List<T> of(", "enum E {", "# region r", "#endregion"):
        assert run(f"a\n{line}\nb\nc", 8)[0].startswith("a"), line
        assert run(f"{'z' * 24}\n{line}\nb\nc", 8)[1].endswith("b\nc"), line
    for line in ("defer x", "reclass A", "public x = f(", "@wraps"):
        assert not chunk.STRUCTURE.match(line)


def test_nested_values_within_tolerance(spark):
    cases = [
        ("0.123456", "0.123457", True), ("0.123456", "0.123467", False), ("1", "1.000001", True), ("True", "1.0", True),
        ("[1.0, 2.0]", "[1.0, 2.000001]", True), ("[1.0, 2.0]", "[1.0, 2.1]", False), ("[1.0]", "[1.0, 2.0]", False), ("[1.0]", "(1.0,)", False),
        ("(1.0, 2.0)", " (1.0, 2.000001) ", True), ("{'a': 1.0, 'b': 2.0}", "{'b': 2.0, 'a': 1.000001}", True), ("{'a': 1.0}", "{'b': 1.0}", False),
        ("{1.0, 2.0}", "{2.000001, 1.0}", True), ("{1.0, 2.0}", "{1.0, 2.1}", False), ("{'a': [1.0, {2.0}]}", "{'a': [1.000001, {2.0}]}", True), ("{'a': [1.0]}", "{'a': [1.1]}", False),
        ("{0.0, 0.000009}", "{0.000009, 0.000018}", True), ("{(0.0, 1), (0.000009, 2)}", "{(0.0, 2), (0.000009, 1)}", True), ("{'x', 1.0}", "{'x', 1.0}", True), ("'a'", "'a'", True), ("'a'", "'b'", False),
        ("not a literal", "not a literal ", True), ("f(1)", "f(1.0)", False), ("", "", True), ("1e400", "1e400", False), ("10**400", "1.0", False), ("1" * 400, "1.5", False), (None, "1", None), ("1", None, None),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.x for r in df.select("i", P.near_literals(F.col("a"), F.col("b"), 1e-5).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_bm25_deals_a_frequent_term_to_many_tasks(spark, monkeypatch):
    from corpusloom.operators import lexical

    docs = spark.createDataFrame([(i, "the " * (i % 4) + f"w{i % 5} the") for i in range(20)], "id long, text string")
    queries = spark.createDataFrame([(1, "the w1"), (2, "w2 w2 the"), (3, "none")], "qid long, text string")
    rows = lambda: sorted((r.qid, r.id, round(r.score, 9)) for r in lexical.bm25(docs, queries).collect())
    want = rows()
    monkeypatch.setattr(lexical, "CELL", 3)
    monkeypatch.setattr(lexical, "PAIRS", 5)
    assert len(want) == 40 and rows() == want
    assert lexical.bm25(docs, queries).rdd.getNumPartitions() == 12


def test_bm25_best_of_cells_are_the_best_of_all(spark, monkeypatch):
    """Lots, blocks and slices of a few rows, ties and repeated ids included; neither postings nor pairs leave their task."""
    from corpusloom.operators import lexical

    docs = spark.createDataFrame([(i % 55, "the " * (i % 4) + f"w{i % 5} the  w{i % 7}") for i in range(60)] + [(90, None), (91, "")], "id long, text string")
    queries = spark.createDataFrame([(i, f"the w{i % 5} w{i % 3}") for i in range(9)] + [(20, "none"), (21, "")], "qid long, text string")
    want = lexical.ranked(lexical.bm25(docs, queries).withColumn("score", F.round("score", 6)), 6)
    for name, size in (("LOT", 16), ("BLOCK", 4), ("SLICE", 5)):
        monkeypatch.setattr(lexical, name, size)
    found = lexical.bm25_top(docs, queries, 6)
    rows = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    assert len(rows(want)) == 60 and rows(found) == rows(want)
    assert found.columns == ["qid", "id", "score", "rank"]

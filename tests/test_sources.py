import io
import json
import random
import tarfile

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources import archives as A
from corpusloom.sources import html as H
from corpusloom.sources import papers as P

PAGE = """<html><head><title>t</title><style>p{}</style></head><body>
<div class="metadata">notice</div><p>Lead <b>text</b><sup class="reference">[1]</sup> here.
<p>Second <math alttext="{\\displaystyle x^2}"><mi>x</mi></math> paragraph<br>line two</p>
<script>var a = "</p><p>no</p>";</script>
<h2>Life</h2><p>Born.</p><h3>Youth</h3><ul><li>one<li>two <ul><li>deep</li></ul></li></ul><p>After list</p>
<h2>References</h2><p>hidden</p><h3>Sub</h3><p>hidden too</p>
<h2>Works</h2><table class="infobox"><tr><th>Name</th><td>Ada</td></tr><tr><td colspan="2">same</td></tr></table>
<table><tr><th rowspan="2">Year</th><th rowspan="2">No.</th><th>A</th></tr><tr><th>B</th></tr><tr><td>1</td><td>x</td><td>y</td></tr><tr><td rowspan="2">2</td><td>z</td><td>z</td></tr><tr><td>q</td><td>r</td></tr></table>
<table><tr><td>only one column</td></tr></table>
<div>floating <a href="/wiki/K%C3%B6ln">Cologne</a> text<p>inner</p></div><a href="/x&action=edit">edit</a>
</body></html>"""


def test_page_to_blocks():
    got = H.blocks_of(PAGE, "Title")
    assert got[0] == ("", "Lead text here.", "text") and got[1] == ("", "Second x^2 paragraph\nline two".replace("x^2", " x^2").replace("  ", " "), "text")
    by = [(s, k) for s, _, k in got]
    assert ("Life > Youth", "text") in by and not any("References" in s or "Sub" in s for s, _ in by)
    assert next(c for s, c, k in got if s == "Life > Youth") == "one\ntwo\ndeep"
    box = next(c for s, c, k in got if k == "infobox")
    assert box == "<Table>\n\n| --- | --- |\nName: Ada".replace("\n\n", "\n\n") + "\nsame\n</Table>"
    table = next(c for s, c, k in got if k == "table")
    assert table == "<Table>\n| Year | No. | A> B |\n| --- | --- | --- |\n| 1 | x | y |\n2: z\n| 2 | q | r |\n</Table>"
    assert ("Works", "floating Cologne text", "text") in got and ("Works", "inner", "text") in got
    assert not any("edit" == c or "notice" in c or "var a" in c or "only one" in c for _, c, _ in got)
    moved = H.blocks_of(PAGE, "Title", {"Köln": "Cologne (city)"})
    assert any("floating Köln (in English: Cologne) text" in c for _, c, _ in moved)
    assert H.blocks_of("") == [] and H.blocks_of(None) == []


def test_broken_markup():
    cut = "<p>One</p><p>Two</p><table><tr><td>a<td>b\nERROR log line <h2>Events</h2><p>Three"
    got = H.blocks_of(cut)
    assert [c for _, c, k in got if k == "text"][:2] == ["One", "Two"]
    assert H.blocks_of("<" * 500 + "<p>x") and H.blocks_of("</div></p><p>fine") == [("", "fine", "text")]


def test_table_html():
    assert H.table_html("<Table>\n| h | k |\n| --- | --- |\nkey: value\n| 1 | 2 |\nall\n</Table>") == '<table><tr><th>h</th><th>k</th></tr><tr><td>key</td><td colspan="1">value</td></tr><tr><td>1</td><td>2</td></tr><tr><td colspan="2">all</td></tr></table>'


def test_markdown_html():
    assert H.markdown_html("## A & b\n\n- x\n- **y**\n\nsee [z](http://z)\n<Table>\n| h | k |\n| --- | --- |\n| 1 | 2 |\n</Table>") == (
        '<h2>A &amp; b</h2>\n<ul><li>x</li><li><strong>y</strong></li></ul>\n<p>see <a href="http://z">z</a></p>\n<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr></table>'
    )
    assert H.markdown_html("") == ""


def test_pages_as_rows(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    rows = H.html_to_blocks(df, ["page_id"]).collect()
    assert {r.page_id for r in rows} == {1} and [r.block_no for r in rows] == list(range(1, len(rows) + 1))


def test_archives(spark, tmp_path):
    def archive(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as t:
            for m, lines in members.items():
                data = "\n".join(lines).encode()
                info = tarfile.TarInfo(m)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    archive("a.tar.gz", {"x.ndjson": [json.dumps({"name": "A", "n": 1}), "broken {", "[1]", json.dumps({"name": "B"})], "y.ndjson": [json.dumps({"name": "C"})]})
    (tmp_path / "b.tar.gz").write_bytes(b"not an archive")
    many = [json.dumps({"name": f"m{i}", "text": "x" * (i % 700)}) for i in range(3000)]
    archive("c.tar.gz", {"long-" + "n" * 150 + ".ndjson": many, "empty.ndjson": [], "z.ndjson": [json.dumps({"name": "Z"}) + "\n"]})
    whole = (tmp_path / "c.tar.gz").read_bytes()
    (tmp_path / "cut.tar.gz").write_bytes(whole[: len(whole) // 2])
    got, rejected = A.read_tar_ndjson(spark, [f"file://{tmp_path}/a.tar.gz", f"file://{tmp_path}/b.tar.gz"], "name string, n int")
    assert sorted(r.record.name for r in got.collect()) == ["A", "B", "C"]
    assert sorted(r.line for r in rejected.collect()) == ["[1]", "broken {"]
    assert A.limit_per_file(got, 1, "line").count() == 1 and A.limit_per_file(got, -1, "line").count() == 3
    got, rejected = A.read_tar_ndjson(spark, f"file://{tmp_path}/c.tar.gz")
    assert sorted(r.line for r in got.collect()) == sorted([*many, json.dumps({"name": "Z"})]) and rejected.count() == 0
    part = {r.line for r in A.read_tar_ndjson(spark, f"file://{tmp_path}/cut.tar.gz")[0].collect()}
    assert part <= set(many) and len(part) < len(many)


def test_json_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": 1, "content": "x"}\n{broken\n{"id": 2, "content": "y"}\n')
    rows, corrupt = A.read_blocks(spark, f"file://{tmp_path}/c.jsonl", "id long, content string")
    assert sorted(r.id for r in rows.collect()) == [1, 2] and [r._corrupt_record for r in corrupt.collect()] == ["{broken"]
    seen = spark.createDataFrame([(1,)], "id long")
    assert [r.id for r in A.read_blocks(spark, f"file://{tmp_path}/c.jsonl", "id long, content string", seen)[0].collect()] == [2]
    assert A.jsonl_to_parquet(spark, f"file://{tmp_path}", f"file://{tmp_path}/out.parquet", "id long, content string") == 1
    assert spark.read.text(f"file://{tmp_path}/out.parquet.rejected").first()[0] == "{broken"
    assert A.read_blocks(spark, f"file://{tmp_path}/out.parquet", "")[0].where("id = 2").count() == 1


def test_translation_map(spark, tmp_path):
    m = A.TranslationMap(spark, f"file://{tmp_path}/map")
    assert m.load("de").count() == 0
    schema = "language string, translation_key string, translation_value string"
    m.append(spark.createDataFrame([("de", "a", "1"), ("fr", "a", "2")], schema))
    m.append(spark.createDataFrame([("de", "a", "3"), ("de", "b", "")], schema))
    assert {r.key: r.value for r in m.load("de").collect()} == {"a": "3", "b": ""}


def test_disambiguation(spark):
    rows = [(["Template:Disambig"], "X", None), ([], "Mercury (disambiguation)", None), (["About"], "X", "X may refer to"), ([], "X", "X may also refer to:"), (None, "X", None), ([], None, None)]
    df = spark.createDataFrame(rows, "t array<string>, n string, w string")
    assert [r[0] for r in df.select(A.is_disambiguation("t", "n", "w")).collect()] == [True, True, False, True, False, False]
    ids = spark.createDataFrame([({"arxiv": "1"},), ({"arxiv": ""},), ({"doi": "1"},), (None,)], "m map<string,string>")
    assert [r[0] for r in ids.select(A.in_subset("m")).collect()] == [True, False, False, False]


def test_splitting():
    text = "one two three. four five\n\nsix seven " + "x" * 30
    pieces = P.split_recursive(text, 3)
    assert all(len(P.token_spans(p)) <= 3 for p in pieces) and "".join(pieces).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert P.split_recursive("", 3) == [] and P.split_recursive("short", 3) == ["short"]
    assert P.split_recursive("abcdef", 2, lambda s: [(i, i + 1) for i in range(len(s))]) == ["ab", "cd", "ef"]


def test_splitting_against_counting_every_time():
    def count(s):
        return len(P.token_spans(s))

    def split(text, limit, marks):
        if count(text) <= limit:
            return [text.strip()] if text.strip() else []
        at = next(i for i, m in enumerate(marks) if not m or m in text)
        mark = marks[at]
        first, *others = text.split(mark) if mark else list(text)
        parts = [p for p in [first, *(mark + o for o in others)] if p]
        out, held = [], ""
        for p in parts:
            if count(held + p) > limit:
                out += [held.strip()] if held.strip() else []
                held = ""
                if count(p) > limit and mark:
                    out += split(p, limit, marks[at + 1 :])
                    continue
            held += p
        return out + ([held.strip()] if held.strip() else [])

    rng = random.Random(0)
    for _ in range(800):
        text = "".join(rng.choice(["a", "é b", " ", "\n", "\n\n", ". ", ",", "word ", "，", "。", "xxxxx", " - "]) for _ in range(rng.randint(0, 60)))
        limit = rng.choice([1, 2, 3, 7, 20])
        assert P.split_recursive(text, limit) == split(text, limit, P.SEPARATORS)


def test_one_token_count_in_python_and_in_the_jvm(spark):
    texts = ["Ünï-cödé, 中文字 x_1", "a\u00a0b\u3000c\t.", "نمونه متن", "e\u0301 l'été 3.5%"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.count_tokens("s").alias("n")).collect()
    assert {r.s: r.n for r in rows} == {t: len(P.token_spans(t)) for t in texts}


def test_pieces_of_documents_stay_under_the_limit(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.explode(P.split_text("text")).alias("piece"))
    assert d.where(T.count_tokens("piece") > P.CHUNK_TOKENS).count() == 0
    joined = d.groupBy("doc_id", "text").agg(F.concat_ws("", F.collect_list("piece")).alias("j"))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    assert joined.where(F.length(bare("j")) != F.length(bare("text"))).count() == 0


def test_papers(spark):
    text = "my title here\nAbstract words\nIntro\nfirst para\nsecond para\nMethod\nthird para\nloose oneloose two"
    at = lambda s: {"start": text.index(s), "end": text.index(s) + len(s)}
    ann = lambda *s: json.dumps(list(s))
    head = at("Intro") | {"attributes": {"n": "1"}}
    second = at("Method") | {"start": str(at("Method")["start"])}
    loose = [{"start": at("my title")["start"], "end": at("my title")["end"]}, {"start": at("my title")["end"], "end": at("my title here")["end"]}]
    rows = [(1, text, "u", ann(at("my title here")), ann(at("Abstract words")), ann(head, second), ann(at("first para"), at("second para"), at("third para"), *loose)), (2, text, "u", None, None, None, None), (3, text, "u", ann(at("my title here")), None, "[]", "[]")]
    df = spark.createDataFrame(rows, "corpusid long, text string, url string, title string, abstract string, sectionheader string, paragraph string")
    got = [(r.document_title, r.section_title, r.content) for r in P.paper_blocks(df).orderBy("corpusid", "part", "piece").collect()]
    assert got == [("My Title Here", "Abstract", "Abstract words"), ("My Title Here", "1. Intro", "first para\n\nsecond para"), ("My Title Here", "Method", "third para"), ("My Title Here", "", "my title\n\n here")]
    packed = P.paper_blocks(df, pack_to=100)
    assert packed.count() == 4


def test_paper_files(spark, tmp_path):
    for name, ids in (("p1", range(5)), ("p2", range(5, 8))):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps({"corpusid": i, "externalids": {"arxiv": "x" if i % 2 else ""}}) for i in ids))
    schema = "corpusid long, externalids map<string,string>"
    read = lambda **options: sorted(r.corpusid for r in A.read_papers(spark, f"file://{tmp_path}/p*.json", schema, **options).collect())
    assert read() == list(range(8)) and read(subset="arxiv") == [1, 3, 5, 7] and read(limit=2) == [0, 1, 5, 6] and read(subset="acl") == []


def test_template_lists(spark):
    table = spark.createDataFrame([("pt", "Desambiguação"), ("pt", "Dab")], "language string, template string")
    names = A.template_names(table)
    assert names[-1] == "desambiguação" and len(names) == len(set(names)) and A.template_names() == A.DISAMBIGUATION_TEMPLATES
    d = spark.createDataFrame([(["Desambiguação"],)], "t array<string>")
    assert d.select(A.is_disambiguation("t", F.lit("x"), F.lit(""), names)).first()[0] and not d.select(A.is_disambiguation("t", F.lit("x"), F.lit(""))).first()[0]

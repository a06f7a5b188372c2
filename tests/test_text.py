import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import values as V


def one(spark, column, **values):
    kinds = {str: "string", int: "int", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "k int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize("given, want", [
    ("Foo (bar) baz", "Foo (bar)"), ("Foo", "Foo"), ("", ""), ("a" * 70, "a" * 60), ("(x) " + "b" * 58, "(x) " + "b" * 56), (")", ")"), ("x" * 20 + ")" + "y" * 45, "x" * 20 + ")" ),
])
def test_truncate(spark, given, want):
    assert one(spark, T.truncate_string("s", 60), s=given) == want


def test_section_titles(spark):
    title = lambda s: one(spark, T.valid_section_title("s"), s=s)
    assert title(" A > B \n text") == "A > B"
    assert title("A > B > " + "c" * 400) == "A > B"
    assert title("c" * 401) == "" and title("c" * 400) == "c" * 400 and title("") == ""


def test_urls(spark):
    norm = lambda s: one(spark, T.normalize_url("s"), s=s)
    assert norm(" https://a.org/# ") == "https://a.org/" and norm("") is None and norm(None) is None
    assert norm("https://en.wikipedia.org/wiki/A#B%20c+d e") == "https://en.wikipedia.org/wiki/A#B_c+d_e"
    ok = lambda s: one(spark, T.is_valid_url("s"), s=s)
    assert ok("ftp://x") and ok(None) and ok("") and not ok("javascript:x")
    name = lambda s: one(spark, T.url_to_entity_name("s"), s=s)
    assert name("/wiki/A_b%20c+d") == "A b c+d" and name("/wiki/X?action=edit&redlink=1") == "X" and name("/wiki/50%") == "50%"
    url = lambda s, lang: one(spark, T.block_url(F.lit("u"), "s", F.lit(lang)), s=s)
    assert url("A > B c (in English: D)", "de") == "u#B_c" and url("", "en") == "u" and url("A (in English: D)", "en") == "u#A_(in_English:_D)"


def test_titles_and_ids(spark):
    assert one(spark, T.full_title("d", "s"), d="Doc", s="") == "Doc" and one(spark, T.full_title("d", "s"), d="Doc", s="S") == "Doc > S"
    assert one(spark, T.combined_text("d", "s", "c"), d="Doc", s="S", c="text") == "Doc > S text"
    same = one(spark, T.block_id("d", "s", "c"), d="Doc", s="S", c="text")
    assert same == one(spark, T.block_id("d", "s", "c"), d="Doc", s="S", c="text") != one(spark, T.block_id("d", "s", "c"), d="Doc", s="S", c="other")
    assert one(spark, T.normalize_title("s"), s="  citation: self-supervised\n it's GPT ") == "Self-Supervised It'S Gpt"


@pytest.mark.parametrize("text, want", [
    ("x (in English: a) y", ["(in English: a)"]), ("(in English: a) (in English: b)", ["(in English: a)", "(in English: b)"]), ("(in English: a (b (c)))", ["(in English: a (b (c)))"]), ("none", []), ("", []), ("(in English: open", []), (None, []),
])
def test_translation_marks(spark, text, want):
    assert T.extract_translations(text) == want


def test_translations_stay_once():
    parts = T.keep_first_translations(["A (in English: B)", "S (in English: B)", "c (in English: B) d (in English: B)"])
    assert parts == ["A (in English: B)", "S", "c d"]


def test_replace_except_first(spark):
    f = lambda s, o: one(spark, T.replace_except_first("s", o, "-"), s=s)
    assert f("a.a.a", "a") == "a.-.-" and f("bbb", "a") == "bbb" and f("ab", "ab") == "ab"


def test_citations(spark):
    text, refs = T.shift_references("s", "r")
    get = lambda s, r: (one(spark, text, s=s, r=r), one(spark, refs, s=s, r=r))
    assert get("a [3] b [1] c [3][9]", ["x", "y", "z"]) == ("a [2] b [1] c [2][9]", ["x", "z"])
    assert get("no", ["x"]) == ("no", ["x"]) and get("[0] [5]", ["x"]) == ("[0] [5]", [])
    assert get("[10] [2]", [f"r{i}" for i in range(1, 11)]) == ("[2] [1]", ["r2", "r10"])


def test_lists_and_tags(spark):
    assert one(spark, T.lines_to_list("s"), s="- a\n2. b\n\nNone\n c ") == ["a", "b", "c"]
    assert one(spark, T.first_tag("s", "x"), s="q <x> a\nb </x> <x>c</x>") == "a\nb" and one(spark, T.first_tag("s", "x"), s="q") == ""
    assert one(spark, T.remove_prefix("s"), s=" User: hi ") == "hi" and one(spark, T.secure_file_name("s"), s="a b/../c?.jsonl") == "a_b-..-c-.jsonl"
    assert one(spark, T.remove_all_extensions("s"), s="dir.x/file.tar.gz") == "dir.x/file"


def test_paper_urls(spark):
    args = [F.array().cast("array<string>"), F.lit("1"), F.lit("oa"), F.lit("2"), F.lit("3"), F.lit("4")]
    got = []
    for k in range(1, 7):
        got.append(one(spark, T.paper_url(*[F.lit(None).cast("string") if 0 < i < k else a for i, a in enumerate(args)])))
    assert got[0].endswith("pdf/1") and got[1] == "oa" and "pmc.ncbi" in got[2] and "pubmed.ncbi" in got[3] and got[4] == "https://aclanthology.org/4.pdf" and got[5] is None
    assert one(spark, T.paper_url(F.array(F.lit("https://export.arxiv.org/x")), *args[1:])) == "https://arxiv.org/x"


@pytest.mark.parametrize("given, want", [("2024-01-05T10:11:12Z", "2024-01-05 10:11:12"), ("2024-1-5", "2024-01-05 00:00:00"), ("2024-01-05 10:11:12", "2024-01-05 10:11:12"), ("2024-01-05T10:11:12", "2024-01-05 10:11:12"), ("2023-22-01", None), ("invalid-date", None), ("2024", None)])
def test_dates(spark, given, want):
    assert one(spark, V.parse_edit_date("s").cast("string"), s=given) == want


def test_old_dates(spark):
    assert one(spark, V.short_date_to_iso("s"), s="1:5:24") == "2024-01-05" and one(spark, V.short_date_to_iso("s"), s="2024-01-05") is None
    since = lambda s: one(spark, V.modified_since(V.parse_edit_date("s"), "2024-03-31"), s=s)
    assert since("2024-03-01") and not since("2024-02-29") and since("broken")


def test_numbers(spark):
    assert one(spark, V.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert one(spark, V.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0
    assert one(spark, V.truncate_and_normalize(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2)) == pytest.approx([0.6, 0.8])
    a, b = F.array(*[F.lit(float(x)) for x in range(-3, 40)]), F.array(*[F.lit(float(-x)) for x in range(-3, 40)])
    assert one(spark, V.differing_bits(V.sign_bits(a, 43), V.sign_bits(b, 43))) == 42

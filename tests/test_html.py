import random

from corpusloom.sources import html as H
from corpusloom.sources.papers import token_spans

# own pages in the shapes of the block model's cases
BANNED_PAGE = """<div class="metadata">stub notice</div><table class="infobox"><tr><th colspan="2">نام</th></tr><tr><td>سال</td><td>1390</td></tr></table>
<p>متن آغازین<sup class="reference">[1]</sup> صفحه.</p><h2>See also</h2><ul><li>x</li></ul><h2>References</h2><p>y</p><h3>Notes</h3><p>z</p><h2>External links</h2><p>w</p>"""
BROKEN_PAGE = """<p>First lead.</p><p>Second lead.</p><table><tr><td>cut
2024-01-01 ERROR stray line </td></table></tr><h2>Events</h2><table><tr><th>Day</th><th>What</th></tr><tr><td>1</td><td>a</td></tr><tr><td>2</td><td>b</td></tr></table>"""
DEEP_PAGE = """<table class="infobox"><tr><td>Born</td><td>1949</td></tr></table><p>Lead.</p><h2>Life</h2><p>One.</p><h3>Youth</h3><p>Two.</p><ul><li>a</li><li>b</li></ul><h3>Work</h3><p>Three.</p>
<h2>Books</h2><p>Four.</p><h3>Novels</h3><ul><li>n1</li><li>n2</li></ul><h3>Other books</h3><ol><li>o1</li></ol><h2>Legacy</h2><p>Six.</p><p>Seven.</p>"""


def fitted(page, title="T", limit=H.MAX_BLOCK_TOKENS):
    return H.fit_blocks(H.blocks_of(page, title), title, limit)


def test_neighbours_of_a_section_are_one_block():
    assert len(fitted(BANNED_PAGE)) == 1 and "متن آغازین" in fitted(BANNED_PAGE)[0][1] and "[1]" not in fitted(BANNED_PAGE)[0][1]
    assert [b[0] for b in fitted(BROKEN_PAGE)] == ["", "Events"]
    deep = fitted(DEEP_PAGE)
    assert len(deep) == 8 and deep[-2][0] == "Books > Other books" and deep[-1][1] == "Six.\nSeven." and deep[0][2] == "text"
    for section, content, _, tokens in deep:
        title = f"T > {section}" if section else "T"
        assert tokens == len(token_spans(title)) + len(token_spans(content))


def test_long_blocks_are_split():
    rows = "".join(f"<tr><td>k{i}</td><td>v{i}</td><td>w{i}</td></tr>" for i in range(60))
    page = f"<h2>S</h2><p>{'word ' * 500}</p><table><tr><th>A</th><th>B</th><th>C</th></tr>{rows}</table><p>end</p>"
    blocks = fitted(page, limit=80)
    assert all(n <= 80 for *_, n in blocks)
    tables = [c for _, c, k, _ in blocks if k == "table"]
    assert len(tables) > 3 and all(c.startswith("<Table>\n| A | B | C |\n| --- | --- | --- |\n") and c.endswith("\n</Table>") for c in tables)
    said = " ".join(c for _, c, _, _ in blocks)
    assert all(f"| k{i} | v{i} | w{i} |" in said for i in range(60)) and said.count("word") == 500
    assert all(n <= 9 for *_, n in fitted(page, limit=9))


def test_nothing_of_a_page_is_lost():
    rng = random.Random(2)

    def part(depth):
        kind = rng.choice(["p", "ul", "div", "text", "table", "h2"] if depth else ["text"])
        word = f"w{rng.randrange(10**9)}"
        if kind == "text":
            return f"<b>{word}</b> "
        if kind == "h2":
            return f"<h2>{word}</h2><p>{word}a</p>"
        if kind == "table":
            return f"<table><tr><td>{word}</td><td>{word}b</td></tr><tr><td>{word}c</td><td>{word}d</td></tr></table>"
        inner = "".join(part(depth - 1) for _ in range(rng.randint(1, 3)))
        return f"<ul><li>{inner}</li><li>{word}</li></ul>" if kind == "ul" else f"<{kind}>{inner} {word} </{kind}>"

    for _ in range(150):
        page = "".join(part(3) for _ in range(4))
        words = {x for x in page.replace("<", " <").replace(">", "> ").split() if x[0] == "w"}
        for limit in (H.MAX_BLOCK_TOKENS, 12):
            found = " ".join(f"{s} {c}" for s, c, _, _ in fitted(page, limit=limit)).replace("|", " ").replace(":", " ").split()
            assert words <= set(found)


def test_table_rules():
    assert H.table_text([["a", "a"], ["x", "y"], ["1", "2"]], 2) == "<Table>\n| a> x | a> y |\n| --- | --- |\n1: 2\n</Table>"
    assert H.table_text([["a.b", "a.b", "a.b"], ["1", "2", "3"]], 1) == "<Table>\n| a.b |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n</Table>"
    assert H.table_text([["k", "v"], ["s", "s"]], 0) == "<Table>\n\n| --- | --- |\nk: v\ns\n</Table>"
    assert H.table_text([["1", "2", "3"]], 0) == "<Table>\n| 0 | 1 | 2 |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n</Table>"
    assert H.table_text([["a", "b"]], 1) is None and H.table_text([["a"], ["b"]], 0) is None and H.table_text([], 0) is None


def test_links():
    assert H.entity_of("/wiki/K%C3%B6ln_(Stadt)?action=edit&redlink=1#x") == "Köln (Stadt)"
    assert H.is_article("./A") and H.is_article("/wiki/A") and not H.is_article("/wiki/A.JPG") and not H.is_article("https://x.org/wiki/A")
    assert H.article_links('<a href="/wiki/A">x</a><a href="/wiki/A">y</a><a href="/b">z</a><a>q</a>') == ["A"]


def test_banned_titles(spark):
    assert "Weblinks" in H.banned_titles() and "Weblinks" not in H.banned_titles(languages=("en",))
    more = spark.createDataFrame([("pt", "Ligações externas")], "language string, title string")
    assert H.banned_titles(more, ("pt",)) == {"Ligações externas"}
    assert H.blocks_of("<h2>Ligações externas</h2><p>x</p>", banned=H.banned_titles(more)) == []


def test_articles_to_blocks(spark):
    page = '<p>See <a href="/wiki/K%C3%B6ln">Köln</a>, <a href="./Alt_K%C3%B6ln">alt</a> and <a href="/wiki/K%C3%B6ln">Köln</a>.</p><h2>Life &amp; work</h2><p>x</p>'
    rows = [("Rhein", "https://de.wikipedia.org/wiki/Rhein", "2024-01-05T10:00:00Z", page), ("Leer", "u", None, None), ("Kaputt", "u", "never", "<p>y</p>")]
    articles = spark.createDataFrame(rows, "name string, url string, date_modified string, html string")
    known = spark.createDataFrame([("Köln", "Cologne (city)"), ("Nie", "Never")], "key string, value string")
    redirects = spark.createDataFrame([("Alt Köln", "Köln")], "node string, root string")
    got = {(r.document_title, r.block_no): r for r in H.article_blocks(articles, "de", known, redirects).collect()}
    lead = got["Rhein", 1]
    assert lead.content == "See Köln (in English: Cologne), Alt Köln and Köln." and lead.language == "de" and str(lead.last_edit_date) == "2024-01-05 10:00:00"
    assert got["Rhein", 2].url.endswith("Rhein#Life_&_work") and got["Rhein", 2].num_tokens == len(token_spans("Rhein > Life & work x"))
    assert got["Kaputt", 1].last_edit_date is None and len(got) == 3
    plain = H.article_blocks(articles, "de").where("document_title = 'Rhein' AND block_no = 1").first()
    assert plain.content == "See Köln, alt and Köln."

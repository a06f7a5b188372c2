"""Raw HTML pages to section-aware text, list and table blocks, on the standard library's tolerant parser."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from html.parser import HTMLParser
from pathlib import PurePosixPath
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import values as V
from corpusloom.functions.text import TRANSLATION_PREFIX
from corpusloom.operators.sequences import short_translation, translate_two_paths
from corpusloom.sources.papers import split_recursive, token_spans

# Fixed values of the markup: elements without content, elements that close an open <p>, invisible elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SILENT = {"script", "style", "head", "template", "noscript", "title"}
HEADINGS = {"h1": 0, "h2": 1, "h3": 2, "h4": 3, "h5": 4, "h6": 5}
# Classes and ids of page furniture, and sections that hold references only.
DROPPED_CLASSES = {"ambox", "metadata", "vector-page-toolbar", "vector-column-start", "vector-column-end", "vector-body-before-content"}
DROPPED_IDS = {"p-lang-btn"}
MATH = "{\\displaystyle"
# Titles of sections that hold references only, by language; other languages come as a table (``banned_titles``).
BANNED_TITLES = {
    "en": ("See also", "References", "External links", "Notes", "Sources", "Categories", "Further reading", "Citations", "Footnotes"),
    "es": ("Véase también", "Referencias", "Enlaces externos", "Notas", "Fuentes", "Categorías", "Lecturas adicionales", "Notas al pie"),
    "fr": ("Voir aussi", "Références", "Liens externes", "Notes", "Sources", "Catégories", "Lecture complémentaire", "Notes et références"),
    "it": ("Vedi anche", "Note", "Riferimenti", "Collegamenti esterni", "Fonti", "Categorie", "Bibliografia", "Altri progetti"),
    "de": ("Siehe auch", "Einzelnachweise", "Weblinks", "Anmerkungen", "Quellen", "Kategorien", "Literatur", "Fußnoten"),
}
IMAGE_SUFFIXES = (".jpg", ".png", ".svg")
#: Tokens of a block at most, title included: what the embedding model reads.
MAX_BLOCK_TOKENS = 8192


def banned_titles(table: DataFrame | None = None, languages: tuple[str, ...] | None = None) -> frozenset[str]:
    """The union of the titles of all languages, or of those named; ``table`` (language, title) adds to the fixed ones."""
    rows = [(language, title) for language, titles in BANNED_TITLES.items() for title in titles]
    if table is not None:
        rows += [(r["language"], r["title"]) for r in table.select("language", "title").distinct().collect()]  # a list kept by hand
    return frozenset(title for language, title in rows if languages is None or language in languages)


BANNED_SECTIONS = banned_titles()

BLOCK_SCHEMA = "block_no int, section_title string, content string, block_type string, num_tokens int"


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def find(self, *tags: str) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            if n.tag in tags:
                yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``stop`` is nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "li"})
        if tag == "li":
            self._close({"li"}, {"ul", "ol"})
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, {"dl"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"tr", "table"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            self._close({tag}, set())

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(page: str) -> Node:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def entity_of(url: str) -> str:
    """The name behind a link, as ``text.url_to_entity_name`` has it; query and fragment are no part of it."""
    return PurePosixPath(unquote(urlsplit(url).path)).name.replace("_", " ")


def is_article(href: str) -> bool:
    """Whether a link leads to another article of the same site."""
    target = urlsplit(href)
    path = PurePosixPath(target.path)
    inside = not target.netloc and (href.startswith("./") or path.parts[:2] == ("/", "wiki"))
    return inside and path.suffix.lower() not in IMAGE_SUFFIXES


def article_links(page: str | None) -> list[str]:
    """Names of the articles that a page links to, each once, in order."""
    if not page:
        return []
    return list(dict.fromkeys(entity_of(a.attrs["href"]) for a in parse(page).find("a") if is_article(a.attrs.get("href", ""))))


def clean(node: Node, title: str = "", translations: Mapping[str, str] | None = None) -> None:
    """Drop furniture, put formulas and links in as text, mark line breaks; in place."""
    kept: list[Node | str] = []
    for c in node.children:
        if isinstance(c, str):
            kept.append(c)
            continue
        if c.tag in SILENT or c.classes & DROPPED_CLASSES or c.attrs.get("id") in DROPPED_IDS or (c.tag == "sup" and "reference" in c.classes):
            continue
        if c.tag == "br":
            kept.append("\n")
            continue
        if c.tag == "math" and c.attrs.get("alttext", "").startswith(MATH):
            kept.append(c.attrs["alttext"][len(MATH) : -1])
            continue
        if c.tag == "a" and c.attrs.get("href", "").endswith("&action=edit"):
            continue
        clean(c, title, translations)
        href = c.attrs.get("href", "")
        if c.tag == "a" and translations is not None and is_article(href):
            name = entity_of(href)
            english = short_translation(translations.get(name), title)
            kept.append(f"{name} {TRANSLATION_PREFIX}{english})" if english else name)
            continue
        kept.append(c)
    node.children = kept


_BREAKS = CLOSES_P | {"li", "tr", "dd", "dt"}


def text_of(node: Node | str, skip: frozenset[str] = frozenset()) -> str:
    """All text below a node, block elements on lines of their own, cells parted by a blank; elements in ``skip`` are left out."""
    if isinstance(node, str):
        return node
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts.append(c)
        elif c.tag not in skip:
            gap = "\n" if c.tag in _BREAKS else " " if c.tag in ("td", "th") else ""
            parts += [gap, text_of(c, skip), gap]
    return "".join(parts)


def tidy(s: str) -> str:
    """Blanks collapsed inside lines, empty lines dropped."""
    lines = (re.sub(r"[ \t\r\f\v ]+", " ", x).strip() for x in s.split("\n"))
    return "\n".join(x for x in lines if x)


def grid_of(table: Node) -> tuple[list[list[str]], int]:
    """(cells, header rows): spans are filled with their cell; leading rows of header cells alone are the header."""
    rows: list[dict[int, str]] = []
    below: dict[tuple[int, int], str] = {}
    header, only_heads = 0, True
    own = [r for r in table.find("tr")]
    nested = {id(r) for t in table.find("table") for r in t.find("tr")}
    for r in (r for r in own if id(r) not in nested):
        cells = [c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]
        if not cells:
            continue
        i, col, row = len(rows), 0, {}
        for c in cells:
            while (i, col) in below:
                row[col] = below.pop((i, col))
                col += 1
            span = lambda k: min(max(int(c.attrs[k]), 1), 200) if c.attrs.get(k, "").isdigit() else 1  # noqa: E731, B023
            value = tidy(text_of(c)).replace("\n", " ")
            for _ in range(span("colspan")):
                row[col] = value
                for k in range(1, span("rowspan")):
                    below[i + k, col] = value
                col += 1
        for (y, x), value in list(below.items()):
            if y == i:
                row[x] = below.pop((y, x))
        only_heads &= all(c.tag == "th" for c in cells)
        header += only_heads
        rows.append(row)
    width = max((max(r) + 1 for r in rows if r), default=0)
    return [[r.get(k, "") for k in range(width)] for r in rows], header


def column_title(levels: list[str]) -> str:
    """Header cells from the top down as a path; a cell that repeats the one above it, as spans do, is no level of its own.

    A dot inside a cell is part of its text.
    """
    return "> ".join(cell for i, cell in enumerate(levels) if not i or cell != levels[i - 1])


def row_text(cells: list[str]) -> str:
    """A row of one value as that value, a row of a key and one value as both, any other between bars."""
    key, values = cells[0], set(cells[1:])
    if values == {key}:
        return key
    if len(values) == 1:
        return f"{key}: {values.pop()}"
    return f"| {' | '.join(cells)} |"


def table_lines(grid: list[list[str]], header_rows: int) -> tuple[list[str], list[str]] | None:
    """(head, rows) of a table as text; None where it has no row or fewer than two columns.

    The head is a line of titles and a rule. Titles that are all the same are given once. Without header rows
    columns are numbered; two of them are key and value, and their line of titles stays empty.
    """
    rows = grid[header_rows:]
    if not rows or len(rows[0]) < 2:
        return None
    columns = list(zip(*grid))
    titles = [column_title(list(c[:header_rows])) for c in columns] if header_rows else [str(i) for i in range(len(columns))]
    shown = titles[:1] if len(set(titles)) == 1 else titles
    line = "" if not header_rows and len(columns) == 2 else f"| {' | '.join(shown)} |"
    return [line, f"| {' | '.join('---' for _ in columns)} |"], [row_text(r) for r in rows]


def table_text(grid: list[list[str]], header_rows: int) -> str | None:
    """A table as one marked text."""
    lines = table_lines(grid, header_rows)
    return None if lines is None else _marked(*lines)


def _marked(head: list[str], rows: list[str]) -> str:
    return "\n".join(["<Table>", *head, *rows, "</Table>"])


def table_html(linear: str) -> str:
    """A linearised table back as HTML, one row for each line."""
    lines = linear.removeprefix("<Table>").removesuffix("</Table>").strip("\n").split("\n")
    cells = [[html.escape(c.strip()) for c in x.strip().strip("|").split("|")] if x.strip().startswith("|") else [x] for x in lines]
    width = max((len(c) for c in cells), default=1)
    out = []
    for i, row in enumerate(cells):
        if all(re.fullmatch(r"-+", c) for c in row):
            continue
        if len(row) == 1 and ": " in row[0] and width > 1:
            key, value = row[0].split(": ", 1)
            out.append(f'<tr><td>{html.escape(key)}</td><td colspan="{width - 1}">{html.escape(value)}</td></tr>')
        elif len(row) == 1:
            out.append(f'<tr><td colspan="{width}">{html.escape(row[0])}</td></tr>')
        else:
            kind = "th" if i == 0 else "td"
            out.append("<tr>" + "".join(f"<{kind}>{c}</{kind}>" for c in row) + "</tr>")
    return "<table>" + "".join(out) + "</table>"


class _Walk:
    def __init__(self, banned: frozenset[str]):
        self.banned, self.headings, self.skip_below = banned, {}, None
        self.items: list[str] = []
        self.blocks: list[tuple[str, str, str]] = []

    def section(self) -> str:
        return " > ".join(self.headings[k] for k in sorted(self.headings))

    def emit(self, content: str | None, kind: str = "text") -> None:
        if self.skip_below is None and content and content.strip():
            self.blocks.append((self.section(), content.strip(), kind))

    def flush(self) -> None:
        if self.items:
            items, self.items = self.items, []
            self.emit("\n".join(items))

    def heading(self, level: int, name: str) -> None:
        self.flush()
        if self.skip_below is not None and level > self.skip_below:
            return
        self.skip_below = level if name in self.banned else None
        self.headings = {k: v for k, v in self.headings.items() if k < level}
        if self.skip_below is None:
            self.headings[level] = name

    def children(self, node: Node) -> None:
        loose: list[str] = []

        def spill() -> None:
            content = tidy("".join(loose))
            loose.clear()
            if content:
                self.flush()
                self.emit(content)

        for c in node.children:
            if isinstance(c, str) or c.tag not in _BLOCKS:
                if isinstance(c, Node) and any(True for _ in c.find(*_BLOCKS)):
                    spill()
                    self.children(c)
                else:
                    loose.append(text_of(c))
                continue
            spill()
            try:
                self.element(c)
            except Exception:  # noqa: BLE001  one bad element must not lose the page
                continue
        spill()

    def element(self, node: Node) -> None:
        if node.tag in HEADINGS:
            name = tidy(text_of(node)).replace("\n", " ")
            if name:
                self.heading(HEADINGS[node.tag], name)
        elif node.tag in ("ul", "ol", "dl"):
            self.list(node)
        elif node.tag == "table":
            self.flush()
            kind = "infobox" if "infobox" in node.classes else "table"
            self.emit(table_text(*grid_of(node)), kind)
        elif node.tag in ("p", "pre", "blockquote"):
            content = text_of(node)
            if any(True for _ in node.find(*_BLOCKS)):
                self.children(node)
            elif tidy(content):
                self.flush()
                self.emit(content.strip("\n") if node.tag == "pre" else tidy(content))
        else:
            self.children(node)

    def list(self, node: Node) -> None:
        for c in node.children:
            if isinstance(c, Node):
                own = tidy(text_of(c, frozenset({"ul", "ol", "dl", "table"}))).replace("\n", " ")
                if own and self.skip_below is None:
                    self.items.append(own)
                self.nested(c)

    def nested(self, item: Node) -> None:
        """The nearest lists and tables below an item, at any depth; a table that is none stays as text."""
        for c in item.children:
            if not isinstance(c, Node):
                continue
            if c.tag in ("ul", "ol", "dl"):
                self.list(c)
            elif c.tag == "table":
                linear = table_text(*grid_of(c))
                if linear:
                    self.flush()
                    self.emit(linear, "infobox" if "infobox" in c.classes else "table")
                elif (own := tidy(text_of(c)).replace("\n", " ")) and self.skip_below is None:
                    self.items.append(own)
            else:
                self.nested(c)


_BLOCKS = {*HEADINGS, "p", "ul", "ol", "dl", "table", "pre", "blockquote", "div", "section", "article", "main", "body", "nav", "footer", "header", "aside", "html", "figure"}


def split_block(content: str, kind: str, limit: int) -> list[str]:
    """A block's text in pieces of at most ``limit`` tokens: a table by rows, each piece with the head; anything else at the coarsest mark that fits."""
    n = len(token_spans(content))
    if n <= limit:
        return [content]
    lines = content.split("\n")
    if not (content.startswith("<Table>\n") and content.endswith("\n</Table>")) or len(lines) < 5:
        return split_recursive(content, limit)
    head, rows = lines[1:3], lines[3:-1]
    room = limit - len(token_spans(_marked(head, [])))
    out, held, used = [], [], 0
    for row in rows:
        size = len(token_spans(row))
        if room < 1 or size > room:  # not even one row goes with the head
            return split_recursive(content, limit)
        if used + size > room:
            out.append(_marked(head, held))
            held, used = [], 0
        held.append(row)
        used += size
    return [*out, _marked(head, held)]


def fit_blocks(blocks: list[tuple[str, str, str]], title: str = "", limit: int = MAX_BLOCK_TOKENS) -> list[tuple[str, str, str, int]]:
    """(section title, content, kind, tokens): blocks split to at most ``limit`` tokens, titles included, and neighbours of one section joined while they fit.

    Joined blocks are parted by a line break; of several kinds they are text.
    """
    out: list[tuple[str, str, str, int]] = []
    for section, content, kind in blocks:
        own = len(token_spans(f"{title} > {section}" if section else title))
        for piece in split_block(content, kind, max(limit - own, 1)):
            size = len(token_spans(piece))
            if out and out[-1][0] == section and out[-1][3] + size <= limit:
                _, before, its, used = out.pop()
                out.append((section, f"{before}\n{piece}", its if its == kind else "text", used + size))
            else:
                out.append((section, piece, kind, own + size))
    return out


def blocks_of(page: str | None, title: str = "", translations: Mapping[str, str] | None = None, banned: frozenset[str] = BANNED_SECTIONS) -> list[tuple[str, str, str]]:
    """(section title, content, kind) of a page's elements in order."""
    if not page:
        return []
    root = parse(page)
    clean(root, title, translations)
    walk = _Walk(banned)
    walk.children(root)
    walk.flush()
    return walk.blocks


def markdown_html(text: str) -> str:
    """Plain Markdown with linearised tables as HTML: headings, lists, emphasis, links and paragraphs."""
    tables: list[str] = []

    def keep(match: re.Match) -> str:
        tables.append(table_html(match[0]))
        return f"\n\n\x00{len(tables) - 1}\x00\n\n"

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        s = re.sub(r"\[([^\]]*)\]\(([^)\s]*)\)", r'<a href="\2">\1</a>', s)
        return re.sub(r"\*(.+?)\*", r"<em>\1</em>", re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", s))

    out = []
    for part in re.split(r"\n\s*\n", re.sub(r"(?s)<Table>.*?</Table>", keep, text)):
        part = part.strip("\n")
        head = re.match(r"(#{1,6}) (.*)", part)
        if m := re.fullmatch(r"\x00(\d+)\x00", part.strip()):
            out.append(tables[int(m[1])])
        elif head and "\n" not in part:
            n = len(head[1])
            out.append(f"<h{n}>{inline(head[2])}</h{n}>")
        elif part and all(re.match(r"[-*] ", x) for x in part.split("\n")):
            out.append("<ul>" + "".join(f"<li>{inline(x[2:])}</li>" for x in part.split("\n")) + "</ul>")
        elif part.strip():
            out.append(f"<p>{inline(part)}</p>")
    return "\n".join(out)


def html_to_blocks(pages: DataFrame, keys: list[str], html_column: str = "html", title_column: str | None = None, translations_column: str | None = None, banned: frozenset[str] = BANNED_SECTIONS, limit: int = MAX_BLOCK_TOKENS) -> DataFrame:
    """keys, block_no (from 1), section_title, content, block_type, num_tokens of every page; null and empty pages give no rows.

    Parsing is per page in Arrow batches, without a shuffle. ``translations_column`` is a map<string,string> of the
    page's own links (``with_translations``); translations are then marked, each where it comes first in a block.
    """
    names = [*keys, *(c for c in (title_column, translations_column) if c and c not in keys)]
    schema = ", ".join([*(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys), BLOCK_SCHEMA])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                title = (r[names.index(title_column)] if title_column else "") or ""
                known = dict(r[names.index(translations_column)] or {}) if translations_column else None
                found = blocks_of(r[len(names)], title, known, banned)
                if translations_column:
                    marked = [(T.keep_first_translations([title, section, content])[1:], kind) for section, content, kind in found]
                    found = [(section, content, kind) for (section, content), kind in marked]
                for i, block in enumerate(fit_blocks(found, title, limit), 1):
                    rows.append((*r[: len(keys)], i, *block))
            yield pd.DataFrame(rows, columns=[*keys, "block_no", "section_title", "content", "block_type", "num_tokens"])

    return pages.select(*names, F.col(html_column).alias("__html")).mapInPandas(run, schema)


def with_translations(pages: DataFrame, key: str, translations: DataFrame, redirects: DataFrame, html_column: str = "html") -> DataFrame:
    """Adds translations: map<string,string> of the page's links that have one, by their own name or their redirect's root.

    Links are joined to the map by shuffle, so the map may be of any size; only a page's own entries travel with it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, name) for k, page in zip(pdf[key], pdf["__html"]) for name in article_links(page)], columns=[key, "entity"])

    links = pages.select(key, F.col(html_column).alias("__html")).mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, entity string")
    named = translate_two_paths(links, translations, redirects).where("translation IS NOT NULL").dropDuplicates([key, "entity"])
    maps = named.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("entity", "translation"))).alias("translations"))
    return pages.join(maps, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def article_blocks(articles: DataFrame, language: Column | str, translations: DataFrame | None = None, redirects: DataFrame | None = None, banned: frozenset[str] = BANNED_SECTIONS, limit: int = MAX_BLOCK_TOKENS) -> DataFrame:
    """Whole blocks of articles (name, url, date_modified, html): the block model's columns, block_type and language.

    Articles without a body give nothing. With ``translations`` (key, value) and ``redirects`` (node, root) links are
    marked with their English names. Tokens are counted after that; a date that cannot be read is null.
    """
    rows = articles.where("html IS NOT NULL").select("name", "url", "date_modified", "html")
    if translations is not None:
        rows = with_translations(rows, "name", translations, redirects if redirects is not None else rows.sparkSession.createDataFrame([], "node string, root string"))
    found = html_to_blocks(rows, ["name", "url", "date_modified"], "html", "name", "translations" if translations is not None else None, banned, limit)
    spoken = language if isinstance(language, Column) else F.lit(language)
    return found.select(
        F.col("name").alias("document_title"), "block_no", "section_title", "content", "block_type", "num_tokens", spoken.alias("language"),
        T.block_url("url", "section_title", spoken).alias("url"), V.parse_edit_date("date_modified").alias("last_edit_date"),
    )


def page_outline(pages: DataFrame, key: str, html_column: str = "html") -> DataFrame:
    """(key, title, links, headings): a page's title, its anchors with a target and its first-level headings, by the parser; null pages have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, page in zip(pdf[key], pdf["__html"]):
                root = parse(page or "")
                title = next((text_of(n) for n in root.find("title")), "")
                rows.append((k, title, sum("href" in n.attrs for n in root.find("a")), sum(1 for _ in root.find("h1"))))
            yield pd.DataFrame(rows, columns=[key, "title", "links", "headings"])

    return pages.select(key, F.col(html_column).alias("__html")).mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, title string, links long, headings long")

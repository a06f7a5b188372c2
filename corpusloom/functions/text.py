"""String expressions over columns; all stay inside the JVM unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Limits and markers of the block model.
MAX_DOCUMENT_TITLE = 500
MAX_SECTION_TITLE = 400
TRANSLATION_PREFIX = "(in English: "
RED_LINK = "?action=edit&redlink=1"
NO_RESULTS = "No relevant results found."
#: Characters of a text that a prompt for listwise and for pointwise reranking shows.
LISTWISE_CHARACTERS, POINTWISE_CHARACTERS = 600, 3000
#: What common file systems keep for themselves, the percent sign of encoded names, and control characters.
RESERVED_IN_NAMES = '"%*/:<>?' + "\\|"
#: Letters, marks, numbers and the underscore make words in any script; every other visible character is a token of its own.
WORD = r"[\p{L}\p{M}\p{N}_]+"
TOKEN = WORD + r"|[^\p{L}\p{M}\p{N}_\p{Z}\x00-\x20\x7F]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Trim all white space at both ends (the built-in trim knows only the blank)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def unquote(x: Column | str) -> Column:
    """Percent-decoding that keeps plus signs and leaves a text it cannot decode as it is."""
    x = _c(x)
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def url_to_entity_name(url: Column | str) -> Column:
    """Last path part, decoded, underscores as blanks, without a red link's suffix."""
    name = F.replace(F.element_at(F.split(unquote(url), "/"), -1), F.lit("_"), F.lit(" "))
    cut = F.left(name, F.length(name) - len(RED_LINK))
    return F.when(name.endswith(RED_LINK), cut).otherwise(name)


def block_url(article_url: Column | str, section_title: Column | str, language: Column | str) -> Column:
    """Article url with the innermost section as fragment; translation markers go except in English."""
    section = _c(section_title)
    section = F.when(_c(language) != "en", F.regexp_replace(section, r" \(in English:[^)]*\)", "")).otherwise(section)
    last = strip(F.element_at(F.split(section, ">"), -1))
    return F.when(last != "", F.concat(_c(article_url), F.lit("#"), F.replace(last, F.lit(" "), F.lit("_")))).otherwise(_c(article_url))


def full_title(document_title: Column | str, section_title: Column | str) -> Column:
    section = F.coalesce(_c(section_title), F.lit(""))
    return F.when(section == "", _c(document_title)).otherwise(F.concat(_c(document_title), F.lit(" > "), section))


def combined_text(document_title: Column | str, section_title: Column | str, content: Column | str) -> Column:
    return F.concat(full_title(document_title, section_title), F.lit(" "), _c(content))


def block_id(document_title: Column | str, section_title: Column | str, content: Column | str) -> Column:
    """A stable id: the same text has the same id in every process."""
    return F.xxhash64(combined_text(document_title, section_title, content))


def truncate_string(x: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, then cut after the last ')' among the last 50, also where nothing was too long."""
    head = F.left(_c(x), F.lit(limit))
    n = F.length(head)
    tail = F.right(head, F.least(n, F.lit(50)))
    back = F.locate(")", F.reverse(tail))
    return F.when(back > 0, F.left(head, n - back + 1)).otherwise(head)


def valid_section_title(x: Column | str) -> Column:
    """First line; beyond the limit without its innermost heading; still too long: empty."""
    line = strip(F.element_at(F.split(strip(x), "\n"), 1))
    inner = F.regexp_extract(line, r"(?s)^(.+) > ", 1)
    shorter = F.when((F.length(line) > MAX_SECTION_TITLE) & (inner != ""), inner).otherwise(line)
    return F.when(F.length(shorter) > MAX_SECTION_TITLE, F.lit("")).otherwise(shorter)


def valid_document_title(x: Column | str) -> Column:
    return truncate_string(strip(x), MAX_DOCUMENT_TITLE)


def normalize_url(x: Column | str) -> Column:
    """Trimmed, without a trailing '#', fragments of encyclopedia links decoded; empty is null."""
    u = strip(x)
    u = F.when(u.endswith("#"), F.left(u, F.length(u) - 1)).otherwise(u)
    wiki = u.contains("wikipedia.org") & u.contains("#")
    u = F.when(wiki, F.replace(unquote(u), F.lit(" "), F.lit("_"))).otherwise(u)
    return F.when(_c(x).isNull() | (_c(x) == ""), F.lit(None).cast("string")).otherwise(u)


def is_valid_url(x: Column | str) -> Column:
    """Null counts as valid: a url is optional."""
    u = normalize_url(x)
    return F.coalesce(u.startswith("http") | u.startswith("ftp"), F.lit(True))


def remove_all_extensions(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?<=[^/])\.[^/]*$", "")


_UNSAFE = RESERVED_IN_NAMES + "".join(chr(i) for i in (*range(32), 127))


def secure_file_name(x: Column | str) -> Column:
    """Reserved and control characters become '-', blanks '_'."""
    return F.translate(_c(x), _UNSAFE + " ", "-" * len(_UNSAFE) + "_")


def safe_name(name: str) -> str:
    """``secure_file_name`` of one text."""
    return name.translate(str.maketrans(_UNSAFE + " ", "-" * len(_UNSAFE) + "_"))


def remove_prefix(x: Column | str, prefix: str = "User:") -> Column:
    s = strip(x)
    return F.when(s.startswith(prefix), strip(F.substring(s, len(prefix) + 1, 1_000_000_000))).otherwise(s)


def replace_except_first(x: Column | str, old: Column | str, new: Column | str) -> Column:
    s, o = _c(x), old if isinstance(old, Column) else F.lit(old)
    n = new if isinstance(new, Column) else F.lit(new)
    at = F.instr(s, o)
    cut = at + F.length(o) - 1
    return F.when((at > 0) & (F.length(o) > 0), F.concat(F.left(s, cut), F.replace(F.substring(s, cut + 1, F.length(s)), o, n))).otherwise(s)


def first_tag(x: Column | str, tag: str) -> Column:
    """Text between the first <tag> and its </tag>; empty if there is none."""
    return strip(F.regexp_extract(_c(x), rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def lines_to_list(x: Column | str) -> Column:
    """Lines without list marks, empty ones and 'None' left out."""
    lines = F.transform(F.split(_c(x), "\n"), lambda s: F.regexp_replace(strip(s), r"^(?:[-*]|\d+\.)\s+", ""))
    return F.filter(lines, lambda s: (s != "") & (s != "None"))


def embedding_text(title: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("Title: "), _c(title), F.lit("\n"), _c(content))


def section_with_number(number: Column | str, title: Column | str) -> Column:
    return F.when(_c(number).isNotNull(), F.concat(_c(number), F.lit(". "), _c(title))).otherwise(_c(title))


def paper_url(pdf_urls: Column | str, arxiv: Column | str, open_access: Column | str, pmc: Column | str, pubmed: Column | str, acl: Column | str) -> Column:
    """First of pdf, arXiv, open access, PMC, PubMed, ACL; the export mirror becomes the main site. Empty strings count as absent."""
    some = lambda x: F.when(_c(x) != "", _c(x))
    url = F.coalesce(
        some(F.get(_c(pdf_urls), F.lit(0))),
        F.concat(F.lit("https://arxiv.org/pdf/"), some(arxiv)), some(open_access),
        F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), some(pmc), F.lit("/pdf/")),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), some(pubmed), F.lit("/")),
        F.concat(F.lit("https://aclanthology.org/"), some(acl), F.lit(".pdf")),
    )
    return F.replace(url, F.lit("export.arxiv.org"), F.lit("arxiv.org"))


def title_case(x: Column | str) -> Column:
    """Every run of cased letters with the first in upper case, the rest in lower case (``initcap`` only looks at blanks)."""
    runs = F.regexp_extract_all(_c(x), F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1_000_000_000)))), "")


def normalize_title(x: Column | str) -> Column:
    """White space collapsed, title case, citation marks at the front dropped."""
    return F.regexp_replace(title_case(strip(F.regexp_replace(_c(x), r"\s+", " "))), r"(?i)^citation ?(?:; )?:\s*", "")


def result_string(titles_and_texts: Column | str, limit: int | None = None, prefix: str = "") -> Column:
    """Numbered passages of array<struct<title, content>> for a prompt."""
    items = _c(titles_and_texts) if limit is None else F.slice(_c(titles_and_texts), 1, limit)
    parts = F.transform(items, lambda x, i: F.concat(F.lit(f"[{prefix}"), (i + 1).cast("string"), F.lit("] Title: "), x["title"], F.lit("\n"), x["content"]))
    return F.when(F.size(items) == 0, F.lit(NO_RESULTS)).otherwise(F.array_join(parts, "\n\n"))


def result_markdown(items: Column | str) -> Column:
    """Headed passages of array<struct<title, url, content>>."""
    parts = F.transform(_c(items), lambda x: F.concat(F.lit("#### ["), x["title"], F.lit("]("), x["url"], F.lit(")\n"), x["content"]))
    return F.when(F.size(_c(items)) == 0, F.lit(NO_RESULTS)).otherwise(F.array_join(parts, "\n\n"))


def result_review(titles_and_texts: Column | str, first: int = 1, limit: int | None = None, prefix: str = "") -> Column:
    """struct<text, shown>: passages for a reader, numbered from ``first``, and how many there are, so that the next list can go on."""
    items = _c(titles_and_texts) if limit is None else F.slice(_c(titles_and_texts), 1, limit)
    parts = F.transform(items, lambda x, i: F.concat(F.lit(f"<strong>[{prefix}"), (i + first).cast("string"), F.lit("] Title: "), x["title"], F.lit("</strong>\n\n"), x["content"]))
    text = F.when(F.size(items) == 0, F.lit(NO_RESULTS)).otherwise(F.array_join(parts, "\n\n"))
    return F.struct(text.alias("text"), F.size(items).alias("shown"))


def prompt_excerpt(x: Column | str, limit: int = LISTWISE_CHARACTERS) -> Column:
    """The part of a text that a reranking prompt shows."""
    return F.left(_c(x), F.lit(limit))


def count_tokens(x: Column | str) -> Column:
    """Words and single marks in any script: the token count of the whole engine where no tokenizer is given."""
    return F.regexp_count(_c(x), F.lit(TOKEN))


def words(x: Column | str) -> Column:
    """The lower-case words of a text, in order, repeats included."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(WORD), 0)


def shift_references(text: Column | str, references: Column | str) -> tuple[Column, Column]:
    """(text, references): citations [n] renumbered without gaps, references that are not cited dropped.

    Citations outside 1..size(references) stay as written and are not counted; a text without any keeps all references.
    """
    text, references = _c(text), _c(references)
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), 1), lambda s: s.cast("int"))
    cited = F.array_sort(F.array_distinct(F.filter(found, lambda i: (i >= 1) & (i <= F.size(references)))))
    numbered = F.transform(cited, lambda i, k: F.struct(i.alias("i"), (k + 1).alias("k")))
    mark = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    shifted = F.aggregate(numbered, text, lambda s, n: F.replace(s, mark(n["i"]), mark(n["k"])))
    kept = F.transform(cited, lambda i: F.get(references, i - 1))
    none = F.size(found) == 0
    return F.when(none, text).otherwise(shifted), F.when(none, references).otherwise(kept)


def extract_translations(text: str | None) -> list[str]:
    """All '(in English: ...)' with balanced parentheses; one without an end ends the search."""
    found: list[str] = []
    at = (text or "").find(TRANSLATION_PREFIX)
    while at >= 0:
        depth = 0
        for i in range(at, len(text)):
            depth += (text[i] == "(") - (text[i] == ")")
            if not depth:
                break
        else:
            break
        found.append(text[at : i + 1])
        at = text.find(TRANSLATION_PREFIX, i + 1)
    return found


@F.pandas_udf(ArrayType(StringType()))
def english_translations(x: pd.Series) -> pd.Series:
    """``extract_translations`` by row; no regular expression balances parentheses."""
    return x.map(extract_translations)


def keep_first_translations(parts: list[str | None]) -> list[str | None]:
    """Over the parts in order, each translation stays where it comes first and goes, with the blank before it, elsewhere.

    One that has no blank before it stays. A null part stays null.
    """
    seen: set[str] = set()
    out: list[str | None] = []
    for part in parts:
        kept, at = [], 0
        for mark in extract_translations(part):
            here = part.index(mark, at)
            before = part[at:here]
            if mark in seen and before.endswith(" "):
                kept.append(before[:-1])
            else:
                kept += [before, mark]
            seen.add(mark)
            at = here + len(mark)
        out.append(part if part is None else "".join(kept) + part[at:])
    return out


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("document_title", "section_title", "content")]))
def deduplicate_translations(title: pd.Series, section: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = [keep_first_translations(list(r)) for r in zip(title, section, content)]
    return pd.DataFrame(rows, columns=["document_title", "section_title", "content"])

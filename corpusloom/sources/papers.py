"""Paper records with stand-off annotations to blocks, in DataFrame functions; only text splitting runs in Python."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions import text as T
from corpusloom.operators.blocks import pack_blocks

SPANS = "array<struct<start string, end string, attributes struct<n string>>>"
# Separators tried in turn by the recursive splitter, and its size.
SEPARATORS = ("\n\n", "\n", " ", ".", ",", "​", "，", "、", "．", "。", "")
CHUNK_TOKENS = 600


def token_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each token, by the pattern that ``text.count_tokens`` counts."""
    import regex

    return [m.span() for m in regex.finditer(T.TOKEN, text)]


def split_recursive(text: str, limit: int = CHUNK_TOKENS, spans: Callable[[str], list[tuple[int, int]]] = token_spans, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``limit`` tokens, cut at the first separator that occurs; pieces still too long are cut by the next ones.

    Neighbouring pieces are joined again while they fit; a separator stays at the front of the piece after it. The
    tokens are found once: those of any part of the text are then two look-ups away.
    """
    starts, ends = zip(*found) if (found := spans(text)) else ((), ())
    out: list[str] = []

    def tokens(a: int, b: int) -> int:
        return bisect_left(starts, b) - bisect_right(ends, a)

    def keep(a: int, b: int) -> None:
        if piece := text[a:b].strip():
            out.append(piece)

    def cut(a: int, b: int, marks: tuple[str, ...]) -> None:
        if tokens(a, b) <= limit:
            keep(a, b)
            return
        n = next(i for i, m in enumerate(marks) if not m or text.find(m, a, b) >= 0)
        mark = marks[n]
        borders = [a]
        if mark:
            at = text.find(mark, a, b)
            while at >= 0:
                if at > borders[-1]:
                    borders.append(at)
                at = text.find(mark, at + len(mark), b)
        else:
            borders = list(range(a, b))
        held = a
        for here, there in zip(borders, [*borders[1:], b]):
            if tokens(held, there) <= limit:
                continue
            keep(held, here)
            held = here
            if tokens(here, there) > limit and mark:
                cut(here, there, marks[n + 1 :])
                held = there
        keep(held, b)

    cut(0, len(text), separators)
    return out


@F.pandas_udf(ArrayType(StringType()))
def split_text(text: pd.Series) -> pd.Series:
    return text.map(lambda s: split_recursive(s or ""))


def spans(annotation: Column | str) -> Column:
    """Parsed annotation: array<struct<start int, end int, n string>>; absent is empty."""
    parsed = F.from_json(annotation, SPANS)
    each = F.transform(parsed, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["attributes"]["n"].alias("n")))
    return F.coalesce(each, F.array().cast("array<struct<start:int,end:int,n:string>>"))


def paper_blocks(papers: DataFrame, pack_to: int = 0) -> DataFrame:
    """Blocks of papers: corpusid, document_title, section_title, content, num_tokens, url.

    Input: corpusid, text, url, and JSON strings title, abstract, sectionheader,
    paragraph. Papers without title, headers or paragraphs give nothing. Of several titles the
    first in the text is taken. A paragraph belongs to the first section that contains it; others are joined where they touch.
    Everything of one paper is one row until it is exploded; no shuffle but the packing's.
    """
    cut = lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])
    d = papers.where("title IS NOT NULL AND sectionheader IS NOT NULL AND paragraph IS NOT NULL")
    d = d.withColumns({"__t": F.array_sort(spans("title")), "__a": F.array_sort(spans("abstract")), "__h": spans("sectionheader"), "__p": spans("paragraph")})
    d = d.where("size(__t) > 0 AND size(__h) > 0 AND size(__p) > 0")
    d = d.withColumn("document_title", T.normalize_title(cut(F.get("__t", F.lit(0))))).where("document_title <> ''")
    last = F.size("__h") - 1
    sections = F.transform("__h", lambda h, i: F.struct(h["end"].alias("low"), F.when(i < last, F.get(F.col("__h"), i + 1)["start"]).otherwise(F.length("text")).alias("high"), T.section_with_number(h["n"], cut(h)).alias("name"), i.alias("i")))
    d = d.withColumn("__s", sections)
    inside = lambda p: F.get(F.filter("__s", lambda s: (p["start"] >= s["low"]) & (p["end"] <= s["high"])), F.lit(0))
    d = d.withColumn("__q", F.transform("__p", lambda p, i: F.struct(inside(p)["name"].alias("name"), inside(p)["i"].alias("s"), p["start"].alias("start"), p["end"].alias("end"), cut(p).alias("content"), i.alias("i"))))
    named = F.transform("__s", lambda s: F.struct(s["i"].alias("o"), s["name"].alias("name"), F.array_join(F.transform(F.filter("__q", lambda q: q["s"] == s["i"]), lambda q: q["content"]), "\n\n").alias("content")))
    abstract = F.when(F.size("__a") > 0, F.array(F.struct(F.lit(-1).alias("o"), F.lit("Abstract").alias("name"), cut(F.get("__a", F.lit(0))).alias("content")))).otherwise(F.array().cast("array<struct<o:int,name:string,content:string>>"))
    loose = F.filter("__q", lambda q: q["s"].isNull())
    kind = "array<struct<name:string,end:int,content:string>>"
    merged = F.aggregate(loose, F.array().cast(kind), lambda done, q: F.when(
        (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] == q["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.lit("").alias("name"), q["end"].alias("end"), F.concat(F.element_at(done, -1)["content"], F.lit("\n\n"), q["content"]).alias("content")))),
    ).otherwise(F.concat(done, F.array(F.struct(F.lit("").alias("name"), q["end"].alias("end"), q["content"].alias("content"))))).cast(kind))
    tail = F.transform(merged, lambda m, i: F.struct((i + 1_000_000).alias("o"), m["name"].alias("name"), m["content"].alias("content")))
    parts = F.filter(F.concat(abstract, named, tail), lambda x: x["content"] != "")
    rows = d.select("corpusid", "document_title", "url", F.explode(parts).alias("x")).select("corpusid", "document_title", "url", F.col("x.o").alias("part"), T.title_case(F.col("x.name")).alias("section_title"), F.col("x.content").alias("whole"))
    pieces = rows.select("corpusid", "document_title", "url", "part", "section_title", F.posexplode(split_text("whole")).alias("piece", "content"))
    pieces = pieces.withColumn("num_tokens", T.count_tokens(T.combined_text("document_title", "section_title", "content")))
    if not pack_to:
        return pieces
    ordered = pieces.withColumn("place", F.struct("part", "piece"))
    return pack_blocks(ordered, pack_to, ["corpusid", "url"], "place")

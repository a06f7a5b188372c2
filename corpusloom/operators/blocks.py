"""The block model: validation, quarantine, collections, packing, filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.functions import values as V

CORE_COLUMNS = ("document_title", "section_title", "content", "last_edit_date", "url", "num_tokens")
# Names that metadata may not use, sizes of a block, the codes of languages and kinds.
RESERVED_METADATA = ("content", "document_title", "section_title", "last_edit_date", "url", "num_tokens", "block_metadata", "metadata")
MIN_TOKENS, MAX_TOKENS = 5, 8000
BLOCK_TYPES = ("text", "table", "infobox")


def validate_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): valid rows are normalised, rejected ones are as they came with a ``reason``.

    Checks in order: content, document title, url, edit date, metadata names
    (of a struct column block_metadata). Columns other than those of a block pass through. One scan, no shuffle.
    """
    has = set(blocks.columns)
    need = [c for c in ("document_title", "content") if c not in has]
    if need:
        raise ValueError(f"missing columns: {need}")
    d = blocks
    for name, kind in (("section_title", "string"), ("url", "string"), ("last_edit_date", "string"), ("num_tokens", "int")):
        if name not in has:
            d = d.withColumn(name, F.lit(None).cast(kind))
    parsed = V.parse_edit_date(F.col("last_edit_date").cast("string")) if dict(d.dtypes)["last_edit_date"] == "string" else F.col("last_edit_date").cast("timestamp")
    reserved = []
    if "block_metadata" in has and hasattr(d.schema["block_metadata"].dataType, "names"):
        reserved = sorted(set(d.schema["block_metadata"].dataType.names) & set(RESERVED_METADATA))
    reason = (
        F.when(F.coalesce(T.strip("content"), F.lit("")) == "", "empty content")
        .when(F.coalesce(T.strip("document_title"), F.lit("")) == "", "empty document title")
        .when(~T.is_valid_url("url"), "invalid url")
        .when(F.col("last_edit_date").isNotNull() & parsed.isNull(), "invalid date")
        .when(F.lit(bool(reserved)), f"reserved metadata name {reserved[:1]}")
    )
    judged = d.withColumn("reason", reason)
    good = judged.where("reason IS NULL").drop("reason").withColumns({
        "content": T.strip("content"), "document_title": T.valid_document_title("document_title"), "section_title": T.valid_section_title(F.coalesce("section_title", F.lit(""))),
        "url": T.normalize_url("url"), "last_edit_date": parsed, "num_tokens": F.coalesce("num_tokens", F.lit(0)),
    })
    return good, judged.where("reason IS NOT NULL")


def migrate_old_blocks(blocks: DataFrame) -> DataFrame:
    """Old column names to the block model: article_title, content_string, full_section_title; id goes, 'M:D:YY' dates become ISO.

    Every other column that the block model does not know moves into block_metadata, a JSON object (null if empty); one
    that was there before, a struct, a map or JSON, keeps what it had.
    """
    d = blocks.drop("id")
    for old, new in (("article_title", "document_title"), ("title", "document_title"), ("content_string", "content")):
        if old in d.columns and new not in d.columns:
            d = d.withColumnRenamed(old, new)
    if "section_title" not in d.columns and "full_section_title" in d.columns:
        full = F.col("full_section_title")
        at = F.instr(full, F.lit(" > "))
        d = d.withColumn("section_title", F.when(at > 0, F.substring(full, at + 3, F.length(full))).otherwise("")).drop("full_section_title")
    if "last_edit_date" in d.columns and dict(d.dtypes)["last_edit_date"] == "string":
        d = d.withColumn("last_edit_date", F.coalesce(V.short_date_to_iso("last_edit_date"), "last_edit_date"))
    unknown = [c for c in d.columns if c not in (*CORE_COLUMNS, "block_metadata")]
    if not unknown and "block_metadata" not in d.columns:
        return d
    own = F.to_json(F.struct(*unknown)) if unknown else F.lit("{}")
    had = F.lit("{}")
    if "block_metadata" in d.columns:
        had = F.col("block_metadata") if dict(d.dtypes)["block_metadata"] == "string" else F.to_json("block_metadata")
    inside = lambda x: F.regexp_extract(F.coalesce(x, F.lit("{}")), r"(?s)^\s*\{(.*)\}\s*$", 1)
    parts = F.array_join(F.filter(F.array(inside(had), inside(own)), lambda x: F.trim(x) != ""), ",")
    return d.withColumn("block_metadata", F.when(parts != "", F.concat(F.lit("{"), parts, F.lit("}")))).drop(*unknown)


def peek(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The first rows of a Parquet collection."""
    return spark.read.parquet(path).limit(n)


def text_only(blocks: DataFrame, kind: str = "block_type") -> DataFrame:
    """Blocks of text; those without a kind are text."""
    return blocks.where(F.coalesce(F.col(kind), F.lit("text")) == "text")


def run_counters(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(articles, kept, skipped, skipped_percent, duplicates) of a step that takes ``before`` to ``after``: articles by key, rows that repeat one."""
    came = before.agg(F.countDistinct(key).alias("articles"), (F.count(key) - F.countDistinct(key)).alias("duplicates"))
    left = after.agg(F.countDistinct(key).alias("kept"))
    share = F.when(F.col("articles") > 0, F.round(100.0 * (F.col("articles") - F.col("kept")) / F.col("articles"), 6))
    return came.join(left).select("articles", "kept", (F.col("articles") - F.col("kept")).alias("skipped"), share.alias("skipped_percent"), "duplicates")  # one row each


@dataclass
class Upload:
    """What the gate found: the name to store under, and the reason of a refusal (None if it may pass)."""

    name: str
    refused: str | None


# What may be uploaded, and how much of it.
UPLOAD_EXTENSIONS, MAX_UPLOAD_BYTES = (".jsonl", ".gz"), 100 << 20


def upload_gate(name: str, size: int, taken: set[str], max_bytes: int = MAX_UPLOAD_BYTES) -> Upload:
    """Extension and size of a file that is offered, and a safe name that is free."""
    from corpusloom.operators.registry import free_name

    safe = T.safe_name(name)
    if not name.lower().endswith(UPLOAD_EXTENSIONS):
        return Upload(safe, f"extension must be one of {', '.join(UPLOAD_EXTENSIONS)}")
    if size > max_bytes:
        return Upload(safe, f"more than {max_bytes} bytes")
    return Upload(free_name(safe, taken), None)


def upload_faults(rows: DataFrame, corrupt: DataFrame, metadata_json: str = "block_metadata", row: str | None = None) -> DataFrame:
    """(fault, n) of an uploaded collection: lines that are no JSON, blocks that break a rule, metadata of another shape than the first row's, token limits."""
    good, bad = validate_blocks(rows)
    counted = corrupt.agg(F.count("*").alias("n")).select(F.lit("not JSON").alias("fault"), "n").where("n > 0")
    broken = bad.groupBy(F.col("reason").alias("fault")).agg(F.count("*").alias("n"))
    counts = good.withColumn("num_tokens", F.when(F.col("num_tokens") > 0, F.col("num_tokens")).otherwise(T.count_tokens("content")))
    return counted.unionByName(broken).unionByName(collection_faults(counts, metadata_json, row))


def collection_faults(blocks: DataFrame, metadata_json: str = "block_metadata", row: str | None = None) -> DataFrame:
    """(fault, n): rows whose metadata names and types differ from the commonest shape, and rows outside the token limits.

    ``metadata_json`` is a JSON string column; shapes are compared as DDL of the parsed value. The reference shape is the
    first row's where a ``row`` number is given.
    """
    shape = F.regexp_replace(F.schema_of_variant(F.try_parse_json(metadata_json)), r"DECIMAL\(\d+,\d+\)", "DOUBLE")
    d = blocks.select(shape.alias("shape"), F.col("num_tokens"), (F.col(row) if row else F.lit(0)).alias("row"))
    if row:
        chosen = d.agg(F.min_by("shape", "row").alias("chosen"))
    else:
        chosen = d.groupBy("shape").count().orderBy(F.desc("count"), "shape").limit(1).select(F.col("shape").alias("chosen"))
    d = d.join(F.broadcast(chosen))  # one row
    fault = F.when(~F.col("shape").eqNullSafe(F.col("chosen")), "metadata").when(~F.coalesce(F.col("num_tokens").between(MIN_TOKENS, MAX_TOKENS), F.lit(False)), "tokens")
    return d.select(fault.alias("fault")).where("fault IS NOT NULL").groupBy("fault").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Filter:
    """field (eq | ne | lt | lte | gt | gte) value."""

    field: str
    kind: str
    value: Any


def compile_filters(filters: Iterable[Filter], array_fields: frozenset[str] = frozenset()) -> Column | None:
    """AND of all filters; None if there are none. Rows without the field pass ``ne``; an array equals a value it contains."""

    def one(f: Filter) -> Column:
        value = F.lit(f.value)
        if f.field == "last_edit_date" and not isinstance(f.value, (dt.date, dt.datetime)):
            value = V.parse_edit_date(value)
        c = F.col(f.field)
        if f.kind in ("eq", "ne"):
            same = F.coalesce(F.array_contains(c, f.value), F.lit(False)) if f.field in array_fields else c.eqNullSafe(value)
            return same if f.kind == "eq" else ~same
        try:
            return {"lt": c < value, "lte": c <= value, "gt": c > value, "gte": c >= value}[f.kind]
        except KeyError:
            raise ValueError(f"unknown filter kind {f.kind!r}") from None

    found = [one(f) for f in filters]
    return reduce(lambda a, b: a & b, found) if found else None


def pack_blocks(blocks: DataFrame, limit: int, keys: list[str], order: str, title: str = "document_title", section: str = "section_title", content: str = "content") -> DataFrame:
    """Join consecutive blocks of a document with equal section while their tokens stay under ``limit`` (strictly).

    A block counts the tokens of title, section and text; a joined one adds those of its text; texts are joined by a
    blank. The blocks are sorted by document and order, and one pass over each partition numbers the packs with the
    last block's state alone, so a document of any length is streamed, not gathered; only the blocks of one pack meet.
    """
    whole = list(dict.fromkeys([*keys, title]))
    facts = [T.count_tokens(T.combined_text(title, section, content)).alias("__whole"), T.count_tokens(content).alias("__own")]
    named = blocks.select(*whole, F.col(order).alias("__order"), F.coalesce(F.col(section), F.lit("")).alias("section_title"), F.col(content).alias("content"), *facts)
    named = named.withColumn("__key", F.xxhash64(*whole))
    dealt = named.repartition("__key").sortWithinPartitions(*whole, "__order", "section_title", "content")
    at = {c: i for i, c in enumerate(dealt.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pack, tokens = None, -1, 0
        for batch in batches:
            packs, sums = [], []
            sections = batch.column(at["section_title"]).to_pylist()
            whole_tokens, own_tokens = (batch.column(at[c]).to_pylist() for c in ("__whole", "__own"))
            for key, name, first, more in zip(zip(*(batch.column(at[c]).to_pylist() for c in whole)), sections, whole_tokens, own_tokens):
                if last != (key, name) or tokens + (more or 0) >= limit:
                    pack = pack + 1 if last is not None and last[0] == key else 0
                    tokens = first or 0
                else:
                    tokens += more or 0
                last = (key, name)
                packs.append(pack)
                sums.append(tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packs, pa.int32()), pa.array(sums, pa.int32())], [*batch.schema.names, "pack", "num_tokens"])

    numbered = dealt.mapInArrow(run, StructType([*dealt.schema.fields, StructField("pack", IntegerType()), StructField("num_tokens", IntegerType())]))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__order", "content"))), lambda x: x["content"]), " ")
    return numbered.groupBy(*whole, "pack", "section_title").agg(joined.alias("content"), F.max("num_tokens").alias("num_tokens"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` and then by all other columns that have an order, so that the choice is always the same; a partial aggregation, no sort."""
    others = [c for c in df.columns if c not in keys]
    sortable = [c for c, kind in df.dtypes if c in others and c not in order and "map<" not in kind and "variant" not in kind]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order, *sortable)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def near_dedup_ordered(results: DataFrame, group: list[str], rank: str, tokens: str, threshold: float = 0.8) -> DataFrame:
    """Greedy by rank within a group: a row stays if its Jaccard with every row kept before is under ``threshold``.

    Groups are result lists, a few hundred rows at most; the fold runs in the JVM. Adds nothing to the rows but drops some.
    """
    item = F.struct(F.col(rank).alias("r"), F.array_distinct(F.col(tokens)).alias("t"))
    lists = results.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = lists.select("items").schema["items"].dataType.simpleString()
    kept = F.aggregate("items", F.array().cast(kind), lambda done, x: F.when(F.forall(done, lambda y: V.jaccard(x["t"], y["t"]) < threshold), F.concat(done, F.array(x))).otherwise(done))
    chosen = lists.select(*group, F.explode(F.transform(kept, lambda x: x["r"])).alias(rank))
    return results.join(chosen, [*group, rank], "left_semi")

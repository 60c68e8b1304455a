"""A report as one JSON document that no task holds: pieces in order, written by ranges as the parts of a folder, and read back by lines."""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkloom.functions import schemas
from linkloom.operators import classify, measures
from linkloom.operators.ranks import ranked
from linkloom.operators.running import running_sum
from linkloom.plans.config import CrawlConfig, effective
from linkloom.sources.shared import Tables

_LAST = 1 << 62
PIECE = "section int, rank long, chunk long, value string"


def _object(columns: list[str], nulls: bool = True) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false" if nulls else "true"})


def _open(text: Column) -> Column:
    """A JSON object's or list's text without its end."""
    return F.left(text, F.length(text) - 1)


def _section(section: int, rows: DataFrame, columns: list[str], order: list[str], chunks: DataFrame | None, nulls: bool = True) -> DataFrame:
    """The pieces of a list's objects, with their referrers (chunks, or the row's own source) as foundOn if chunks are given."""
    placed = ranked(rows, order, "rank")
    comma = F.when(F.col("rank") > 1, ",").otherwise("")
    if chunks is None:
        return placed.select(F.lit(section).alias("section"), "rank", F.lit(0).cast("long").alias("chunk"), F.concat(comma, _object(columns, nulls)).alias("value"))
    source = F.col("source") if "source" in rows.columns else F.lit("")
    own = F.when(F.coalesce(source, F.lit("")) != "", F.array(source)).otherwise(F.array().cast("array<string>"))
    met = placed.join(chunks, placed.url == chunks.target, "left").withColumns({"_chunk": F.coalesce("chunk", F.lit(0)), "_of": F.coalesce("chunks", F.lit(1)), "_list": F.coalesce("found_on", own)})
    items = F.substring(_open(F.to_json("_list")), F.lit(2), F.length(F.to_json("_list")))
    head = F.when(F.col("_chunk") == 0, F.concat(comma, _open(_object(columns, nulls)), F.lit(',"foundOn":['))).otherwise(",")
    tail = F.when(F.col("_chunk") == F.col("_of") - 1, "]}").otherwise("")
    return met.select(F.lit(section).alias("section"), "rank", F.col("_chunk").alias("chunk"), F.concat(head, items, tail).alias("value"))


def _opener(name: str) -> str:
    return f',"{name}":['


def _document(first: DataFrame, lists: list[tuple], nulls: bool = True) -> DataFrame:
    """The pieces of a document that begins with first (value), an object's text without its end, and goes on with lists (name, rows, columns, order, chunks)."""
    pieces = first.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("chunk"), "value")
    frame = [(k, at, 0, text) for k, (name, *_) in enumerate(lists, 1) for at, text in ((0, _opener(name)), (_LAST, "]"))]
    pieces = pieces.unionByName(first.sparkSession.createDataFrame([*frame, (len(lists) + 1, 0, 0, "}")], PIECE))
    for k, (_, rows, columns, order, found) in enumerate(lists, 1):
        pieces = pieces.unionByName(_section(k, rows, columns, order, found, nulls))
    return pieces


def report_pieces(tables: dict[str, DataFrame], config: CrawlConfig, crawled_at: str, partial: bool = False, queued: int = 0, retries: int = 0, runtime_ms: int = 0, settings: dict | None = None, known: bool = True, log: dict | None = None, size: int = 1000) -> DataFrame:
    """(section, rank, chunk, value): texts that in this order, with white space between, are the document of ``writers.report_json``.

    A target's referrers come in chunks of ``size``, so the longest piece is as long as so many urls.
    """
    spark = tables["flagged"].sparkSession
    own = Tables(spark)
    flagged = own.write(tables["flagged"].withColumn("kind", F.coalesce("kind", F.lit("internal"))), "flagged")
    tables = tables | {name: own.write(tables[name], name) for name in ("pages", "external", "out_of_scope", "refs")}  # each is read more than once
    chunks = own.write(classify.referrer_chunks(tables["refs"], size), "chunks")
    whole = measures.summary(tables["pages"], tables["external"], tables["out_of_scope"], flagged, tables["refs"], queued, retries, runtime_ms)
    head = {"crawledAt": F.lit(crawled_at), "partial": F.lit(partial), "scope": F.lit(config.prefix() or "(whole domain)")}
    if known:
        head["settings"] = F.parse_json(F.lit(json.dumps(effective(settings, config))))
    head["log"] = F.parse_json(F.lit(json.dumps(log or {"manifest": "", "singleFile": not config.log_max_bytes, "parts": []})))
    first = whole.select(F.struct(*whole.columns).alias("summary")).select(_open(F.to_json(F.struct(*(c.alias(n) for n, c in head.items()), "summary"), {"ignoreNullFields": "false"})).alias("value"))
    broken = F.col("disposition") == "broken"
    reasons = ["url", "reason", "kind"]
    lists = [
        ("internalPages", tables["pages"], ["url", "title", "status", "depth", "internal", "external"], ["depth", "url"], None), ("externalLinks", tables["external"], ["url", "host", "status"], ["url"], chunks), ("outOfScopeLinks", tables["out_of_scope"], ["url"], ["url"], chunks),
        ("errors", flagged.where(broken & ~F.col("suppressed")), reasons, ["url", "reason"], chunks), ("suppressedErrors", flagged.where(broken & F.col("suppressed")), reasons, ["url", "reason"], chunks), ("blocked", flagged.where(~broken), reasons, ["url", "reason"], chunks),
    ]
    return _document(first, lists)


def browser_pieces(pages: DataFrame, external: DataFrame, errors: DataFrame, refs: DataFrame, size: int = 1000) -> DataFrame:
    """As report_pieces, of the smaller document of ``writers.browser_json``; refs are edges."""
    own = Tables(errors.sparkSession)
    pages, external, errors, refs = (own.write(rows, name) for rows, name in ((pages, "pages"), (external, "external"), (errors, "errors"), (refs, "refs")))
    chunks = own.write(classify.referrer_chunks(refs, size), "chunks")
    of_pages, of_errors = ["url", "title", "status", "depth", "internal", "external"], ["url", "reason", "source"]
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    counts = count(pages, "pages").crossJoin(count(external, "externals")).crossJoin(count(errors, "errors"))  # one row each
    first = counts.select(_open(F.to_json(F.struct(F.struct(*counts.columns).alias("summary")))).alias("value"))
    lists = [("pages", pages, of_pages, of_pages, None), ("externals", external, ["url", "host"], ["url", "host"], chunks), ("errors", errors, of_errors, of_errors, None)]
    return _document(first, lists, nulls=False)


def _write(pieces: DataFrame, folder: str) -> None:
    """Write pieces as text files, a line each, in ranges whose names are in the document's order."""
    key = ["section", "rank", "chunk"]
    pieces = Tables(pieces.sparkSession).write(pieces, "pieces")
    pieces.repartitionByRange(*key).sortWithinPartitions(*key).select("value").write.mode("overwrite").text(folder)


def write_report(tables: dict[str, DataFrame], config: CrawlConfig, crawled_at: str, folder: str, **given) -> DataFrame:
    """Write a report's pieces as text files whose names are in the document's order; returns (part, name, bytes), a row for each.

    Tasks write sorted ranges; reading the files one after another gives the document, however large.
    """
    spark = tables["flagged"].sparkSession
    _write(report_pieces(tables, config, crawled_at, **given), folder)
    files = spark.read.format("binaryFile").load(posixpath.join(folder, "part-*")).select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"))
    return ranked(files, ["name"], "part")


def write_browser(pages: DataFrame, external: DataFrame, errors: DataFrame, refs: DataFrame, folder: str, size: int = 1000) -> None:
    """Write the parts of the smaller document."""
    _write(browser_pieces(pages, external, errors, refs, size), folder)


@dataclass
class _Parts:
    """The lines of a folder of parts, written once with their places (at), and where each list begins (one row)."""

    lines: DataFrame
    begins: DataFrame

    def items(self, name: str, kind: str) -> DataFrame:
        """(at, url, x, foundOn): the objects of a list, x null in a line that goes on with the referrers of the object before it."""
        begins = self.begins.select(F.filter("_all", lambda b: b["name"] == name)[0]["at"].alias("_from"), F.array_min(F.filter("_all", lambda b: b["at"] > F.filter("_all", lambda o: o["name"] == name)[0]["at"])["at"]).alias("_to"))
        inside = self.lines.crossJoin(begins).where((F.col("at") > F.col("_from")) & (F.col("_to").isNull() | (F.col("at") < F.col("_to")))).select("at", "value")
        more, begun = F.startswith("value", F.lit(',"')), F.regexp_replace("value", "^,", "")
        own = inside.where(~more & F.col("value").contains("{"))
        closed = F.endswith("value", F.lit("}"))
        objects = own.select("at", F.from_json(F.when(closed, begun).otherwise(F.concat(begun, F.lit("]}"))), kind).alias("x"), (~closed).alias("_open"))
        if "foundOn" not in kind:
            return objects.select("at", "x")
        whole = objects.where("not _open").select("at", "x.url", "x", "x.foundOn")
        # an object that goes on in other lines is the last one begun before them; all others stay out of these sums
        long = ranked(inside.where(more).select("at", F.lit(None).cast(kind).alias("x"), "value").unionByName(objects.where("_open").select("at", "x", F.lit("").alias("value"))), ["at"], "line")
        long = Tables(self.lines.sparkSession).write(running_sum(long, F.col("x").isNotNull().cast("int"), "_object"), "long-lists")
        urls = long.where("x is not null").select("_object", "x.url")
        rest = F.from_json(F.concat(F.lit("["), F.regexp_replace(F.substring("value", 2, 1 << 30), r"\]\}$", ""), F.lit("]")), "array<string>")
        return whole.unionByName(long.join(urls, "_object").select("at", "url", "x", F.when(F.col("x").isNull(), rest).otherwise(F.col("x.foundOn")).alias("foundOn")))


def _read(spark: SparkSession, folder: str, names: list[str]) -> _Parts:
    own = Tables(spark)
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = own.write(spark.read.text(folder).select(at.alias("at"), "value"), "lines")
    openers = {_opener(name): name for name in names}
    begins = lines.where(F.col("value").isin(list(openers))).select("at", F.regexp_extract("value", '"(.*)"', 1).alias("name"))
    return _Parts(lines, own.write(begins.groupBy().agg(F.collect_list(F.struct("at", "name")).alias("_all")), "begins"))  # as many as lists


_FLAGGED = ("errors", "suppressedErrors", "blocked")
_LISTS = ("internalPages", "externalLinks", "outOfScopeLinks", *_FLAGGED)


def _kind(column: str, schema: str = schemas.REPORT) -> str:
    """The type of a list's objects."""
    return StructType.fromDDL(schema)[column].dataType.elementType.simpleString()


def read_report(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of ``readers.entities`` out of the parts that write_report left, and start_host; no task holds more than a line of the document.

    Lines are pieces as they were written: an object, or the beginning or more of its referrers.
    """
    parts = _read(spark, folder, list(_LISTS))
    items = {name: parts.items(name, _kind(name)) for name in _LISTS}
    rows = {name: items[name].where("x is not null").select("at", "x.*") for name in _LISTS}

    def flagged(name: str) -> DataFrame:
        return rows[name].select("url", "reason", F.coalesce(F.get("foundOn", F.lit(0)), F.lit("")).alias("source"), F.coalesce("kind", F.lit("internal")).alias("kind"), F.lit("blocked" if name == "blocked" else "broken").alias("disposition"))

    found = None
    for name in _LISTS[1:]:
        one = items[name].select(F.col("url").alias("target"), "at", F.posexplode("foundOn").alias("pos", "referrer"))
        found = one if found is None else found.unionByName(one)
    first = lambda name: rows[name].agg(F.min_by("url", "at").alias(name))
    host = F.lower(F.regexp_extract(F.coalesce("internalPages", "errors"), schemas.HOST, 1)).alias("host")
    return {
        "pages": rows["internalPages"].drop("at"),
        "external": rows["externalLinks"].select("url", "host", "status"),
        "out_of_scope": rows["outOfScopeLinks"].select("url"),
        "flagged": flagged(_FLAGGED[0]).unionByName(flagged(_FLAGGED[1])).unionByName(flagged(_FLAGGED[2])),
        "refs": found.groupBy("target", "referrer").agg(F.min(F.struct("at", "pos")).alias("first_seen")),
        "start_host": first("internalPages").crossJoin(first("errors")).select(host),
    }


def read_browser(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The lists of the smaller document's parts: pages, externals (url, host, n: how many referrers), errors, refs (target, referrer)."""
    parts = _read(spark, folder, ["pages", "externals", "errors"])
    items = parts.items("externals", "struct<url:string,host:string,foundOn:array<string>>")
    pages, errors = parts.items("pages", _kind("internalPages")), parts.items("errors", "struct<url:string,reason:string,source:string>")
    n = F.sum(F.size("foundOn").cast("long")).alias("n")
    return {
        "pages": pages.select("x.*"), "errors": errors.select("x.*"), "externals": items.groupBy("url").agg(F.max("x.host").alias("host"), n),
        "refs": items.select(F.col("url").alias("target"), F.explode("foundOn").alias("referrer")),
    }

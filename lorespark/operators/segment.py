"""Documents to segments: pages, contents entries, headings, segments.

All state is inside one document, so everything is an array expression over its row: one
scan, no shuffle, and one explode of what is finished. It is an outer one, which plans no
test of the array below the steps that make it. Functions with ``docs`` take rows
(doc_id, text, ...) and keep ``keep``, the columns named beside doc_id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from lorespark.functions.scalars import NOISE, segment_id, strip

_BREAK = "<<<PAGE_BREAK>>>"
#: What separates pages, in the order in which it is replaced; a contents line; titles that aren't headings.
PAGE_BREAKS = [r"\f", r"\r?\n[-─═]{20,}\r?\n", r"(?i)\r?\n\s*Page \d+\s*\r?\n", r"\r?\n[^\n]{3,60}\|[^\n]{5,30}\r?\n"]
_ENTRY = r"^(\s*)(.+?)\s{2,}(\d+)\s*$"
_CONTENTS = r"(?i)^(contents|table of contents)$"
_NO_HEADING = r"(?i)^(contents|table of contents|important links|frequently asked questions)$"


def _none() -> Column:
    return F.array().cast("array<string>")


# Columns


def marked_pages(text: Column) -> Column:
    """The text cut at page marks: trimmed pages, empty ones dropped."""
    for pattern in PAGE_BREAKS:
        text = F.regexp_replace(text, pattern, f"\n{_BREAK}\n")
    return F.filter(F.transform(F.split(text, _BREAK), strip), lambda p: p != "")


def counted_pages(text: Column, per_page: int) -> Column:
    """Every ``per_page`` lines."""

    def pages(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / per_page).cast("int"))
        return F.transform(starts, lambda k: F.array_join(F.slice(lines, k * per_page + 1, per_page), "\n"))

    return F.get(F.transform(F.array(F.split(text, "\n")), pages), F.lit(0))  # a text is split once, not once a page


def _first(lines: Column, test) -> Column:
    """The number of the first line (structs with ``i``) that passes; null if none does."""
    return F.get(F.filter(lines, test), F.lit(0))["i"]


def _entries(lines: Column) -> Column:
    """Contents entries (line_no, indent, heading) of lines (i, line, t) after the contents header."""
    misses = F.struct(F.lit(0).alias("run"), F.lit(0).alias("k"), F.lit(-1).alias("end"))

    def step(a, x):
        hit = x["line"].rlike(_ENTRY)
        run = F.when(hit, 0).otherwise(a["run"] + 1)
        return F.struct(
            F.when(a["end"] >= 0, a["run"]).otherwise(run).alias("run"), (a["k"] + 1).alias("k"), F.when((a["end"] < 0) & (run > 3), a["k"]).otherwise(a["end"]).alias("end")
        )

    end = F.aggregate(lines, misses, step, lambda a: F.when(a["end"] >= 0, a["end"]).otherwise(a["k"]))
    hits = F.filter(F.slice(lines, F.lit(1), end), lambda x: x["line"].rlike(_ENTRY))
    entry = F.transform(hits, lambda x: F.struct(x["i"].alias("line_no"), F.length(F.regexp_extract(x["line"], _ENTRY, 1)).alias("indent"), strip(F.regexp_extract(x["line"], _ENTRY, 2)).alias("heading")))
    return F.filter(entry, lambda e: ~e["heading"].rlike(_NO_HEADING))


def _with_entries(docs: DataFrame) -> DataFrame:
    """``docs`` with ``toc``: the lines of the contents page that end in a page number.

    It starts after the first contents line and ends at a form feed, a page footer or the
    fourth line in a row without a page number; blank lines don't count.
    """
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"), strip(x).alias("t")))
    x = docs.withColumn("toc", line).withColumn("toc_start", _first(F.col("toc"), lambda x: x["t"].rlike(_CONTENTS)))
    after = F.when(F.col("toc_start").isNotNull(), F.slice("toc", F.col("toc_start") + 2, F.size("toc")))
    x = x.withColumn("toc", after).withColumn("toc_stop", _first(F.col("toc"), lambda x: x["line"].rlike(r"^\f") | x["t"].rlike(r"^--\s*\d+")))
    body = F.slice("toc", F.lit(1), F.coalesce(F.col("toc_stop") - F.col("toc_start") - 1, F.size("toc")))
    x = x.withColumn("toc", F.filter(body, lambda x: x["t"] != ""))
    return x.withColumn("toc", _entries(F.col("toc"))).drop("toc_start", "toc_stop")


def _with_headings(docs: DataFrame, tolerance: int = 1) -> DataFrame:
    """``docs`` with ``headings``: distinct entries indented by the least indent plus the tolerance at most."""
    x = _with_entries(docs)
    least = F.array_repeat(F.array_min(F.transform("toc", lambda e: e["indent"])), F.size("toc"))
    own = F.zip_with("toc", least, lambda e, m: F.when(e["indent"] <= m + tolerance, e["heading"]))
    return x.withColumn("headings", F.coalesce(F.array_distinct(F.array_compact(own)), _none())).drop("toc")


FEW = 32  # headings that a line is compared with one by one


def _among(lines: pd.Series, headings: pd.Series) -> pd.Series:
    """For each line whether it is one of the headings: a hash set a document."""
    return pd.Series([None if own is None else (lambda known: [t in known for t in own])(set(told)) for own, told in zip(lines, headings, strict=True)])


def is_heading(lines: Column) -> Column:
    """For each of the trimmed ``lines`` whether it is one of the document's ``headings``: one pass, whatever their number."""
    many = F.size("headings") > FEW
    by_set = F.pandas_udf(_among, ArrayType(BooleanType())).asNondeterministic()(F.when(many, lines), F.when(many, F.col("headings")))
    return F.when(many, by_set).otherwise(F.transform(lines, lambda t: F.array_contains(F.col("headings"), t)))


def _with_body(docs: DataFrame, per_page: int = 300, tolerance: int = 1) -> DataFrame:
    """``docs`` with ``headings``, ``pages`` and ``first``: the first page that holds a heading line, 0 if none does."""
    x = _with_headings(docs, tolerance).withColumn("pages", marked_pages(F.col("text")))
    x = x.withColumn("pages", F.when(F.size("pages") > 1, F.col("pages")).otherwise(counted_pages(F.col("text"), per_page)))
    # all lines in a row with their pages; the first that is a heading tells the page
    lines = F.flatten(F.transform("pages", lambda p, i: F.transform(F.split(p, "\n"), lambda s: F.struct(i.alias("page"), strip(s).alias("t")))))
    x = x.withColumn("own", lines)
    found = F.array_position(is_heading(F.transform("own", lambda s: s["t"])), True).cast("int")
    return x.withColumn("first", F.coalesce(F.get("own", found - 1)["page"], F.lit(0)).cast("int")).drop("own")


# Tables


def split_pages(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page, content): texts cut at page marks, trimmed, empty ones dropped, numbered from 0."""
    return docs.select("doc_id", *keep, F.posexplode(marked_pages(F.col("text"))).alias("page", "content"))


def fixed_pages(docs: DataFrame, per_page: int = 300, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page, content): every ``per_page`` lines."""
    return docs.select("doc_id", *keep, F.posexplode(counted_pages(F.col("text"), per_page)).alias("page", "content"))


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line), numbered from 0."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def toc_entries(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, indent, heading) of contents entries."""
    return _with_entries(docs).select("doc_id", F.inline_outer("toc")).where("heading is not null")


def toc_headings(docs: DataFrame, tolerance: int = 1) -> DataFrame:
    """(doc_id, heading): what may open a segment."""
    return _with_headings(docs, tolerance).select("doc_id", F.explode_outer("headings").alias("heading")).where("heading is not null")


def skip_preamble(docs: DataFrame, per_page: int = 300) -> DataFrame:
    """(doc_id, page, content): the pages from the first that holds a heading line; all, if none does."""
    x = _with_body(docs, per_page).select("doc_id", "first", F.posexplode_outer("pages").alias("page", "content"))
    return x.where("page >= first").drop("first")


def outline(docs: DataFrame, title: Column | None = None, per_page: int = 300, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, segs): a document's segments (seg, heading, content, page_start, page_end) as one array.

    A heading line opens a segment and is its first line; text before the first stands
    under the title as segment 0. Noise lines are dropped. Pages count from 1, noise or
    not: a segment ends on the page where the next one opens, the last on the last page.
    """
    x = docs.withColumn("title", title if title is not None else F.lit("document"))
    x = _with_body(x, per_page)
    line = lambda p, i: F.transform(F.split(p, "\n"), lambda s: F.struct((i + F.col("first") + 1).alias("page"), s.alias("line"), strip(s).alias("t")))
    body = F.flatten(F.transform(F.slice("pages", F.col("first") + 1, F.size("pages")), line))
    x = x.withColumn("n_pages", F.size("pages")).withColumn("lines", F.filter(body, lambda s: ~s["t"].rlike(NOISE))).drop("pages")
    x = x.withColumn("opens", is_heading(F.transform("lines", lambda s: s["t"])))
    x = x.withColumn("starts", F.array_compact(F.transform("opens", lambda o, i: F.when(o, i + 1)))).drop("opens")
    # text before the first heading is segment 0
    x = x.withColumn("early", (F.size("lines") > 0) & (F.coalesce(F.get("starts", F.lit(0)), F.lit(0)) != 1))
    x = x.withColumn("starts", F.when(F.col("early"), F.concat(F.array(F.lit(1)), F.col("starts"))).otherwise(F.col("starts")))
    at = lambda k: F.get("lines", k - 1)

    def segment(s, k):
        root = F.col("early") & (k == 0)
        after = F.get("starts", k + 1)
        own = F.slice("lines", s, F.coalesce(after, F.size("lines") + 1) - s)
        return F.struct(
            F.when(F.col("early"), k).otherwise(k + 1).cast("long").alias("seg"),
            F.when(root, F.col("title")).otherwise(at(s)["t"]).alias("heading"),
            F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("content"),
            F.when(root, F.col("first") + 1).otherwise(at(s)["page"]).cast("long").alias("page_start"),
            F.coalesce(at(after)["page"], F.col("n_pages")).cast("long").alias("page_end"),
        )

    return x.withColumn("segs", F.transform("starts", segment)).select("doc_id", *keep, "segs")


def rows_of(outlines: DataFrame) -> DataFrame:
    """An outline's segments as rows."""
    return outlines.select(*[c for c in outlines.columns if c != "segs"], F.inline_outer("segs")).where("seg is not null")


def heading_segments(docs: DataFrame, title: Column | None = None, per_page: int = 300) -> DataFrame:
    """(doc_id, seg, heading, content, page_start, page_end)."""
    return rows_of(outline(docs, title, per_page))


def long_enough(content: Column, least: int = 300) -> Column:
    """Whether a segment stays: ``least`` characters or more without white space at its ends."""
    return F.length(strip(content)) >= least


def drop_short(outlines: DataFrame, least: int = 300) -> DataFrame:
    """Segments under ``least`` characters vanish."""
    return outlines.withColumn("segs", F.filter("segs", lambda s: long_enough(s["content"], least)))


def merge_short(outlines: DataFrame, least: int = 300) -> DataFrame:
    """Segments under ``least`` characters join the one before; a first short one stands until a long one follows."""
    opens = F.transform("segs", lambda s, i: F.when((i == 0) | (F.length(strip(s["content"])) >= least), i + 1))
    x = outlines.withColumn("opens", F.array_compact(opens))
    x = x.withColumn("parts", F.transform("opens", lambda s, k: F.slice("segs", s, F.coalesce(F.get("opens", k + 1), F.size("segs") + 1) - s)))

    def joined(own):
        head, content = own[0], F.array_join(F.transform(own, lambda x: x["content"]), "\n")
        return F.struct(head["seg"].alias("seg"), head["heading"].alias("heading"), content.alias("content"), head["page_start"].alias("page_start"), F.element_at(own, -1)["page_end"].alias("page_end"))

    return x.withColumn("segs", F.transform("parts", joined)).drop("opens", "parts")


def split_long(segments: DataFrame, most: int = 8000) -> DataFrame:
    """Rows with ``heading_path``, ``part`` and ``content``: paragraphs packed greedily; a part closes before it would exceed ``most``.

    What is split has ``Part k`` at the end of its heading path; pages and the other columns stay.
    """
    paragraphs = F.split(strip(F.col("content")), r"\n\s*\n")
    start = F.struct(_none().alias("parts"), _none().alias("open"), F.lit(0).alias("size"))

    def step(acc, p):
        full = (acc["size"] + F.length(p) > most) & (F.size(acc["open"]) > 0)
        return F.struct(
            F.when(full, F.concat(acc["parts"], F.array(F.array_join(acc["open"], "\n")))).otherwise(acc["parts"]).alias("parts"),
            F.when(full, F.array(p)).otherwise(F.concat(acc["open"], F.array(p))).alias("open"),
            F.when(full, F.length(p)).otherwise(acc["size"] + F.length(p)).alias("size"),
        )

    packed = F.aggregate(paragraphs, start, step, lambda acc: F.concat(acc["parts"], F.array(F.array_join(acc["open"], "\n"))))
    x = segments.withColumn("parts", F.when(F.length(strip(F.col("content"))) <= most, F.array("content")).otherwise(packed))
    path = F.when(F.size("parts") > 1, F.array(F.col("heading"), F.concat(F.lit("Part "), (F.col("part") + 1).cast("string")))).otherwise(F.array("heading"))
    x = x.select(*[c for c in segments.columns if c != "content"], "parts", F.posexplode("parts").alias("part", "content"))
    return x.withColumn("heading_path", path).drop("parts")


def segments(docs: DataFrame, title: Column | None = None, per_page: int = 300, least: int = 300, keep: tuple[str, ...] = ()) -> DataFrame:
    """The whole chain: pages, preamble, headings, noise, short ones dropped, numbered from 0, with ids."""
    x = drop_short(outline(docs, title, per_page, keep), least)
    x = x.select("doc_id", *keep, F.posexplode_outer("segs").alias("index", "s")).where("index is not null").select("doc_id", *keep, "index", "s.*")
    return x.withColumn("segment_id", segment_id(F.array("heading"), F.col("content")))


def segment_summary(segs: DataFrame) -> DataFrame:
    """Per document: segments, and the least, greatest and total length."""
    n = F.length("content")
    return segs.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"))


def segment_dump(segs: DataFrame) -> DataFrame:
    """``segs(source, seg, heading, content)`` with ``dump``: a header of four lines, a rule and the content."""
    told = lambda name, c: F.concat(F.lit(name + ": "), c.cast("string"))
    dump = F.concat_ws("\n", told("Heading", F.col("heading")), told("Source", F.col("source")), told("Index", F.col("seg")), told("Chars", F.length("content")), F.lit("---"), F.col("content"))
    return segs.withColumn("dump", dump)


def extraction_strategy(docs: DataFrame, counts: DataFrame, limit: int = 2 * 1024 * 1024) -> DataFrame:
    """``docs(doc_id, text, size_bytes)`` with ``strategy``: segmented where large enough, with text and a segment.

    ``counts(doc_id, n_segments)``, a row for each document that has segments.
    """
    x = docs.join(counts.select("doc_id", "n_segments").hint("shuffle_merge"), "doc_id", "left")
    many = (F.col("size_bytes") >= limit) & (F.length("text") > 200) & (F.coalesce("n_segments", F.lit(0)) >= 1)
    return x.withColumn("strategy", F.when(many, "segmented").otherwise("single")).drop("n_segments")

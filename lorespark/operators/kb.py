"""Chunks, their Markdown, the manifest and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.scalars import base_name, chunk_id, normalize_related, strip


def _one_line(c: Column) -> Column:
    """White space as single spaces: front matter and index hold it on one line."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def extract_procedures(segs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deterministic chunks of ``segs(source, heading, content)``: one for each segment.

    Topic is the heading, summary the first sentence; triggers are the heading, the summary
    and the last line; conditions and constraints are the sentences that say so. Nothing is cut.
    """
    sentences = F.split("content", r"[.!?]\s+")
    first = _one_line(F.split("content", r"[.!?]\s+", 2)[0])
    told = lambda rule: F.nullif(F.array_join(F.filter(sentences, lambda s: s.rlike(rule)), ". "), F.lit(""))
    conditions = told(r"(?i)\b(if|when|wenn|si|quand)\b")
    return segs.select(
        "source",
        F.col("heading").alias("topic"),
        first.alias("summary"),
        F.array("heading", first, F.substring_index(strip(F.col("content")), "\n", -1)).alias("triggers"),
        conditions.isNotNull().alias("has_conditions"),
        conditions.alias("conditions"),
        told(r"(?i)\b(cannot|must not|locked)\b").alias("constraints"),
        F.col("content").alias("response"),
        F.concat(F.lit("From "), F.col("source")).alias("context"),
        *keep,
    )


def assign_chunk_ids(chunks: DataFrame, position: str = "position") -> DataFrame:
    """Stable ids; of chunks with one id the last stays."""
    x = chunks.withColumn("chunk_id", chunk_id(F.col("source"), F.col("topic")))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc(position)))).where("r = 1").drop("r")


def markdown(c: dict[str, Column] | None = None) -> Column:
    """A chunk's Markdown from its columns."""
    g = lambda n: (c or {}).get(n, F.col(n))
    empty = F.array().cast("array<string>")
    head = F.array(
        F.lit("---"), F.concat(F.lit("chunk_id: "), g("chunk_id")), F.concat(F.lit("source: "), g("source")), F.concat(F.lit("topic: "), g("topic")),
        F.lit("summary: >"), F.concat(F.lit("  "), g("summary")), F.lit("triggers:"),
    )
    triggers = F.transform(g("triggers"), lambda t: F.concat(F.lit('  - "'), F.replace(t, F.lit('"'), F.lit("'")), F.lit('"')))
    flags = F.array(F.concat(F.lit("has_conditions: "), g("has_conditions").cast("string")), F.lit("related_chunks:"))
    related = F.transform(F.coalesce(g("related_chunks"), empty), lambda t: F.concat(F.lit("  - "), t))
    body = F.array(F.concat(F.lit("status: "), g("status")), F.lit("---"), F.lit(""), F.lit("## Context"), F.lit(""), strip(g("context")), F.lit(""), F.lit("## Response"), F.lit(""))
    part = lambda title, col: F.array(F.lit(title), F.lit(""), strip(col), F.lit(""))
    has = lambda col: F.coalesce(col, F.lit("")) != ""
    conditions = F.when(g("has_conditions") & has(g("conditions")), part("### Conditions", g("conditions"))).otherwise(empty)
    constraints = F.when(has(g("constraints")), part("#### Constraints", g("constraints"))).otherwise(empty)
    return F.array_join(F.concat(head, triggers, flags, related, body, conditions, constraints, F.array(strip(g("response")), F.lit(""))), "\n")


#: Fixed value: the lines before an index's entries.
INDEX_HEADER = "# Knowledge Base Guide Index\n# Auto-generated from chunk front matter — do not edit manually\n# Source of truth: individual chunk .md files in data/chunks/\n\nchunks:\n"


def index_entry() -> Column:
    """An index entry's text block from its columns."""
    lines = F.concat(
        F.array(
            F.concat(F.lit("  - chunk_id: "), F.col("chunk_id")), F.concat(F.lit("    source: "), F.col("source")), F.concat(F.lit("    topic: "), F.col("topic")),
            F.lit("    summary: >"), F.concat(F.lit("      "), F.col("summary")), F.lit("    triggers:"),
        ),
        F.transform("triggers", lambda t: F.concat(F.lit('      - "'), F.replace(t, F.lit('"'), F.lit("'")), F.lit('"'))),
        F.array(F.concat(F.lit("    has_conditions: "), F.col("has_conditions").cast("string")), F.lit("    related_chunks:")),
        F.transform("related_chunks", lambda t: F.concat(F.lit("      - "), t)),
        F.array(F.concat(F.lit("    status: "), F.col("status")), F.lit("")),
    )
    return F.array_join(lines, "\n")


#: The front matter of a chunk file, its fields and the items of its lists.
FRONT_MATTER = r"(?s)^---\n(.*?)\n---"
FIELDS = {
    "chunk_id": r"(?m)^chunk_id:\s*(.+)$",
    "source": r"(?m)^source:\s*(.+)$",
    "topic": r"(?m)^topic:\s*(.+)$",
    "summary": r"(?m)^summary:\s*>\s*\n\s+(.+)$",
    "has_conditions": r"(?m)^has_conditions:\s*(true|false)$",
    "status": r"(?m)^status:\s*(\w+)$",
}
LISTS = {"triggers": r"(?m)^triggers:\s*\n((?:\s+- .+\n?)*)", "related_chunks": r"(?m)^related_chunks:\s*\n((?:\s+- .+\n?)*)"}
QUOTED, PLAIN = r'(?m)- "?(.+?)"?\s*$', r"(?m)- (.+?)\s*$"


def parse_front_matter(files: DataFrame) -> DataFrame:
    """``files(file, raw)`` with the front matter's eight columns and their defaults."""
    text = lambda name: F.regexp_extract("fm", FIELDS[name], 1)
    field = lambda name, default="": F.coalesce(F.nullif(strip(text(name)), F.lit("")), F.lit(default)).alias(name)
    items = lambda name, form: F.regexp_extract_all(F.regexp_extract("fm", LISTS[name], 1), F.lit(form), 1)
    return files.withColumn("fm", F.regexp_extract("raw", FRONT_MATTER, 1)).select(
        "file",
        "raw",
        F.col("raw").rlike(FRONT_MATTER).alias("has_front_matter"),
        field("chunk_id"),
        field("source", "unknown"),
        field("topic"),
        field("summary"),
        F.transform(items("triggers", QUOTED), strip).alias("triggers"),
        (text("has_conditions") == "true").alias("has_conditions"),
        normalize_related(items("related_chunks", PLAIN)).alias("related_chunks"),
        field("status", "active"),
    )


def chunk_issues(x: DataFrame) -> DataFrame:
    """``issues`` and ``passed`` of parsed chunks: schema, sections and the conditions rule, as text tests."""
    bad = lambda cond, msg: F.when(cond, F.lit(msg))
    issues = F.array_compact(
        F.array(
            bad(F.col("chunk_id") == "", "chunk_id: empty"),
            bad((F.col("chunk_id") != "") & ~F.col("chunk_id").rlike("^[a-z0-9-]+$"), "chunk_id: not lower case and hyphens"),
            bad(F.col("topic") == "", "topic: empty"),
            bad(F.col("summary") == "", "summary: empty"),
            bad(~F.col("status").isin("active", "review", "deprecated"), "status: unknown"),
            bad(~F.contains(F.col("raw"), F.lit("## Context")), "section: Context"),
            bad(~F.contains(F.col("raw"), F.lit("## Response")), "section: Response"),
            bad(F.col("has_conditions") & ~F.contains(F.col("raw"), F.lit("## Conditions")), "section: Conditions"),
        )
    )
    issues = F.when(F.col("has_front_matter"), issues).otherwise(F.array(F.lit("front matter: missing")))
    return x.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


def validate_chunks(files: DataFrame) -> DataFrame:
    """Active chunks with what is wrong with them."""
    return chunk_issues(parse_front_matter(files)).where("status = 'active'").select("file", "chunk_id", "passed", "issues")


def validation_counts(results: DataFrame) -> DataFrame:
    """(issue, n) of ``results(passed, issues)``: how many chunks have each issue, and how many ``passed``."""
    told = F.when(F.col("passed"), F.array(F.lit("passed"))).otherwise(F.col("issues"))
    return results.select(F.explode(told).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def mark_review(files: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Raw texts, in which failed chunks' first status line says review: those of ``results``, or else what ``validate_chunks`` finds, each in its own row without a join."""
    if results is None:
        x = chunk_issues(parse_front_matter(files)).withColumn("failed", (F.col("status") == "active") & ~F.col("passed"))
    else:
        failed = results.where("not passed").select("file", F.lit(True).alias("failed"))
        x = files.join(failed.hint("shuffle_merge"), "file", "left")
    at = F.regexp_instr("raw", F.lit(r"(?m)^status:.*$"))
    line = F.regexp_substr("raw", F.lit(r"(?m)^status:.*$"))
    marked = F.concat(F.substr("raw", F.lit(1), at - 1), F.lit("status: review"), F.substr("raw", at + F.length(line)))
    return x.select("file", F.when(F.coalesce("failed", F.lit(False)) & (at > 0), marked).otherwise(F.col("raw")).alias("raw"))


def _entries(files: DataFrame) -> DataFrame:
    """Parsed files with id and topic."""
    return parse_front_matter(files).where("chunk_id <> '' and topic <> ''")


def rebuild_index(files: DataFrame) -> DataFrame:
    """Entries of active chunks with id and topic."""
    x = _entries(files).where("status = 'active'")
    return x.select("file", "chunk_id", "source", "topic", "summary", "triggers", "has_conditions", "related_chunks", "status")


def index_size() -> Column:
    """Characters of the whole index text of a table of entries: the header, and each entry after a line break."""
    return F.lit(len(INDEX_HEADER)) + F.coalesce(F.sum(F.length(index_entry()) + 1), F.lit(0))


def index_stats(files: DataFrame) -> DataFrame:
    """One row: entries kept by status, files skipped for their status, characters of the rebuilt index.

    Only active entries are kept, so review and deprecated are 0; files without id or topic are no entries at all.
    """
    x = _entries(files)
    kept = F.col("status") == "active"
    n = lambda s: F.count_if(kept & (F.col("status") == s)).alias(s)
    size = F.lit(len(INDEX_HEADER)) + F.coalesce(F.sum(F.when(kept, F.length(index_entry()) + 1)), F.lit(0))
    return x.agg(n("active"), n("review"), n("deprecated"), F.count_if(~kept).alias("skipped"), size.alias("size_chars"))


def index_guards(entries: DataFrame, most_chunks: int = 80, most_chars: int = 30_000) -> DataFrame:
    """One row: whether an index has too many chunks or too many characters, of all its text."""
    x = entries.agg(F.count("*").alias("chunks"), index_size().alias("size_chars"))
    return x.select("chunks", "size_chars", (F.col("chunks") > most_chunks).alias("many_chunks"), (F.col("size_chars") > most_chars).alias("large"))


def list_chunks(index: DataFrame) -> DataFrame:
    """(chunk_id, topic, summary, status, n): chunks of all statuses, and how many there are."""
    total = index.agg(F.count("*").alias("n"))  # one row
    return index.select("chunk_id", "topic", "summary", "status").crossJoin(F.broadcast(total))


def active_count(entries: DataFrame) -> DataFrame:
    """One row: the index text's entries whose status line says active."""
    told = F.regexp_count(index_entry(), F.lit(r"(?m)^\s+status: active$"))
    return entries.agg(F.coalesce(F.sum(told), F.lit(0)).cast("long").alias("active"))


def validate_index(entries: DataFrame) -> DataFrame:
    """``entries`` with ``issues``: the fields of eight that aren't as they should be; entries without id aren't looked at."""
    bad = lambda c, n: F.when(F.coalesce(c, F.lit(True)), F.lit(n))
    issues = [bad(~F.col("chunk_id").rlike("^[a-z0-9-]+$"), "chunk_id")]
    issues += [bad(F.col(c) == "", c) for c in ("source", "topic", "summary")]
    issues += [F.when(F.col(c).isNull(), F.lit(c)) for c in ("triggers", "has_conditions", "related_chunks")]
    issues += [bad(~F.col("status").isin("active", "review", "deprecated"), "status")]
    return entries.where("chunk_id <> ''").withColumn("issues", F.array_compact(F.array(*issues)))


#: The sections that a chunk file is looked through for.
SECTIONS = ("## Context", "## Response", "## Escalation")


def required_sections(files: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(file, section, passed) for each file and section."""
    x = files.select("file", "raw", F.explode(F.array(*[F.lit(s) for s in sections])).alias("section"))
    return x.select("file", "section", F.contains("raw", F.col("section")).alias("passed"))


def front_matter_checks(files: DataFrame) -> DataFrame:
    """(file, passed, detail): each file's first schema issue."""
    x = chunk_issues(parse_front_matter(files))
    return x.select("file", "passed", F.coalesce(F.get("issues", F.lit(0)), F.lit("")).alias("detail"))


def related_prefix_check(files: DataFrame) -> DataFrame:
    """(file, passed): no link line that holds the field's name."""
    return files.select("file", (~F.col("raw").rlike("(?i)- chunk_id:")).alias("passed"))


def check_summary(files: DataFrame) -> DataFrame:
    """(name, total, passed, failed) of all checks of ``files`` in one pass, and of all together."""
    x = chunk_issues(parse_front_matter(files))
    check = lambda name, ok: F.struct(F.lit(name).alias("name"), ok.alias("passed"))
    checks = [check("front_matter", F.col("passed")), check("related_prefix", ~F.col("raw").rlike("(?i)- chunk_id:"))]
    checks += [check("section " + s[3:], F.contains("raw", F.lit(s))) for s in SECTIONS]
    x = x.select(F.inline(F.array(*checks))).rollup("name").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return x.withColumn("name", F.coalesce("name", F.lit("all")))


def index_consistency(index: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk_id, label): index entries without a chunk file, chunk files without an entry, or ok."""
    i = index.select(F.col("chunk_id").alias("i")).distinct()
    c = parse_front_matter(files).where("chunk_id <> ''").select(F.col("chunk_id").alias("c")).distinct()
    label = F.when(F.col("c").isNull(), "entry without chunk").when(F.col("i").isNull(), "chunk without entry").otherwise("ok")
    return i.join(c.hint("shuffle_merge"), F.col("i") == F.col("c"), "full").select(F.coalesce("i", "c").alias("chunk_id"), label.alias("label"))


# The manifest: (path, hash, extracted_at, chunk_ids, size_bytes, position)


def hash_sources(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size_bytes"))


def changed_sources(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, label): unchanged only with an equal hash and chunks on record."""
    old = manifest.select("path", F.col("hash").alias("old"), F.size("chunk_ids").alias("n"))
    x = hash_sources(docs).join(old.hint("shuffle_merge"), "path", "left")
    label = F.when(F.col("old").isNull(), "new").when((F.col("old") == F.col("hash")) & (F.col("n") > 0), "unchanged").otherwise("changed")
    return x.select("path", label.alias("label"))


def drop_stale(index: DataFrame, manifest: DataFrame, changed: DataFrame) -> DataFrame:
    """The index without chunks of older versions of changed sources."""
    stale = manifest.join(changed.where("label = 'changed'").hint("shuffle_merge"), "path", "left_semi").select(F.explode("chunk_ids").alias("chunk_id"))
    return index.join(stale.hint("shuffle_merge"), "chunk_id", "left_anti")


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index (chunk_id, position, ...) after ``new`` (the same columns): in ``origin`` whether kept, updated or new.

    An entry of an id that is there already takes its place; others follow all that are
    there, in their own order (``added`` is true and ``position`` theirs). Of new ones with one id the last
    counts, at the first one's place.
    """
    both = index.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))
    own = Window.partitionBy("chunk_id")
    place = F.min(F.struct("added", "position")).over(own)
    rank = F.row_number().over(own.orderBy(F.desc("added"), F.desc("position")))
    x = both.withColumn("place", place).withColumn("rank", rank).where("rank = 1")
    origin = F.when(~F.col("added"), "kept").when(F.col("place.added"), "new").otherwise("updated")
    return x.withColumn("origin", origin).withColumn("added", F.col("place.added")).withColumn("position", F.col("place.position")).drop("place", "rank")


def upsert_counts(upserted: DataFrame) -> DataFrame:
    """One row: entries in all, new and updated ones."""
    return upserted.agg(F.count("*").alias("entries"), F.count_if(F.col("origin") == "new").alias("new"), F.count_if(F.col("origin") == "updated").alias("updated"))


def record_extraction(manifest: DataFrame, run: DataFrame) -> DataFrame:
    """Rows of sources that produced chunks replace the old ones; others keep theirs."""
    done = run.where("size(chunk_ids) > 0")
    return manifest.join(done.hint("shuffle_merge"), "path", "left_anti").unionByName(done)


def chunk_ids_for_source(paths: DataFrame, manifest: DataFrame) -> DataFrame:
    """``paths`` with ``chunk_ids``: empty where the manifest doesn't have the path."""
    return paths.join(manifest.select("path", "chunk_ids").hint("shuffle_merge"), "path", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def source_for_chunk(manifest: DataFrame, policy: str = "first") -> DataFrame:
    """(chunk_id, source): the first or the last source in the manifest's order that lists a chunk."""
    x = manifest.select("path", "position", F.explode("chunk_ids").alias("chunk_id"))
    pick = F.min_by("path", "position") if policy == "first" else F.max_by("path", "position")
    return x.groupBy("chunk_id").agg(F.substring_index(pick, "/", -1).alias("source"))


def delete_chunks(index: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk_id, label) of ``index`` and ``ids``: kept, deleted, or not found."""
    i, d = index.select("chunk_id").distinct().withColumn("had", F.lit(True)), ids.select("chunk_id").distinct().withColumn("asked", F.lit(True))
    label = F.when(F.col("asked").isNull(), "kept").when(F.col("had").isNull(), "not found").otherwise("deleted")
    return i.join(d.hint("shuffle_merge"), "chunk_id", "full").select("chunk_id", label.alias("label"))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """(file, n_chunks, extracted_at, size_kb, hash): a line for each source."""
    return manifest.select(
        base_name(F.col("path")).alias("file"), F.size("chunk_ids").cast("long").alias("n_chunks"), "extracted_at", F.round(F.col("size_bytes") / 1024.0, 1).alias("size_kb"), F.substring("hash", 1, 16).alias("hash")
    )


# Links between chunks


def related_from_clusters(clusters: DataFrame) -> DataFrame:
    """(chunk_id, related_chunks): the other members; of several clusters the last counts."""
    own = clusters.groupBy("id").agg(F.max("cluster").alias("cluster"))
    others = clusters.select("cluster", F.col("id").alias("other"))
    x = own.join(others.hint("shuffle_merge"), "cluster").where("id <> other")
    return x.groupBy(F.col("id").alias("chunk_id")).agg(F.array_sort(F.collect_list("other")).alias("related_chunks"))


def _relates(index: DataFrame, related: DataFrame) -> DataFrame:
    """One row: whether the relate pass changes anything, i.e. there are links and two active chunks."""
    some = related.agg((F.count("*") > 0).alias("some"))
    return index.agg((F.count_if(F.col("status") == "active") >= 2).alias("enough")).crossJoin(F.broadcast(some)).select((F.col("some") & F.col("enough")).alias("relates"))


def _linked(index: DataFrame, related: DataFrame) -> DataFrame:
    """``index`` with the links it gets, and ``relates``: whether the relate pass changes anything."""
    new = related.withColumnRenamed("related_chunks", "new")
    empty = F.array().cast("array<string>")
    x = index.join(new.hint("shuffle_merge"), "chunk_id", "left").crossJoin(F.broadcast(_relates(index, related)))
    set_anew = F.col("relates") & (F.col("status") == "active")
    return x.withColumn("related_chunks", F.when(set_anew, F.coalesce("new", empty)).otherwise(F.col("related_chunks"))).drop("new")


def apply_related(index: DataFrame, related: DataFrame) -> DataFrame:
    """Links of active chunks set anew: none where a chunk is in no cluster.

    Without any cluster, or with fewer than two active chunks, nothing changes.
    """
    return _linked(index, related).drop("relates")


def related_edges(index: DataFrame) -> DataFrame:
    """(chunk_id, related_id): a row for each link of ``index(chunk_id, related_chunks)``."""
    return index.select("chunk_id", F.explode("related_chunks").alias("related_id"))


def dangling_related(index: DataFrame) -> DataFrame:
    """(chunk_id, related_id): links of ``index(chunk_id, status, related_chunks)`` that lead to no active chunk."""
    active = index.where("status = 'active'").select(F.col("chunk_id").alias("related_id"))
    return related_edges(index).join(active.hint("shuffle_merge"), "related_id", "left_anti").select("chunk_id", "related_id")


def rewrite_related(files: DataFrame, related: DataFrame) -> DataFrame:
    """``files(file, raw)`` of active chunks with their link lines set anew, on the terms of ``apply_related``."""
    x = parse_front_matter(files).select("file", "raw", "chunk_id", "status")
    x = x.withColumn("related_chunks", F.array().cast("array<string>"))
    linked = _linked(x, related)
    lines = F.array_join(F.concat(F.array(F.lit("related_chunks:")), F.transform("related_chunks", lambda r: F.concat(F.lit("  - "), strip(F.regexp_replace(r, "(?i)^chunk_id:", ""))))), "\n")
    old = r"(?m)^related_chunks:(?:(?!^status:)[\s\S])*(?=^status:)"
    at, text = F.regexp_instr("raw", F.lit(old)), F.regexp_substr("raw", F.lit(old))
    new = F.concat(F.substr("raw", F.lit(1), at - 1), lines, F.lit("\n"), F.substr("raw", at + F.length(text)))
    return linked.select("file", F.when(F.col("relates") & (F.col("status") == "active") & (at > 0), new).otherwise(F.col("raw")).alias("raw"))

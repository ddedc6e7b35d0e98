"""Inputs derived from the given tables, in Spark and, with the same rule, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.scalars import chunk_id
from lorespark.operators import kb
from lorespark.operators.retrieve import SENT, sent
from lorespark.sources.sinks import written


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def source_docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, path, text)."""
    path = F.concat(F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), "text")


SOURCE_DOCS = "source_docs as (select doc_id, source || '/doc-' || doc_id || '.pdf' as path, text from documents)"


def _every(c, n: int, mark: str):
    """Lines rejoined with ``mark`` before every n-th."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x, i: F.when((i > 0) & (i % n == 0), F.concat(F.lit(mark), x)).otherwise(x)), "\n")


def doc_with_pages(spark: SparkSession, d: str) -> DataFrame:
    """A form feed before every 5th line."""
    return source_docs(spark, d).withColumn("text", _every(F.col("text"), 5, "\f"))


DOC_WITH_PAGES = SOURCE_DOCS + r""", docp as (select doc_id, path, array_to_string(list_transform(string_split(text, chr(10)),
  lambda x, i: case when i > 1 and (i - 1) % 5 = 0 then chr(12) || x else x end), chr(10)) as text from source_docs)"""


def with_toc(docs: DataFrame) -> DataFrame:
    """A contents page: the start of every 8th line at indent 0, of other 4th lines at indent 4; those starts repeated as heading lines."""
    lines = F.split("text", "\n")
    head = lambda x: F.regexp_replace(F.substring(x, 1, 24), r"^\s+|\s+$", "")
    entry = lambda x, i: F.when(i % 8 == 0, F.concat(head(x), F.lit("   "), (i + 1).cast("string"))).when(i % 4 == 0, F.concat(F.lit("    "), head(x), F.lit("   "), (i + 1).cast("string")))
    toc = F.array_join(F.array_compact(F.transform(lines, entry)), "\n")
    body = F.array_join(F.transform(lines, lambda x, i: F.when(i % 4 == 0, F.concat(head(x), F.lit("\n"), x)).otherwise(x)), "\n")
    return docs.withColumn("text", F.concat(F.lit("Contents\n"), toc, F.lit("\n-- 1 of 2 --\n\f"), body))


def doc_with_toc(spark: SparkSession, d: str) -> DataFrame:
    return with_toc(source_docs(spark, d))


DOC_WITH_TOC = SOURCE_DOCS + r""", doct as (select doc_id, path, 'Contents' || chr(10) || array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x, i: case when (i - 1) % 8 = 0 then regexp_replace(x[1:24], '^\s+|\s+$', '', 'g') || '   ' || i when (i - 1) % 4 = 0 then '    ' || regexp_replace(x[1:24], '^\s+|\s+$', '', 'g') || '   ' || i end),
  lambda y: y is not null), chr(10)) || chr(10) || '-- 1 of 2 --' || chr(10) || chr(12) || array_to_string(list_transform(string_split(text, chr(10)),
  lambda x, i: case when (i - 1) % 4 = 0 then regexp_replace(x[1:24], '^\s+|\s+$', '', 'g') || chr(10) || x else x end), chr(10)) as text from source_docs)"""


def _segs(docs: DataFrame, *keep: str) -> DataFrame:
    from lorespark.operators.segment import fixed_pages, long_enough

    x = fixed_pages(docs, 5, keep=("path", *keep)).withColumnRenamed("path", "source")
    heading = F.array_join(F.slice(F.split("content", r"\s+", 5), 1, 4), " ")
    return x.where(long_enough(F.col("content"))).select("doc_id", "source", F.col("page").alias("seg"), heading.alias("heading"), "content", *keep)


def segs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, seg, heading, content): pages of five lines under their first four words, short ones dropped as the segmentation does."""
    return _segs(source_docs(spark, d))


_FIXED = r"""fixed as (select doc_id, p as page, array_to_string(l[p * {n} + 1 : p * {n} + {n}], chr(10)) as content
  from (select doc_id, l, unnest(range(0, cast((len(l) - 1) // {n} as bigint) + 1)) as p from (select doc_id, string_split(text, chr(10)) as l from {src}))) """

SEGS = SOURCE_DOCS + ", " + _FIXED.format(n=5, src="source_docs") + r""", segs as (select f.doc_id, s.path as source, f.page as seg,
  array_to_string(regexp_split_to_array(content, '\s+')[1:4], ' ') as heading, content from fixed f join source_docs s using (doc_id) where length(regexp_replace(content, '^\s+|\s+$', '', 'g')) >= 300)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """``source_docs`` with the status that a document's labels give its chunks; ``doc_id`` as its path names it."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    doc = F.regexp_extract("path", r"doc-(\d+)\.pdf$", 1).try_cast("long")
    status = F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 0, "review").otherwise("active")
    x = source_docs(spark, d).withColumn("doc_id", doc).join(labels.hint("shuffle_merge"), "doc_id", "left")
    return x.withColumn("status", status).drop("toxic", "quality")


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with status and position: labels meet whole documents, so that no chunk is shuffled for them."""
    x = kb.extract_procedures(_segs(_labelled(spark, d), "status"), keep=("doc_id", "status"))
    return x.withColumn("position", F.concat_ws("/", "source", F.sha2("response", 256))).withColumn("related_chunks", F.array().cast("array<string>"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with ids, status and no links yet."""
    return kb.assign_chunk_ids(_drafts(spark, d)).drop("position")


def written_chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``columns`` of ``chunks``, worked out once and written where they are made: only ids and positions are shuffled, to find the rows whose id a later one has."""
    x = _drafts(spark, d).withColumn("chunk_id", chunk_id(F.col("source"), F.col("topic")))
    x = written(x.select(F.monotonically_increasing_id().alias("row"), "position", *columns), "chunks")
    later = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("position")))
    gone = written(x.select("row", "chunk_id", "position").withColumn("r", later).where("r > 1").select("row"), "chunks-gone")
    if gone.isEmpty():
        return x.select(*columns)
    kept = x.join(sent(gone), "row", "left_anti").select(*columns)
    return kept if gone.count() <= SENT else written(kept, "chunks-kept")


CHUNKS = SEGS + r""", told as (select *, regexp_split_to_array(content, '[.!?]\s+') as sent, regexp_replace(content, '^\s+|\s+$', '', 'g') as body from segs),
proc as (select source, heading as topic, trim(regexp_replace(sent[1], '\s+', ' ', 'g')) as summary,
  [heading, trim(regexp_replace(sent[1], '\s+', ' ', 'g')), string_split(body, chr(10))[-1]] as triggers,
  nullif(array_to_string(list_filter(sent, lambda s: regexp_matches(s, '(?i)\b(if|when|wenn|si|quand)\b')), '. '), '') as conditions,
  nullif(array_to_string(list_filter(sent, lambda s: regexp_matches(s, '(?i)\b(cannot|must not|locked)\b')), '. '), '') as constraints,
  content as response, 'From ' || source as context, source || '/' || sha256(content) as position from told),
slug as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(topic), '[^a-z0-9\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g')[1:50] as sl from proc),
ids as (select *, conditions is not null as has_conditions, regexp_replace(sl, '^-|-$', '', 'g') || '-' || sha256(regexp_extract(source, '[^/]*$') || topic)[1:8] as chunk_id from slug),
uniq as (select * from (select *, row_number() over (partition by chunk_id order by position desc) as r from ids) where r = 1),
lab as (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by 1),
chunks as (select u.*, case when toxic = 1 then 'deprecated' when quality = 0 then 'review' else 'active' end as status, cast([] as varchar[]) as related_chunks
  from uniq u left join lab on lab.doc_id = cast(regexp_extract(source, 'doc-(\d+)\.pdf$', 1) as bigint))"""


def chunk_md(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(file, raw) and ``more`` of the chunks' columns: Markdown of the chunks, with planted faults by document."""
    x = chunks(spark, d)
    m = lambda k: F.col("doc_id") % k == 0
    raw = kb.markdown({"chunk_id": F.when(m(11), F.upper("chunk_id")).otherwise(F.col("chunk_id")), "has_conditions": F.when(m(17), F.lit(True)).otherwise(F.col("has_conditions")),
                       "related_chunks": F.when(m(19), F.array(F.concat(F.lit("chunk_id:"), F.col("chunk_id")))).otherwise(F.col("related_chunks"))})
    raw = F.when(m(7), F.replace(raw, F.lit("## Response"), F.lit("## Answer"))).otherwise(raw)
    raw = F.when(m(13), F.replace(raw, F.lit("---\n"), F.lit("==\n"))).otherwise(raw)
    return x.select(F.concat("chunk_id", F.lit(".md")).alias("file"), raw.alias("raw"), *more)


_MD = r"""array_to_string(list_concat(['---', 'chunk_id: ' || {id}, 'source: ' || source, 'topic: ' || topic, 'summary: >', '  ' || summary, 'triggers:'],
  list_transform(triggers, lambda t: '  - "' || replace(t, '"', '''') || '"'), ['has_conditions: ' || cast({hc} as varchar), 'related_chunks:'], list_transform({rel}, lambda t: '  - ' || t),
  ['status: ' || status, '---', '', '## Context', '', regexp_replace(context, '^\s+|\s+$', '', 'g'), '', '## Response', ''],
  case when {hc} and coalesce(conditions, '') <> '' then ['### Conditions', '', regexp_replace(conditions, '^\s+|\s+$', '', 'g'), ''] else cast([] as varchar[]) end,
  case when coalesce(constraints, '') <> '' then ['#### Constraints', '', regexp_replace(constraints, '^\s+|\s+$', '', 'g'), ''] else cast([] as varchar[]) end,
  [regexp_replace(response, '^\s+|\s+$', '', 'g'), '']), chr(10))"""

MARKDOWN = CHUNKS + ", md as (select chunk_id, " + _MD.format(id="chunk_id", hc="has_conditions", rel="related_chunks") + " as markdown from chunks)"

CHUNK_MD = CHUNKS + r""", flt as (select *, cast(regexp_extract(source, 'doc-(\d+)\.pdf$', 1) as bigint) as doc from chunks),
bad as (select *, case when doc % 11 = 0 then upper(chunk_id) else chunk_id end as cid, case when doc % 17 = 0 then true else has_conditions end as hc,
  case when doc % 19 = 0 then ['chunk_id:' || chunk_id] else related_chunks end as rel from flt),
files as (select chunk_id || '.md' as file, case when doc % 13 = 0 then replace(rawx, '---' || chr(10), '==' || chr(10)) else rawx end as raw
  from (select *, case when doc % 7 = 0 then replace(m, '## Response', '## Answer') else m end as rawx from (select *, """ + _MD.format(id="cid", hc="hc", rel="rel") + r""" as m from bad))),
fmx as (select *, regexp_extract(raw, '(?s)^---\n(.*?)\n---', 1) as fm, regexp_matches(raw, '(?s)^---\n(.*?)\n---') as has_fm from files),
parsed as (select file, raw, has_fm, regexp_replace(regexp_extract(fm, '(?m)^chunk_id:\s*(.+)$', 1), '^\s+|\s+$', '', 'g') as chunk_id,
  coalesce(nullif(regexp_replace(regexp_extract(fm, '(?m)^source:\s*(.+)$', 1), '^\s+|\s+$', '', 'g'), ''), 'unknown') as source,
  regexp_replace(regexp_extract(fm, '(?m)^topic:\s*(.+)$', 1), '^\s+|\s+$', '', 'g') as topic,
  regexp_replace(regexp_extract(fm, '(?m)^summary:\s*>\s*\n\s+(.+)$', 1), '^\s+|\s+$', '', 'g') as summary,
  list_transform(regexp_extract_all(regexp_extract(fm, '(?m)^triggers:\s*\n((?:\s+- .+\n?)*)', 1), '(?m)- "?(.+?)"?\s*$', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) as triggers,
  regexp_extract(fm, '(?m)^has_conditions:\s*(true|false)$', 1) = 'true' as has_conditions,
  list_transform(regexp_extract_all(regexp_extract(fm, '(?m)^related_chunks:\s*\n((?:\s+- .+\n?)*)', 1), '(?m)- (.+?)\s*$', 1), lambda x: regexp_replace(x, '(?i)^chunk_id:', '')) as related_chunks,
  coalesce(nullif(regexp_extract(fm, '(?m)^status:\s*(\w+)$', 1), ''), 'active') as status from fmx),
issues as (select *, case when not has_fm then ['front matter: missing'] else list_filter([case when chunk_id = '' then 'chunk_id: empty' end,
  case when chunk_id <> '' and not regexp_matches(chunk_id, '^[a-z0-9-]+$') then 'chunk_id: not lower case and hyphens' end, case when topic = '' then 'topic: empty' end,
  case when summary = '' then 'summary: empty' end, case when status not in ('active', 'review', 'deprecated') then 'status: unknown' end,
  case when not contains(raw, '## Context') then 'section: Context' end, case when not contains(raw, '## Response') then 'section: Response' end,
  case when has_conditions and not contains(raw, '## Conditions') then 'section: Conditions' end], lambda x: x is not null) end as issues from parsed)"""


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """(path, hash, extracted_at, size_bytes, chunk_ids, position) of an earlier run: documents not divisible by 4; by 5: changed since; by 9: no chunks."""
    x = source_docs(spark, d).where("doc_id % 4 <> 0")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("v0"))).otherwise(F.col("text"))
    ids = F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("c"), F.col("doc_id").cast("string")), F.concat(F.lit("shared-"), (F.col("doc_id") % 50).cast("string")))
    )
    at = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00.000Z"))
    return x.select("path", F.sha2(text, 256).alias("hash"), at.alias("extracted_at"), F.octet_length(text).cast("long").alias("size_bytes"), ids.alias("chunk_ids"), (-F.col("doc_id")).alias("position"))


MANIFEST = SOURCE_DOCS + r""", manifest as (select path, sha256(t) as hash, '2024-01-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') || 'T00:00:00.000Z' as extracted_at, strlen(t) as size_bytes, -doc_id as position,
  case when doc_id % 9 = 0 then cast([] as varchar[]) else ['c' || doc_id, 'shared-' || (doc_id % 50)] end as chunk_ids
  from (select *, case when doc_id % 5 = 0 then text || 'v0' else text end as t from source_docs where doc_id % 4 <> 0))"""


def request_log(spark: SparkSession, d: str, dense: bool = False) -> DataFrame:
    """Requests from ``events``; ``dense``: a request each second, for each 1000 of them three sessions."""
    e = table(spark, d, "events")
    ts, session = F.col("ts").cast("timestamp"), F.col("user_id")
    if dense:
        ts, session = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("event_id") * 1_000_000), F.floor(F.col("event_id") / 1000) * 3 + F.col("user_id") % 3
    return e.select(
        F.col("event_id").alias("req_id"), ts.alias("ts"), session.alias("session_id"), F.when(F.col("event_type") == "view", "clarify").otherwise("answer").alias("mode"),
        F.col("event_type").alias("question"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"), F.when(F.col("user_id") % 17 == 0, "invalid").when(F.col("event_id") % 23 == 0, "rate_limited").when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"),
    )


LOG = r"""log as (select event_id as req_id, ts, user_id as session_id, case when event_type = 'view' then 'clarify' else 'answer' end as mode, event_type as question,
  cast(floor(value * 1000) as bigint) as duration_ms, case when user_id % 17 = 0 then 'invalid' when event_id % 23 = 0 then 'rate_limited' when event_type = 'error' then 'error' else 'ok' end as outcome from events)"""
DENSE = r"""log as (select event_id as req_id, timestamp '2024-01-01' + to_seconds(event_id) as ts, event_id // 1000 * 3 + user_id % 3 as session_id from events)"""

_MESSAGES = ["Invalid API key", "Quota exceeded", "maximum context length", "Internal server error", "Request timeout", "Content too large", "Something else"]
_STATUS = [401, 429, 400, 503, 0, 413, 0]


def error_log(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, ts, message, status) of failing calls: a message that names the event, and a status that doesn't go with it."""
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    message = F.concat(F.col("event_type"), F.lit(" of "), F.col("user_id").cast("string"), F.lit(": "), pick(_MESSAGES, F.col("event_id") % 7), F.lit(" "), F.col("props"))
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), message.alias("message"), pick(_STATUS, F.floor(F.col("event_id") / 7) % 7).alias("status"))


ERRORS = f"""errs as (select event_id, ts, event_type || ' of ' || user_id || ': ' || ({_MESSAGES!r})[event_id % 7 + 1] || ' ' || props as message, ({_STATUS!r})[event_id // 7 % 7 + 1] as status from events)"""


def raw_responses(spark: SparkSession, d: str) -> DataFrame:
    """(id, k, raw): model responses made of the conversations' texts: seven types, one in an array, an unknown type, and none."""
    t = table(spark, d, "conversations").where("text is not null")
    ident, said = F.col("conv_id") * 1000 + F.col("turn"), F.split("text", r"[.!?]\s+")
    of = lambda kind, **data: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*[c.alias(n) for n, c in data.items()]).alias("data")))
    raw = [
        of("steps", title=F.col("role"), steps=F.transform(said, lambda s, i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("title"), s.alias("body")))),
        F.concat(F.lit("["), of("choices", question=F.col("text"), options=F.transform(said, lambda s: F.struct(s.alias("label")))), F.lit(',{"type":"nope"}]')),
        of("alert", severity=F.lit("info"), title=F.col("role"), body=F.col("text")),
        F.concat(F.lit("```json\n"), of("checklist", title=F.col("role"), items=said), F.lit("\n```")),
        of("escalation", reason=F.col("role"), summary=F.col("text")),
        of("summary", title=F.col("role"), body=F.concat(F.lit("As shown: "), F.col("text"))),
        of("text", body=F.col("text")),
        F.concat(F.lit('{"type":"image","data":{"n":'), ident.cast("string"), F.lit("}}")),
        F.concat(F.lit("No JSON: "), F.regexp_replace("text", r"[\[\]{}]", "")),
    ]
    k = ident % len(raw)
    x = F.lit(None).cast("string")
    for n, r in enumerate(raw):
        x = F.when(k == n, r).otherwise(x)
    return t.select(ident.alias("id"), k.alias("k"), x.alias("raw"))


RESPONSES = r"""resp as (select conv_id * 1000 + turn as id, (conv_id * 1000 + turn) % 9 as k, role, text, regexp_split_to_array(text, '[.!?]\s+') as said from conversations where text is not null)"""


def qna_sections(spark: SparkSession, d: str) -> DataFrame:
    """(source, heading, content): conversations as sections, a user's line as a question, with the answers below."""
    t = table(spark, d, "conversations").where("text is not null")
    line = F.when(F.col("role") == "user", F.concat(F.rtrim(F.regexp_replace("text", r"[?\s]+", " ")), F.lit("?"))).otherwise(F.col("text"))
    x = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    heading = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))
    return x.select(F.concat(F.lit("chat-"), F.col("conv_id").cast("string")).alias("source"), heading.alias("heading"), F.array_join(F.concat(F.array(heading), F.transform("l", lambda s: s["line"])), "\n").alias("content"))


QNA = r"""sect as (select 'chat-' || conv_id as source, 'Conversation ' || conv_id as heading, 'Conversation ' || conv_id || chr(10) || string_agg(case when role = 'user' then rtrim(regexp_replace(text, '[?\s]+', ' ', 'g')) || '?' else text end, chr(10) order by turn) as content
  from conversations where text is not null group by conv_id)"""

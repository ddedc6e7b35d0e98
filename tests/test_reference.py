"""Every registered query against its DuckDB SQL, and order-sensitive rules by hand."""

import math
import os

import duckdb
import pytest

from lorespark.functions import scalars as S
from lorespark.operators import kb, outputs, reports, requests, segment
from lorespark.plans import registry
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    x = registry.QUERIES[name](spark, DATA)
    columns = sorted(x.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in x.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    r = duck.sql(registry.ORACLE_SQL[name])
    at = [r.columns.index(c) for c in columns]
    assert sorted(r.columns) == columns
    assert got == sorted(repr(tuple(plain(row[k]) for k in at)) for row in r.fetchall())


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_slug_order_of_steps(spark):
    # the cut at 50 comes before the hyphens at the ends go
    assert one(spark, S.slugify(F.col("x")), x="  --Hello,  World!--  ") == "hello-world"
    assert one(spark, S.slugify(F.col("x")), x="a" * 49 + " b") == "a" * 49
    assert one(spark, S.slugify(F.col("x")), x="ÄÖ") == ""


def test_pages_of_table_rows_alternate(spark):
    # a row takes both its line breaks, so of rows in a row every other one is a mark
    d = spark.createDataFrame([(1, "top text\naaaa | bbbbbb\ncccc | dddddd\neeee | ffffff\nend")], "doc_id long, text string")
    assert [r.content for r in segment.split_pages(d).orderBy("page").collect()] == ["top text", "cccc | dddddd", "end"]


def test_contents_stop_rules(spark):
    text = "Contents\nIntro   1\nx\ny\nz\nNext   2\nx\ny\nz\nw\nLate   3"
    d = spark.createDataFrame([(1, text), (2, "Contents\nA   1\n-- 1 of 2 --\nB   2"), (3, "no contents\nA   1")], "doc_id long, text string")
    got = sorted((r.doc_id, r.heading) for r in segment.toc_entries(d).collect())
    assert got == [(1, "Intro"), (1, "Next"), (2, "A")]


def test_split_long_packs_paragraphs(spark):
    d = spark.createDataFrame([(1, 0, "Top", "aaaa\n\nbbbb\n\n" + "c" * 12 + "\n\ndd", 3, 5), (2, 0, "Whole", "x\n\ny", 1, 1)], "doc_id long, seg int, heading string, content string, page_start int, page_end int")
    got = [(r.doc_id, r.heading_path, r.content, r.page_start, r.page_end) for r in segment.split_long(d, 8).orderBy("doc_id", "part").collect()]
    assert got == [(1, ["Top", "Part 1"], "aaaa\nbbbb", 3, 5), (1, ["Top", "Part 2"], "c" * 12, 3, 5), (1, ["Top", "Part 3"], "dd", 3, 5), (2, ["Whole"], "x\n\ny", 1, 1)]


def test_segments_count_every_page(spark):
    """Pages of noise count, text before the first heading starts on the first page kept, the last segment ends on the last page."""
    text = "Contents\nAlpha   3\n    Sub   4\nBeta   5\n-- 1 of 2 --\n\fintro\nAlpha\nbody of alpha\n\f--\n\fBeta\nbody of beta\n\fcontents"
    d = spark.createDataFrame([(1, text), (2, "plain\ntext"), (3, None), (4, "")], "doc_id long, text string")
    got = [tuple(r) for r in segment.heading_segments(d).orderBy("doc_id", "seg").collect()]
    assert got == [(1, 0, "document", "intro", 2, 2), (1, 1, "Alpha", "Alpha\nbody of alpha", 2, 4), (1, 2, "Beta", "Beta\nbody of beta", 4, 5), (2, 0, "document", "plain\ntext", 1, 1)]


def test_short_segments_join_the_one_before(spark):
    segs = [(0, "a", "xx", 1, 1), (1, "b", "yy", 1, 2), (2, "c", "long one", 2, 3), (3, "d", "z", 3, 4)]
    kind = "doc_id long, segs array<struct<seg:bigint,heading:string,content:string,page_start:bigint,page_end:bigint>>"
    got = segment.rows_of(segment.merge_short(spark.createDataFrame([(1, segs)], kind), 5)).collect()
    assert [tuple(r)[1:] for r in got] == [(0, "a", "xx\nyy", 1, 2), (2, "c", "long one\nz", 2, 4)]


def test_segmentation_needs_no_shuffle(spark):
    plan = segment.segments(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('```json\n[{"a": "]"},]\n``` thanks', '[{"a": "]"}]'),
        ('say {"a": {"b": 1,},} end }', '{"a": {"b": 1}}'),
        ('{"a": "x\\"}"} y', '{"a": "x\\"}"}'),
        ("none", "none"),
        ('[{"a": 1', '[{"a": 1'),
    ],
)
def test_cleaning(raw, want):
    assert outputs.clean_output(raw) == want


def test_session_gap_is_strict(spark):
    rows = [(1, 7, 0, "ok"), (2, 7, 29 * 60, "timeout"), (3, 7, 59 * 60, "error"), (4, 7, 90 * 60, "ok"), (5, 7, 0, "ok")]
    rows += [(6, 7, 70 * 60, "invalid"), (7, 7, 75 * 60, "rate_limited")]  # turned away: no access
    log = spark.createDataFrame(rows, "req_id long, session_id long, s long, outcome string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.req_id: r.session_no for r in requests.sessionize(log).collect()}
    assert got == {1: 0, 5: 0, 2: 0, 3: 0, 4: 1}


def test_rejected_requests_dont_count(spark):
    rows = [(k, 1, k) for k in range(6)] + [(9, 1, 10)]
    log = spark.createDataFrame(rows, "req_id long, session_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.req_id: r.admitted for r in requests.rate_limit_decisions(log, 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 9: True}


def test_source_lookup_first_and_last(spark):
    m = spark.createDataFrame([("b/y.pdf", ["c", "d"], 0), ("a/x.pdf", ["c"], 1)], "path string, chunk_ids array<string>, position long")
    assert {r.chunk_id: r.source for r in kb.source_for_chunk(m, "first").collect()} == {"c": "y.pdf", "d": "y.pdf"}
    assert {r.chunk_id: r.source for r in kb.source_for_chunk(m, "last").collect()} == {"c": "x.pdf", "d": "y.pdf"}


def test_upsert_keeps_places(spark):
    old = spark.createDataFrame([("a", 0, 1), ("b", 1, 2)], "chunk_id string, position long, v int")
    new = spark.createDataFrame([("b", 0, 3), ("c", 1, 4), ("c", 2, 5)], "chunk_id string, position long, v int")
    once = kb.upsert(old, new)
    assert sorted((r.added, r.position, r.chunk_id, r.v, r.origin) for r in once.collect()) == [(False, 0, "a", 1, "kept"), (False, 1, "b", 3, "updated"), (True, 1, "c", 5, "new")]
    assert tuple(kb.upsert_counts(once).first()) == (3, 1, 1)
    again = kb.upsert(once.drop("origin", "added"), new)
    assert sorted((r.chunk_id, r.v) for r in again.collect()) == [("a", 1), ("b", 3), ("c", 5)]


def chunk_file(name, status="active"):
    return (f"{name}.md", f"---\nchunk_id: {name}\nsource: s\ntopic: T\nsummary: >\n  sum\ntriggers:\n  - \"t\"\nhas_conditions: false\nrelated_chunks:\n  - old\nstatus: {status}\n---\n\n## Context\n")


def test_index_statistics_count_what_is_kept(spark):
    files = spark.createDataFrame([chunk_file("a"), chunk_file("b", "review"), chunk_file("c", "deprecated"), ("d.md", chunk_file("d")[1].replace("topic: T\n", ""))], "file string, raw string")
    entry = '  - chunk_id: a\n    source: s\n    topic: T\n    summary: >\n      sum\n    triggers:\n      - "t"\n    has_conditions: false\n    related_chunks:\n      - old\n    status: active\n'
    text = kb.INDEX_HEADER + "\n" + entry
    assert text.count("\n") == 6 + 11
    r = kb.index_stats(files).first()
    assert (r.active, r.review, r.deprecated, r.skipped, r.size_chars) == (1, 0, 0, 2, len(text))
    g = kb.index_guards(kb.rebuild_index(files), most_chunks=0, most_chars=len(text)).first()
    assert (g.chunks, g.size_chars, g.many_chunks, g.large) == (1, len(text), True, False)
    assert [(r.chunk_id, r.n) for r in kb.list_chunks(kb.parse_front_matter(files)).orderBy("chunk_id").collect()] == [("a", 4), ("b", 4), ("c", 4), ("d", 4)]


def test_relate_pass_leaves_the_set_alone(spark):
    files = spark.createDataFrame([chunk_file("a"), chunk_file("b"), chunk_file("c"), chunk_file("d", "review")], "file string, raw string")
    links = lambda related, n=4: {r.file[0]: r.raw for r in kb.rewrite_related(files.limit(n), spark.createDataFrame(related, "chunk_id string, related_chunks array<string>")).collect()}
    old = {r.file[0]: r.raw for r in files.collect()}
    assert links([]) == old  # no cluster at all
    got = links([("a", ["b"]), ("b", ["chunk_id:a"])])
    assert got["a"] == old["a"].replace("  - old", "  - b") and got["b"] == old["b"].replace("  - old", "  - a")
    assert got["c"] == old["c"].replace("  - old\n", "") and got["d"] == old["d"]
    index = spark.createDataFrame([("a", "active", ["old"]), ("b", "review", ["old"])], "chunk_id string, status string, related_chunks array<string>")
    related = spark.createDataFrame([("a", ["b"])], "chunk_id string, related_chunks array<string>")
    assert all(r.related_chunks == ["old"] for r in kb.apply_related(index, related).collect())  # one active chunk


def test_alerts_are_valid_responses(spark):
    kinds = spark.createDataFrame([(k,) for k in ("auth", "rate_limit", "token_limit", "transient", "unknown")], "kind string")
    got = outputs.parse_chat_response(kinds.withColumn("raw", outputs.error_to_alert(F.col("kind")))).collect()
    assert len(got) == 5 and all(r.type == "alert" and r.data.severity == "danger" and r.data.title == "Assistant unavailable" for r in got)
    assert len({r.data.body for r in got}) == 3


def test_size_comes_before_missing_fields(spark):
    x = spark.createDataFrame([(None, "s", None, 70_000), ("m", None, "", 10), ("", "s", "clarify", 10), ("m", "s", "clarify", 65_536)], "message string, session_id string, mode string, body_bytes long")
    assert [(r.status, r.mode) for r in requests.valid_requests(x).collect()] == [(413, "answer"), (400, "answer"), (400, "clarify"), (200, "clarify")]


def test_reports_count_corrupt_files(spark):
    rows = [(1000, ["a", "b"], [("x", 400), ("y", 600)], None), (3000, ["c"], [("x", 1000)], None), (None, None, None, "{")]
    x = spark.createDataFrame(rows, "totalDurationMs long, sources array<string>, steps array<struct<step:string,durationMs:bigint>>, broken string")
    assert {r.what: r.value for r in reports.perf_report(x).collect()} == {"runs": 3, "sources": 3, "mean_run_s": 1.3, "step x": 0.7, "step y": 0.6}
    res = spark.createDataFrame([("a", 2, 1, False), ("b", 5, 5, True)], "source string, new_chunks long, updated_chunks long, failed boolean")
    assert tuple(reports.source_failures(res).first()) == (2, 2, 1, 1)


def test_questions_and_answers(spark):
    content = "Access\nFor all staff.\nHow do I ask?\nWrite.\nThen wait.\nWho decides?\nThe owner."
    segs = spark.createDataFrame([("s", "Access", content), ("s", "None", "no question here")], "source string, heading string, content string")
    (r,) = outputs.extract_qna(segs).collect()
    assert (r.chunk_id, r.topic, r.triggers, r.context) == ("access-overview", "Access", ["How do I ask?", "Who decides?"], "For all staff.")
    assert r.response == "### How do I ask?\nWrite.\nThen wait.\n\n### Who decides?\nThe owner."
    got = outputs.extract_qna(segs, per="question").orderBy("position").collect()
    assert [(q.chunk_id, q.response) for q in got] == [("how-do-i-ask", "### How do I ask?\nWrite.\nThen wait."), ("who-decides", "### Who decides?\nThe owner.")]


def test_chat_patterns(spark):
    turns = [
        (1, 0, "user", "Hello! Login fails for ann@corp.com."), (1, 1, "assistant", "Thanks for writing. Reset it. Happy to help!"),
        (2, 0, "user", "LOGIN fails for bob@corp.com"), (2, 1, "assistant", "Reset it."),
        (3, 0, "user", "login fails for x@y.org"), (3, 1, "assistant", "Call +1 555 123 4567 about ticket #12345, Mr. Smith."),
        (4, 0, "user", "Printer is off"), (4, 1, "assistant", "Try this."), (4, 2, "user", "still off"),
        (5, 0, "user", "Printer is off"), (5, 1, "assistant", "Which printer?"),
    ]
    got = {(r.symptom, r.fix): r.n for r in outputs.extract_chat_patterns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {("login fails for email", "Reset it."): 2, ("login fails for email", "Call [number] about ticket [reference], [name]."): 1}


def test_one_bad_prompt_costs_only_itself(spark):
    seen = spark.createDataFrame([(k, f"p{k}", "DOC") for k in range(5)], "k long, prompt string, doc string")

    def model(prompts):
        if any("p3" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    got = {r.k: (r.raw, r.failure) for r in outputs.extract_chunks(seen.coalesce(1), model, document="doc").collect()}
    assert got == {k: (None, "ValueError: no") if k == 3 else (f"DOC\n\nP{k}", None) for k in range(5)}
    prompts = outputs.segment_prompts(spark.createDataFrame([(["A", "Part 1"], 2, 3, "{{X}}")], "heading_path array<string>, page_start int, page_end int, content string"), "{{HEADING}}|{{PAGES}}|{{CONTENT}}|{{NO}}")
    assert prompts.first().prompt == "A › Part 1|2–3|{{X}}|"


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


def test_rate_limit_reads_a_run_in_bounded_batches(spark):
    rows = [(s, k, 3 * k + s) for s in (0, 1) for k in range(60)] + [(None, k, 200 * k) for k in range(4)]
    log = spark.createDataFrame(rows, "session_id long, req_id long, s long").selectExpr("session_id", "req_id", "timestamp_seconds(s) as ts")
    want = {}
    for session in (0, 1, None):
        admitted = []
        for _, k, at in (r for r in rows if r[0] == session):
            want[session, k] = sum(at - t < 60 for t in admitted) < 5
            admitted += [at] * want[session, k]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        x = requests.rate_limit_decisions(log, 5, 60)
        got = {(r.session_id, r.req_id): r.admitted for r in x.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and "FlatMapGroups" not in x._jdf.queryExecution().toString()

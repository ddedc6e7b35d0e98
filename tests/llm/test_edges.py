"""Empty tables, very long texts and broken pages for operators whose other tests have none."""

from lorespark.llm import embedding_dedup, html_extract, language_id, license_scan, toxicity

DOCS = "doc_id long, text string, lang string, source string"


def test_empty_tables_give_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert language_id.identified(docs).count() == 0
    assert license_scan.scan_licenses(docs).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert toxicity.scored(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_nulls_in_every_column(spark):
    docs = spark.createDataFrame([(None, None, None, None), (1, "", "en", None), (2, "der die das und nicht", None, "s"), (3, "the and of to", "en", "s"), (4, "der die und", "de", "s")], DOCS)
    got = {r.doc_id: r.lang_pred for r in language_id.identified(docs).collect()}
    assert len(got) == 5 and got[None] == got[1] == "und"
    assert license_scan.scan_licenses(docs).where("license is not null").count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, None, "<p>a</p>"), (2, "http://h/x", None)], "page_id long, url string, html string")
    assert {(r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect()} == {(None, "", 0), (1, "a", 1), (2, "", 0)}


def test_a_very_long_text_is_read_whole(spark):
    notice = license_scan.TEMPLATES["MIT"] if "MIT" in license_scan.TEMPLATES else next(t for t in license_scan.TEMPLATES.values() if len(t) > 300)
    filler = "plain words of no licence at all " * 40_000
    docs = spark.createDataFrame([(1, filler + notice, "en", "s"), (2, filler, "en", "s"), (3, "the cat and the dog of the house " * 300, "en", "s"), (4, "der Hund und die Katze in dem Haus " * 300, "de", "s")], DOCS)
    found = {r.doc_id: (r.license is not None, r.first_word) for r in license_scan.scan_licenses(docs.where("doc_id < 3")).collect()}
    assert found[1][0] and found[1][1] >= 40_000 * 7 and not found[2][0]
    long = spark.createDataFrame([(9, "der Hund und die Katze in dem Haus " * 60_000, None, "s")], DOCS)
    model = language_id.learn(docs.where("doc_id > 2"))
    row = language_id.predicted(long, model, ["doc_id"]).first()
    assert row.lang_pred == "de" and row.score > 0.9 and row.spans[-1].last == 8 * 60_000 - 1


def test_broken_and_deep_pages_are_read_as_far_as_they_go():
    deep = "<div>" * 1500 + "x" + "</div>" * 700 + "<p>y"
    assert html_extract.main_text(deep, None) == "x\ny"
    assert html_extract.main_text("<p>a<b>b</p></i></div><p>c<!-- open", None) == "ab\nc"
    assert html_extract.main_text("<p>1 < 2 &amp; 3 > 2</p><script>var a = '<p>no</p>'", None) == "1 < 2 & 3 > 2"
    assert html_extract.main_text("<table><tr><td>a<td>b<tr><td>c</table>", None) == "a\nb\nc"

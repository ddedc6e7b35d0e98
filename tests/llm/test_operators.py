"""The corpus operators against brute force, the tokenizers library and hand-made cases."""

import hashlib
import itertools
import json
import random
import re

import numpy as np
import pytest

from lorespark.llm import bpe, common, decontaminate, embedding_dedup, html_extract, jaccard_join, language_id, license_scan, pii, shingles, sigtree, token_histogram, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    rows = [(k, t, lang, "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def pseudo(rng, n, vocabulary=400):
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


def brute_components(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_small_and_by_rounds(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(12)]
    nodes = {x for p in links for x in p if p[0] != p[1]}
    want = {k: v for k, v in brute_components(links, {x for p in links for x in p}).items() if k in nodes}
    e = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in common.components(e).collect()}
    assert got == want
    from pyspark.sql import functions as F

    u = e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    assert {r.node: r.root for r in common._star_rounds(u, e.schema["a"].dataType).collect()} == want
    assert common.components(e.limit(0)).count() == 0


def jaccard_brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({b: b + 32 for b in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return sets, brute_components(links, range(len(texts)))


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_join_equals_brute_force(spark, block):
    rng = random.Random(1)
    texts = [None, "", " \t", "one two", "one TWO", "É b", "é b"]
    passage = pseudo(rng, 30)
    for _ in range(12):
        base = pseudo(rng, rng.choice([6, 20, 60, 150])).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(7)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "x%d" % rng.randrange(10**6)
            texts.append(" ".join(copy))
    texts += [pseudo(rng, 10) + " " + passage for _ in range(15)] + ["hot copy of one text here again"] * 9
    texts.append(pseudo(rng, 20_000, 50))
    sets, want = jaccard_brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, texts), block=block, share=2.0**-8).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in range(len(texts))}
    kept = {r.doc_id for r in jaccard_join.keep_one(documents(spark, texts)).collect()}
    assert kept == {k for k in want if want[k] == k}


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_components(documents(spark, ["x"]).limit(0)).count() == 0


def test_signature_trees_lose_no_pair():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(20)]
    sets = base + [np.unique(np.concatenate((b[:75], rng.integers(0, 2**63, 5).astype(np.uint64)))) for b in base]
    sets.sort(key=len)
    groups = list(range(len(sets)))
    tree = sigtree.build([len(s) for s in sets], [shingles.bitmap(s, shingles.width_for(len(s), 2)) for s in sets], groups)
    found = {tuple(sorted(p[:2])) for p in sigtree.dual_traversal(tree, tree, 80, 100)}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * (o := shingles.overlap(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - o)}
    assert want and want <= found and len(found) < 100
    alike = sigtree.build([len(s) for s in sets], [shingles.bitmap(s, 256) for s in sets], [1] * len(sets))
    assert not list(sigtree.dual_traversal(alike, alike, 80, 100))


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = common.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = "abcABC 'sStTrevmld09.,!?\t\n\x1c\x85 ÉéßΣσςİıàé̀日本語カタ😀👍🏽<|>§²½Ⅷक्षिنصдЖ_-"
    texts = [None, "", "<|endoftext|> hello<|startoftext|>x", "a" * 2000, "ab" * 700, "ΑΣ it's I'LL"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    want = {}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[k] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    docs = documents(spark, texts)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs, path).collect()} == want
    assert all(len(r.ids) == want[r.doc_id][0] for r in bpe.tokenized(docs, path).collect())
    lengths = [n for n, _, _ in want.values()]
    h = token_histogram.length_histogram(bpe.token_counts(docs, path), block=7)
    rows = {r.n_tokens: r for r in h.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for n, r in rows.items():
        assert (r.n_docs, r.docs_ge, r.tokens_ge) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.truncated_total, r.docs_fit, r.all_tokens) == (sum(min(x, n) for x in lengths), sum(x <= n for x in lengths), sum(lengths))
    at = {r.context: r.truncated_total for r in token_histogram.at_limits(h, [4, 16]).collect()}
    assert at == {c: sum(min(x, c) for x in lengths) for c in (4, 16)}
    q = token_histogram.quantiles(h, [0.5]).first().n_tokens
    assert sum(x <= q for x in lengths) >= len(lengths) / 2 > sum(x < q for x in lengths)
    assert token_histogram.length_histogram(bpe.token_counts(docs.limit(0), path)).count() == 0


def test_remembered_encodings_are_bounded(spark):
    bpe_of = bpe.Cached(common.vocabulary("word_bpe_49k.json"), most=4000)
    plain = bpe.TrieBPE(common.vocabulary("word_bpe_49k.json"))
    rng = random.Random(3)
    for _ in range(12):
        chunks = {pseudo(rng, 1, 300) for _ in range(30)} | {"x" * 5000}
        got = bpe_of.learn(chunks)
        assert set(got) == chunks and bpe_of.size <= 4000 and len(bpe_of.young) + len(bpe_of.old) < 40
        for c in chunks:
            ids = plain.encode_words({w for w in plain.words_of(c) if isinstance(w, str)})
            assert got[c][1] == " ".join(str(i) for w in plain.words_of(c) for i in ids[w])


@pytest.mark.parametrize("most", [10**6, 5])
def test_decontamination_equals_brute_force(spark, most):
    rng = random.Random(8)
    items = [pseudo(rng, n, 60) for n in (15, 30, 4, 12)] + [None, "!!", "short item"]
    texts = [None, "", items[0], pseudo(rng, 50, 60) + " " + items[1].upper().replace(" ", "-- ") + " tail", "a short ITEM b", pseudo(rng, 300, 60), items[0] + " | " + items[0]]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({b: b + 32 for b in range(65, 91)}))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(documents(spark, texts), bench, most=most).collect()}
    for k, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for i, x in enumerate(items):
            v = words(x)
            n = min(10, len(v))
            for s in {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else ():
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == s:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        r = rows[k]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    left = {r.doc_id: r.text for r in decontaminate.clean(documents(spark, texts), bench, "spans", most=most).collect()}
    assert len(left) == len(texts) and items[1].upper() not in left[3] and left[3].endswith(" tail") and left[5] == texts[5]
    kept = decontaminate.clean(documents(spark, texts), bench, most=most)
    assert {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if not r.contaminated} and kept.columns == documents(spark, texts).columns
    assert decontaminate.contamination(documents(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_by_slices_equals_one_set(spark):
    rng = random.Random(9)
    items = [pseudo(rng, 30, 60), pseudo(rng, 30, 60)]
    rows = [(1, "clean text"), (1, "head " + items[0] + " tail"), (1, items[1] + " more"), (None, "other clean"), (None, items[0]), (2, None), (2, "x " + items[1] + " y " + items[0])]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = [sorted(map(str, decontaminate.contamination(docs, bench, most=m).collect())) for m in (10**6, 5)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    left = [{r.k: (r.doc_id, r.text) for r in decontaminate.clean(docs, bench, "spans", most=m).collect()} for m in (10**6, 5)]
    assert left[0] == left[1] and left[1][1] == (1, "head  tail") and left[1][6] == (2, "x  y ")
    assert decontaminate.clean(docs, bench, "spans", most=5).schema == docs.schema


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.08
    x = np.vstack((base, near, base[:5], np.tile(base[7], (30, 1)) + rng.normal(size=(30, 16)) * 0.05)).astype(np.float32)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] * 16), (n + 4, []), (n + 5, [1.0])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), books=8, recall=1.0).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    want = brute_components([(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i < j], range(n))
    assert len(got) == n + 6
    assert [got[k].n_links for k in range(n)] == close.sum(1).tolist()
    assert [got[k].component_id for k in range(n)] == [want[k] for k in range(n)]
    assert all(got[k].n_links == 0 and got[k].kept for k in range(n, n + 6))


@pytest.mark.parametrize("kind", ["spread", "one half", "clustered"])
def test_embedding_recall_of_the_registered_setting(spark, kind):
    """Partners just above the threshold, where the traversal may miss some, against brute force."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 64))
    if kind == "clustered":
        x = rng.normal(size=(12, 64))[rng.integers(0, 12, 1500)] + 0.5 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.normal(size=x.shape)
    if kind == "one half":
        u[:, 32:] = 0
    u -= (u * x).sum(1)[:, None] * x
    y = 0.952 * x + (1 - 0.952**2) ** 0.5 * u / np.linalg.norm(u, axis=1)[:, None]
    z = np.vstack((x, y)).astype(np.float32)
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(z)], "vec_id long, embedding array<float>")
    found = sum(r.n_links for r in embedding_dedup.near_duplicates(rows, fit_rows=1024).collect())
    w = z.astype(float) / np.linalg.norm(z.astype(float), axis=1)[:, None]
    all_links = int((w @ w.T >= 0.95).sum()) - len(w)
    assert all_links >= 3000 and embedding_dedup.RECALL * all_links <= found <= all_links


def test_pages_and_wrappers(spark):
    def page(k, body, extra=""):
        return f"""<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><ul><li><a href=x>m{k}</a></li><li>z</li></ul></nav>{extra}
        <div class="ad">buy {k}</div><article><h1>Head {k}</h1>{body}</article><div id="comments"><p>reader {k}</p></div><aside>side</aside><footer>f</footer></body></html>"""

    pages = [(k, f"https://H.example/p{k}", page(k, "".join(f"<p>a {i} &amp; b\n  c<br>d" for i in range(k % 4 + 1)), "<div class='cookie notice'>n</div>" * (k % 2))) for k in range(9)]
    pages += [(20, "https://other.example/", "<div><p>plain <b>text</b></p>"), (21, None, None), (22, "x", "")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(9):
        assert got[k].text == "\n".join([f"Head {k}"] + [f"a {i} & b c d" for i in range(k % 4 + 1)])
    assert got[20].text == "plain text" and got[21].text == "" and got[22].n_chars == 0
    w = html_extract.infer([p[2] for p in pages[:9]])
    assert "(<p>#</p>)+" in w["wrapper"] and ")?" in w["wrapper"] and w["article"] == "html/body/article"


def test_article_text_that_some_pages_lack_stays(spark):
    def page(k):
        quote = f"<blockquote>quote {k}</blockquote>" if k % 3 else ""
        return f"<body><article><h1>Head {k}</h1><p>body {k}</p>{quote}<h2>Section {k}</h2><h3>Same line</h3><h4>{'Now and then' if k % 2 else f'Other {k}'}</h4></article></body>"

    pages = [(k, "https://h.example/", page(k)) for k in range(40)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(40):
        want = [f"Head {k}", f"body {k}"] + [f"quote {k}"] * bool(k % 3) + [f"Section {k}", "Same line", "Now and then" if k % 2 else f"Other {k}"]
        assert got[k] == "\n".join(want)
    w = html_extract.infer([page(0), page(1), page(2)])
    assert w["wrapper"].count("blockquote") == 2 and "(<blockquote>#</blockquote>)?" in w["wrapper"]


KEY = b"a key of the tests"


def test_wrappers_without_article_tags(spark):
    """Flat markup: constants around the slots are template, constants among them are the article's."""

    def page(k):
        more = "".join(f"<p>more {k} {i}</p>" for i in range(k % 3))
        quote = f"<blockquote>quote {k}</blockquote>" if k % 2 else ""
        return f"<body><p>Home</p><p>About us</p><h1>Head {k}</h1>{quote}<p>body {k}</p>{more}<h2>Summary</h2><div class='related work'><p>see {k}</p></div><div class='related-links'><p>x {k}</p></div><p>All rights reserved</p></body>"

    pages = [(k, "https://flat.example/", page(k)) for k in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    w = html_extract.infer([p[2] for p in pages])
    assert "(<p>#</p>)+" in w["wrapper"] and "(<blockquote>#</blockquote>)?" in w["wrapper"] and w["wrapper"].startswith("<body><p>=</p><p>=</p>")
    one = html_extract.Wrapper(w)
    for k in range(20):  # by hand: the page without its first two and its last paragraph, and without the links
        want = [f"Head {k}"] + [f"quote {k}"] * (k % 2) + [f"body {k}"] + [f"more {k} {i}" for i in range(k % 3)] + ["Summary", f"see {k}"]
        assert got[k] == "\n".join(want)
        assert one.matched(html_extract.blocks(page(k))) is not None
    # a page that the wrapper doesn't match as a whole
    assert one.text(page(3).replace("<h2>", "<table><tr><td>cell</td></tr></table><h2>")) == "\n".join(["Head 3", "quote 3", "body 3", "cell", "Summary", "see 3"])


def test_wrappers_come_from_all_pages_of_a_host(spark):
    """Each of 40 pages among 120 has a block of its own place and kind: the wrapper matches every page."""

    def page(k):
        rare = f"<section class='kind-{k // 3} w-1/2'><p>rare {k}</p></section>" if k % 3 == 0 else ""
        return f"<body><p>Home</p><h1>Head {k}</h1>{rare}<p>body {k}</p><p>All rights reserved</p></body>"

    pages = [(k, "https://h.example/", page(k), "h.example") for k in range(120)]
    x = spark.createDataFrame(pages, "page_id long, url string, html string, host string").repartition(5)
    told = [html_extract.wrappers(x, most, groups).collect() for most, groups in ((html_extract.MOST, 64), (0, 4))]
    for (row,) in told:
        one = html_extract.Wrapper(json.loads(row.wrapper))
        assert all(one.matched(html_extract.blocks(p[2])) is not None for p in pages)
        assert [one.text(p[2]) for p in pages] == ["\n".join([f"Head {k}"] + [f"rare {k}"] * (k % 3 == 0) + [f"body {k}"]) for k in range(120)]


def test_surrogates_keep_format_and_stay_distinct(spark):
    text = 'Mail ann.b@mail6.example.com, ANN.B@MAIL6.EXAMPLE.COM or +1 (947) 555-7668, card 4532-0151-1283-0366, ip 55.63.178.142, token = "9f1d09af2da8b", Mr. John Smith said. Smith left.'
    new, kinds = pii.replaced(text, KEY, {})
    assert kinds == ["email", "email", "phone", "card", "ip", "secret", "given", "surname", "surname"]
    for old in ("ann.b", "555-7668", "4532-0151", "55.63.178.142", "9f1d09", "John", "Smith"):
        assert old not in new
    assert pii._luhn(re.sub("-", "", re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", new)[0])) == 0
    emails = re.findall(r"\S+@[\w.]+", new)
    assert emails[0].upper() == emails[1] and re.search(r"Mr\. \w+ (\w+) said\. \1 left", new)
    assert pii.replaced(text, b"another key", {})[0] != new
    plain = "No entity in 2024, version 1.2.3 or 3 of 4, at 12:30:45, in std::vector or a::b."
    assert pii.replaced(plain, KEY, {}) == (plain, []) and pii.replaced(None, KEY, {}) == (None, []) and pii.replaced("", KEY, {}) == ("", [])
    texts = [text, None, "", plain] + [f"call me: 10.0.{k}.{k}" for k in range(40)]
    docs = documents(spark, texts)
    drawn = pii.draws(docs, KEY).collect()
    assert len({(r.kind, r.surrogate) for r in drawn}) == len(drawn) and not {(r.kind, r.surrogate) for r in drawn} & {(r.kind, r.value) for r in drawn}
    out = {r.doc_id: r.text for r in pii.pseudonymised(docs, KEY).collect()}
    assert out[0] == new and out[1] is None and out[2] == "" and out[3] == plain
    clash = docs.withColumnsRenamed({"lang": "row", "source": "_row"})
    assert {r.doc_id: (r.text, r.row, r._row) for r in pii.pseudonymised(clash, KEY, most=-1).collect()} == {k: (t, "en", "s") for k, t in out.items()}


def test_persons_stay_one_over_titles_and_texts(spark):
    texts = ["Mr. John Smith said. Mr. Smith left.", "Dr. John Smith came; SMITH met John.", "Mrs. Anna Smith wrote.", "Prof Kim Lee and Lee.", "John without a title stays."]
    out = {r.doc_id: r.text for r in pii.pseudonymised(documents(spark, texts), KEY).collect()}
    given, last = re.match(r"Mr\. (\w+) (\w+) said", out[0]).groups()
    assert out[0] == f"Mr. {given} {last} said. Mr. {last} left." and out[1] == f"Dr. {given} {last} came; {last.upper()} met {given}."
    anna = re.match(rf"Mrs\. (\w+) {last} wrote", out[2])[1]
    assert given[-1] in "nrsl" and anna[-1] == "a" and re.fullmatch(r"Prof \w+ (\w+) and \1\.", out[3]) and out[4] == texts[4]
    assert {r.doc_id: r.text for r in pii.pseudonymised(documents(spark, texts), KEY, most=0).collect()} == out


def test_addresses_become_reserved_ones():
    new = pii.replaced("a@b.com c@d.e.org 8.8.8.8 fe80::1 2001:0db8:0:0:0:0:0:1 00:1A:2B:3C:4D:5E 00-1a-2b-3c-4d-5e", KEY, {})[0].split()
    assert new[0].endswith(".example") and new[1].endswith(".example.org") and 240 <= int(new[2].split(".")[0]) <= 254
    assert all(x.startswith("2001:db8:") for x in new[3:5]) and new[5].startswith("02:") and new[6] == new[5].lower().replace(":", "-")


def test_secrets_without_digits_and_surnames_over_genders(spark):
    for word in ("password", "PWD", "api-key", "apikey", "Secret", "token"):
        assert "correcthorsebattery" not in pii.replaced(f"the {word}: correcthorsebattery", KEY, {})[0]
    plain, digit = (pii.replaced(f"password: correcthorsebattery{x}", KEY, {})[0] for x in ("", " 7"))
    assert digit == plain + " 7"
    syllables = pii.SYLLABLES["latin"]
    names = [f"{a}{b}".capitalize() + c for a in syllables for b in syllables[:10] for c in ("nson", "berg")]
    texts = [f"{('Mr', 'Mrs', 'Dr')[k % 3]} {n} came." for k, n in enumerate(names)] + ["Mr Ann Smith or Mrs Ann Smith"]
    texts += [f"Mr {pii.surrogate(KEY, 'surname', names[0], 0)} came."]  # a surname put in that is real
    drawn = pii.draws(documents(spark, texts), KEY).collect()
    last = [r.surrogate for r in drawn if r.kind == "surname"]
    assert len(last) == len(names) + 2 and len(set(last)) == len(last) and not set(last) & {r.value for r in drawn}
    assert len({r.surrogate for r in drawn if r.value == "Ann"}) == 2


def test_licenses(spark):
    body = "lorem ipsum dolor " * 30
    mit = license_scan.TEMPLATES["MIT-text"].replace("substantial", "large")
    texts = [None, "", body, body + license_scan.TEMPLATES["MIT"] + body, mit, license_scan.TEMPLATES["GPL-3.0"] + "\n" + body + license_scan.TEMPLATES["GPL-3.0"]]
    got = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    assert [got[k].license for k in range(6)] == [None, None, None, "MIT", "MIT-text", "GPL-3.0"]
    assert got[3].first_word == 90 and 0.9 < got[4].coverage < 1 and got[5].n_notices == 2
    rng = random.Random(4)
    for _ in range(200):  # the longest increasing run, by trying all
        js = rng.sample(range(20), rng.randrange(8))
        best = max(k for k in range(len(js) + 1) if any(list(c) == sorted(c) for c in itertools.combinations(js, k)))
        got_run = license_scan._increasing(list(enumerate(js)))
        assert len(got_run) == best and [j for _, j in got_run] == sorted(j for _, j in got_run)
    a, b = "x a b c d y".split(), "q a b z c d y".split()
    pairs = license_scan.patience(a, b)
    assert [a[i] for i, _ in pairs] == ["a", "b", "c", "d", "y"] and all(a[i] == b[j] for i, j in pairs)


def test_license_notices_without_their_rarest_word():
    scan = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE).scan
    for verb in ("Distributed", "Licensed"):
        assert scan(f"Some text. {verb} under the MIT License. More text.") == ("MIT", 0.8, 3, 1)
    assert scan("Released under the terms of another one. " + "word " * 40 + "Distributed under the MIT License.")[::3] == ("MIT", 1)
    isc = license_scan.TEMPLATES["ISC"]
    body = "plain words " * 60
    for word in set(license_scan.words_of(isc)) - {"and", "or", "this"}:
        other = re.sub(rf"(?i)\b{word}\b", "xx", isc)
        assert scan(body + isc + body + other + body)[::3] == ("ISC", 2)
        assert scan(body + other + body + word)[3] == 1
    mit = license_scan.TEMPLATES["MIT"]
    assert scan("a b c d e " + f"{mit} " * 4)[3] == 4 and scan(f"{isc} {isc} x {isc.replace('fee', 'charge')}")[3] == 3
    assert scan("Released by some license. The MIT one.")[3] == 0
    assert scan("Released under the BSD License.")[0] is None and scan("// SPDX-License-Identifier: Foo-2.0")[0] is None
    for name in ("BSD-3-Clause-text", "BSD-2-Clause-text", "LGPL-2.1-header", "AGPL-3.0-text", "MPL-2.0", "MPL-2.0-spdx", "GPL-2.0-or-later-spdx", "CC-BY-NC-SA-4.0-short", "0BSD", "ISC-text"):
        assert scan(f"{body} {license_scan.TEMPLATES[name]} {body}")[::3] == (name, 1)


def test_viterbi_and_language(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):
        table, at = rng.normal(size=(24, 3)) * 3, [rng.integers(0, 24, size=int(rng.integers(0, 6))) for _ in range(4)]
        scores = [table[k] for k in at]
        for s, p in zip(scores, language_id.viterbi(at, table, 2.0), strict=True):
            value = lambda q, s=s: sum(s[i, x] for i, x in enumerate(q)) - 2.0 * sum(x != y for x, y in zip(q, q[1:], strict=False))
            if len(s):
                assert value(list(p)) == pytest.approx(max(value(q) for q in itertools.product(range(3), repeat=len(s))))
    # more labels than a byte holds
    table = np.full((200, 200), -50.0)
    np.fill_diagonal(table, 0.0)
    assert language_id.viterbi([np.repeat([150, 7, 199], 4)], table, 2.0)[0].tolist() == [150] * 4 + [7] * 4 + [199] * 4
    r = random.Random(2)
    words = {"aa": "babo kubo tabi".split(), "bb": "strix glorp mlent".split(), "ru": "дом река лес".split()}
    say = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(k, say(lang, 30), lang) for k, lang in enumerate(["aa", "bb", "ru"] * 20)] + [(900, say("aa", 20) + " " + say("bb", 5), None), (901, None, "aa"), (902, "12 !?", "aa"), (903, "", None)]
    got = {x.doc_id: x for x in language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:60])
    assert got[900].lang_pred == "aa" and got[900].n_spans == 2 and got[901].lang_pred == got[902].lang_pred == got[903].lang_pred == "und"


def test_toxicity(spark):
    r = random.Random(6)
    fine, bad = [f"word{k}" for k in range(200)], ["glarp", "snorkus", "blimpf"]
    rows, labels = [(None, "x"), (5000, None), (5001, "")], []
    for k in range(300):
        toxic = k % 4 == 0
        w = [r.choice(fine) for _ in range(40)]
        for _ in range(4 * toxic):
            w[r.randrange(40)] = r.choice(bad)
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.scored(docs, marks).collect()}
    held = [k for k, _ in labels if got[k].held_out]
    assert 30 < len(held) < 100 and all(0 <= x.score <= 1 for x in got.values())
    assert sum(got[k].predicted == labels[k][1] for k in held) >= 0.95 * len(held)
    left = toxicity.without_toxic(docs, marks)
    assert left.columns == docs.columns and {5000, 5001, None} <= {x.doc_id for x in left.collect()}
    assert all(x.score == 0 for x in toxicity.scored(docs, marks.limit(0)).collect())


def test_long_pages_are_aligned(spark):
    """Pages of over 4,000 tokens that don't fold shape their host's wrapper like others, and it matches them."""

    def page(k):
        parts = [f"<div class=k{j}><p>text {k} {j}</p></div>" for j in range(1700) if j % 50 != k]
        return "<body><div class=menu><p>Home</p></div><article>" + "".join(parts) + f"</article><div class='share e{k}'><p>Share</p></div></body>"

    pages = [(k, f"http://long.example/{k}", page(k), "long.example") for k in range(6)]
    x = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    assert all(len(html_extract.folded(html_extract.stream(html_extract.blocks(p[2]), set()))) > 4000 for p in pages)
    row = html_extract.wrappers(x).first()
    for w in (json.loads(row.wrapper), html_extract.infer([p[2] for p in pages])):
        one = html_extract.Wrapper(w)
        assert all(one.matched(html_extract.blocks(p[2])) is not None for p in pages)
    got = {r.page_id: r.text for r in html_extract.extract(x).collect()}
    assert got == {k: "\n".join(f"text {k} {j}" for j in range(1700) if j % 50 != k) for k in range(6)}


def test_a_common_subsequence_is_longest(monkeypatch):
    rng = random.Random(2)
    for bits in (1 << 28, 64):
        monkeypatch.setattr(html_extract, "BITS", bits)
        for _ in range(60):
            a, b = ([rng.choice(letters) for _ in range(rng.randrange(25))] for letters in ("abcd", "abce"))
            row = [0] * (len(b) + 1)
            for x in a:
                row = list(itertools.accumulate(range(len(b)), lambda left, j, x=x, row=row: row[j] + 1 if x == b[j] else max(left, row[j + 1]), initial=0))
            got = html_extract._common(a, b)
            assert len(got) == row[-1] and all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)

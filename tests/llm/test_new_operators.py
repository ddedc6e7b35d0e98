"""Whitening, spelling groups and mixing against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorespark.llm import mixing, spelling, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_whitening(vectors, most=8):
    """x, deviations, whitened values and shares, with the covariance from Python integers."""
    x = np.floor(1024 * np.array(vectors)).astype(np.int64).astype(object) + 100_000
    n, d = x.shape
    y = n * x - x.sum(0)
    v = np.array([[int((y[:, i] * y[:, j]).sum()) / n**3 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return (y * y).sum(1), (y / n).astype(float) @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening_equals_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 12)) @ np.diag(np.arange(12, 0, -1.0)) * 0.1 * scale).astype(np.float64)
    x[7] = x[8]
    rows = [(k, v.tolist(), 5) for k, v in enumerate(x)]
    bad = [(900, None, 1), (901, [None] * 12, 1), (902, [float("nan")] + [0.0] * 11, 1), (903, [float("inf")] * 12, 1), (904, [1.0], 1), (905, [], 1), (906, [1e300] * 12, 1)]
    t = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n int").repartition(5)
    got = sorted(whitening.whitened(t).collect(), key=lambda r: (r.vec_id, r.component))
    dev, w, share = brute_whitening(x)
    assert [(r.vec_id, r.component) for r in got] == [(k, c) for k in range(300) for c in range(1, 9)]
    assert all(r.n == 300 and int(r.deviation_exact) == dev[r.vec_id] for r in got)
    assert all(r.deviation == (dev[r.vec_id] if dev[r.vec_id] < 2**63 else None) for r in got)
    mine = np.array([r.whitened for r in got]).reshape(300, 8)
    sign = np.sign((mine * w).sum(0))
    assert np.abs(mine * sign - w).max() < 1e-8
    assert np.allclose([r.explained for r in got[:8]], share, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    # one direction only: one component, although there are three dimensions; a repeated and a null id are rows
    line = spark.createDataFrame([(1, [0.0, 1.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [2.0, 3.0, 5.0])], schema)
    got = sorted(whitening.whitened(line).collect(), key=lambda r: r.whitened)
    assert [r.component for r in got] == [1, 1, 1] and np.allclose([r.whitened for r in got], [-(1.5**0.5), 0, 1.5**0.5]) and abs(got[0].explained - 1) < 1e-12


def test_squares_by_digits_are_exact():
    rng = random.Random(2)
    z = np.array([[rng.randrange(-(2**61), 2**61) for _ in range(3)] for _ in range(50)], np.int64)
    into = np.zeros((5, 3), object)
    whitening.square_sums(z, 3, into)
    assert [sum(int(into[p, c]) << (24 * p) for p in range(5)) for c in range(3)] == [sum(int(v) ** 2 for v in z[:, c]) for c in range(3)]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_near_words_by_bitsets_equal_brute_force():
    rng = random.Random(5)
    for m in (5, 6, 9):
        held = list({"".join(rng.choice("abé") for _ in range(m + rng.randrange(2))) for _ in range(150)})
        asked = [w for w in held if len(w) == m]
        q, w = spelling.near_words(spelling._letters(asked, m), spelling._letters(held, m + 1), np.array([len(x) > m for x in held]))
        assert sorted((asked[i], held[k]) for i, k in zip(q, w, strict=True)) == sorted((a, b) for a in asked for b in held if one_edit(a, b))


def brute_spelling(rows):
    counts = Counter()
    for ident, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if ident is None else ident}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), words.get(form.get(w)) or 0) for w, n in words.items())


@pytest.mark.parametrize("block", [2048, 7])
def test_spelling_groups_equal_brute_force(spark, block):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé×") for _ in range(rng.choice([4, 5, 6, 8, 11]))) for _ in range(25)] + ["x" * 3000, "x" * 2999 + "y"]
    pool = list(base)
    for w in base:
        for _ in range(6):
            k = rng.randrange(len(w))
            pool.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "b" + w[k + 1 :]]))
    weight = [rng.choice([1, 1, 3, 9, 40]) for _ in pool]
    rows = [(None if k == 5 else k, " ".join(rng.choices([w.upper() if k % 3 == 0 and w.isascii() else w for w in pool], weight, k=30)) + "-É1é") for k in range(60)]
    rows += [(70, None), (71, ""), (72, "1 2 3 ..."), rows[3], rows[3]]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, word string").repartition(4)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.spelling_groups(docs, block, 40_000 if block == 7 else spelling.BLOCK_BYTES).collect())
    assert got == brute_spelling(rows)
    assert len(got) > 40 and any(r[1] and r[2] != r[1] for r in got), "chains of forms occur"


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_targets(own, share=1.5, most=2):
    """Targets by sharing out the excess again and again."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(own, key=lambda s: (s is None, s or "")))}
    target, free, rest = {}, set(own), share * sum(own.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > most * own[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        target |= {s: most * own[s] for s in over}
        free -= over
        rest = share * sum(own.values()) - sum(target.values())
    return target


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1500):
        source = rng.choices(["a", "B", "é", "z", "", None, "one"], [60, 10, 8, 8, 6, 6, 2])[0]
        rows.append((k, source, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.choice([0, 3, 7, 40, 41, 200])))))
    rows += [(2000, "a", None), (2001, "nothing", " \t\n"), (2002, "z", "long " * 9000)] + [(7000, "a", "same five words in rows")] * 90
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int").repartition(6)
    out = mixing.mixed(docs, part=50).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    size = {r[0]: len((r[2] or "").split()) for r in rows}
    own = defaultdict(int)
    for i, s, _ in rows:
        own[s] += size[i]
    target, taken = brute_targets(own), defaultdict(int)
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == own[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken == r.copies * r.size and r.copies in (0, 1, 2) and abs(r.copies - r.rate) < 1 + 40 / max(r.size, 1)
        taken[r.source] += r.taken
    for s in own:
        assert abs(taken[s] - target[s]) <= 20, s
    again = mixing.mixed(docs.repartition(3), part=50).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_rates_solve_the_dual(spark):
    """Each source's rates are one exponential tilt, clipped at 2, and give the target."""
    rng = random.Random(6)
    sizes = {(s, z): rng.randrange(1, 30) for s in "abc" for z in rng.sample(range(1, 5000), 40)}
    own = {s: sum(z * m for (t, z), m in sizes.items() if t == s) for s in "abc"}
    want = {"a": 1.7 * own["a"], "b": 0.2 * own["b"], "c": 2.0 * own["c"]}
    h = spark.createDataFrame([(s, z, m) for (s, z), m in sizes.items()], "key string, size long, m long")
    src = spark.createDataFrame([(s, own[s], float(want[s])) for s in "abc"], "key string, source_size long, target double")
    got = {r.key: r for r in mixing.tilts(h, src).collect()}
    assert got["c"].tilt is None
    for s in "ab":
        words = sum(z * m * min(2, np.exp(got[s].tilt * z / got[s].unit)) for (t, z), m in sizes.items() if t == s)
        assert abs(words - want[s]) < 1e-6 * want[s]


def test_mixing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], empty.schema)
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.mixed(blank).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_the_encoder_remembers_within_bounds():
    """200,000 random words: pairs and encodings stay below their limits in bytes, and what is forgotten is found again."""
    import sys

    from lorespark.llm import bpe, common

    rng = random.Random(1)
    path = common.vocabulary("word_bpe_49k.json")
    held, fresh = bpe.Cached(path, most=4_000_000), bpe.TrieBPE(path)
    first = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(500)}
    before = held.learn(first)
    for _ in range(200):
        held.learn({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(1000)})
    own = held.bpe
    assert max(len(own.fits), len(own.fitted)) <= bpe.PAIRS and len(own.whole) <= len(own.strings)
    entry = sys.getsizeof((1, 2)) + sum(map(sys.getsizeof, (1000, 1000)))
    assert sum(sys.getsizeof(d) + entry * len(d) for d in (own.fits, own.fitted)) <= 2 * bpe.PAIRS * bpe.PAIR_BYTES * 1.5
    taken = [bpe.EACH + len(c) + len(x[1]) + len(x[2]) for d in (held.young, held.old) for c, x in d.items()]
    assert sum(taken) <= 2 * 4_000_000
    assert held.learn(first) == before == {c: (len(t), " ".join(map(str, t)), " ".join(fresh.strings[i] for i in t)) for c, t in ((c, fresh.encode_words(set(w))[w[0]]) for c, w in ((c, own.words_of(c)) for c in first))}


def test_a_window_of_very_many_items_is_dealt_out(spark):
    """3,000 items that open with one prompt: every broadcast set stays within its bound, and the rows are those of one set."""
    from lorespark.llm import decontaminate

    prompt = "answer the following question with one of these four letters"
    bench = spark.createDataFrame([(k, f"{prompt} item{k} a b") for k in range(3000)], "item_id long, text string")
    sizes = [sum(len(of) for _, _, of in w.value.by.values()) for _, w in decontaminate._sliced(bench, 10, 900)]
    assert len(sizes) > 9 and max(sizes) <= 900 and sum(sizes) == 3000 * 4
    docs = spark.createDataFrame([(1, f"see: {prompt}"), (2, "clean"), (3, f"{prompt} item7 a")], "doc_id long, text string")
    got = [sorted(map(str, decontaminate.contamination(docs, bench, most=m).collect())) for m in (10**6, 900)]
    assert got[0] == got[1] and "n_items=3000" in got[0][0]


def test_names_inside_an_article_take_nothing_away():
    """Class names that only resemble boilerplate stay; adverts and comments in the article go, as do bars and boxes around it."""
    from lorespark.llm.html_extract import blocks, is_boilerplate, main_text

    kept = ['<section class="related-work"><p>a</p></section>', '<div class="form-factor">b</div>', '<p class="notice-period">c</p>', '<div class="search results">d</div>', '<ul class="menu"><li>e</li></ul>', '<div id="share-of-votes">f</div>']
    gone = ['<div class="ad">x</div>', '<div class="comments"><p>y</p></div>', "<form>z</form>", "<nav>n</nav>"]
    page = f'<body><div class="site-header">top</div><article>{"".join(kept + gone)}</article><div class="cookie-banner">bar</div></body>'
    assert main_text(page, None) == "a\nb\nc\nd\ne\nf"
    loose = f'<body><div class="site-header">top</div><div class="x"><p class="notice-period">c</p></div><div class="related-posts">r</div><div class="comment-list">k</div><div class="left-sidebar">s</div></body>'
    assert main_text(loose, None) == "c"
    assert [is_boilerplate(n) for n in ("ad", "share-buttons", "related-work", "form-factor", "main-content", "ad-hoc")] == [True, True, False, False, False, False]
    assert [t for _, t in blocks("<p title=it's>hello</p><p title='a>b'>c</p><p data-x=\"1 > 0\" class=q>d</p><p a=b\">e</p><p =>f<p x='g>")] == ["hello", "c", "d", "e", "f"]


def test_counts_of_a_wide_chunk_are_whole():
    """A chunk of very many capitals or marks counts them all, as many short ones do."""
    from lorespark.llm.toxicity import FEATURES, Reader

    f = lambda t: dict(zip(FEATURES, Reader({}).features(t), strict=True))
    assert len({tuple(Reader({}).features("A" * n + " b")) for n in (2000, 4095, 5000, 10_000)}) == 4
    assert len({tuple(Reader({}).features("a" + "!" * n)) for n in (100, 255, 256, 1000)}) == 4
    wide, near = f("A" * 6000 + "a" * 6000), f("A" * 100 + "a" * 100)
    assert [wide[k] for k in FEATURES[:-1]] == [near[k] for k in FEATURES[:-1]]  # half capitals, whatever the length


def test_surrogates_get_longer_where_a_format_runs_out():
    from lorespark.llm import pii

    key = b"k"
    for kind, value in (("phone", "5551234567"), ("ssn", "123456789"), ("card", "4111111111111111"), ("secret", "deadbeef"), ("mac", "0a1b2c3d4e5f"), ("email", "a@b.org"), ("iban", "DE44500105175407324931")):
        sizes = [len(pii.surrogate(key, kind, value, k)) for k in (0, pii.WIDEN - 1, pii.WIDEN, pii.WIDEN + 3)]
        assert sizes[0] == sizes[1] and sizes[2] == sizes[1] + 1 and sizes[3] == sizes[1] + 4, kind
    assert pii.surrogate(key, "ip", "10.0.0.1", pii.WIDEN).startswith("2001:db8:")
    assert pii.shaped("phone", "555-123-4567", "55512345670") == "555-123-45670" and pii.shaped("phone", "555-123-4567", "5551234567") == "555-123-4567"

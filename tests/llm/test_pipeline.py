"""The pipeline against its stages done by hand."""

import hashlib
import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lorespark.llm import pii, toxicity
from lorespark.llm.common import vocabulary
from tests.llm.test_operators import jaccard_brute, pseudo

#: More columns than documents have, some with names that operators use too.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row long, features string, keys int, component_id long"


def tables(spark, folder, texts, labels, items):
    """Texts as a documents table of ids from 0; every third row has nulls beside the text."""
    rows = [(k, t, None if (k or 0) % 3 else "en", None if (k or 0) % 3 else "s", None if t is None else len(t), "x", k, None, 1, 7) for k, t in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(12)
    texts, labels = [], []
    for k in range(240):
        words = pseudo(rng, 40, 3000).split()
        if k % 4 == 0:
            for _ in range(5):
                words[rng.randrange(40)] = rng.choice(["glarp", "snorkus", "blimpf"])
        texts.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 4 == 0)))
    items = [(1, pseudo(rng, 25, 3000)), (2, None), (None, "nothing"), (3, "short item")]
    base = pseudo(rng, 60, 3000)
    texts += [(300, base), (301, base), (302, base.replace(base.split()[30], "other")), (303, f"{pseudo(rng, 9, 3000)} {items[0][1]} end"), (304, "a short ITEM here")]
    texts += [(305, "Mr. John Smith wrote to ann@corp.com. Smith left."), (306, None), (307, ""), (308, pseudo(rng, 30_000, 900)), (309, "one two"), (310, "ONE two")]
    texts += [(311, pseudo(rng, 20, 3000)), (311, pseudo(rng, 20, 3000)), (None, pseudo(rng, 15, 3000))]  # an id twice, and none
    tables(spark, str(tmp_path), texts, labels + [(5, 1, None), (None, 1, 1)], items)
    return str(tmp_path), texts, items


def test_pipeline_equals_its_stages_by_hand(spark, corpus):
    folder, texts, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.scored(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    assert toxic and sum(k % 4 == 0 for k in toxic) == len(toxic) and not {k for k, _ in texts if k is None or k >= 300} & toxic
    left = [(k, t) for k, t in texts if k not in toxic]
    sets, root = jaccard_brute([t for _, t in left])
    first = {}
    for n, (k, _) in enumerate(left):
        first[root[n]] = min([x for x in (first.get(root[n]), k) if x is not None], default=None)
    left = [(k, t) for n, (k, t) in enumerate(left) if k == first[root[n]]]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({b: b + 32 for b in range(65, 91)}))
    windows = set()
    for i, t in items:
        w = words(t) if i is not None else []
        n = min(10, len(w))
        windows |= {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if n else set()
    hit = lambda t: any(tuple(w[p : p + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for p in range(len(w) - n + 1))
    left = [(k, t) for k, t in left if not hit(t)]
    assert not {301, 302, 303, 304, 310} & {k for k, _ in left} and {300, 305, 306, 307, 308, 309, 311, None} <= {k for k, _ in left}
    left = [(k, pii.replaced(t, pii.session_key(spark), {})[0]) for k, t in left]
    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    model.no_truncation()
    model.no_padding()
    want = []
    for k, t in left:
        ids = model.encode(t or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((k, len(ids), digest(" ".join(map(str, ids))), digest(model.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_every_stage_keeps_columns_and_empty_tables(spark, corpus, tmp_path):
    folder, texts, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    few = docs.where("doc_id >= 300")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).count() == 0
        out = stage(spark, few, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = {r.doc_id: r for r in out.collect()}
        assert rows[306].text is None and rows[307].text == "" and rows[308].row == 308 and rows[309].component_id == 7
    tables(spark, f"{tmp_path}/none", [(1, "x")], [(1, 1, 0)], [(1, "y z")])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "encoding"]


def test_small_blocks_and_memories_change_no_encoding(spark):
    """What the pipeline's stage gives its encoder, and less: the same rows."""
    from lorespark.llm import bpe
    from lorespark.llm.common import vocabulary

    path = vocabulary("word_bpe_49k.json")
    docs = spark.createDataFrame([(k, " ".join(f"word{j * k} thing{j}s, été" for j in range(40))) for k in range(200)], "doc_id long, text string").coalesce(1)
    want = sorted(bpe.encode_decode(docs, path).collect())
    assert want == sorted(bpe.encode_decode(docs, path, most=30_000_000, block=700_000).collect())
    assert want == sorted(bpe.encode_decode(docs, path, most=200_000, block=3_000).collect())

"""The pipeline and the registered queries on the smallest tables."""

import corpus_pipeline
from swayscan.llm import bpe, langid, mix, secret_scan, simhash
from swayscan.llm.queries import QUERIES


def test_pipeline_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "secrets", "mixture", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    tokens = bpe.Tokenizer(corpus_pipeline.TOKENIZER)
    want = {r.doc_id: len(tokens.encode(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_take_effect(spark, sf):
    long = " ".join(f"the and of{i}" for i in range(100))
    rows = [
        (1, long, "en", "s", 1), (2, long, "en", "s", 1), (2, long, "en", "s", 1), (3, "12 34", "en", "s", 1), (4, None, None, None, None),
        (5, "the and of token = 'abcdef123456' it", "en", "s", 1), (6, "", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 5]
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, kept, sf).collect()) == [1, 5]
    hidden = {r.doc_id: r for r in corpus_pipeline.secrets(spark, docs, sf).collect()}
    assert hidden[5].text == "the and of token = '[secret]' it" and hidden[5].n_chars == len(hidden[5].text)
    assert corpus_pipeline.mixture(spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.tokens(spark, docs, sf).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_near_copies_keep_a_row_of_every_group(spark, sf):
    text = lambda word: " ".join(f"{word}{i}" for i in range(60))
    rows = [
        (None, text("a"), "en", "s", 1), (None, text("b"), "en", "s", 1), (7, text("b"), "en", "s", 1), (None, text("c"), "en", "s", 1),
        (None, text("c"), None, "s", 1), (3, text("d"), "en", "s", 1), (3, text("e"), "en", "s", 1), (3, text("e"), "en", "s", 1), (4, text("e"), "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, docs, sf)
    assert kept.columns == docs.columns
    got = sorted((r.text[0], r.doc_id) for r in kept.collect())
    assert got == [("a", None), ("b", 7), ("c", None), ("d", 3), ("e", 3)]


def test_stages_leave_columns_of_any_name_alone(spark, sf):
    names = ["_found", "_digest", "digest", "row", "key", "id", "component_id", "lang_pred"]
    docs = spark.createDataFrame(
        [(n, f"the and of {n % 2} it was so", "en", "s", 22, *(f"{c}{n}" for c in names)) for n in range(4)],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names),
    )
    for stage in (corpus_pipeline.language, corpus_pipeline.near_copies, corpus_pipeline.secrets, corpus_pipeline.mixture):
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}


def test_mixture_meets_its_targets_without_weights(spark, sf):
    rows = [(i, "ten words " * 5, "en", "rare" if i % 10 == 0 else "usual", 50) for i in range(4000)] + [(None, "", "en", "rare", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixture(spark, docs, sf).collect()
    shares = {"rare": 0.1**0.7, "usual": 0.9**0.7}
    some = [r for r in got if r.text]
    rare = [r.doc_id for r in some if r.source == "rare"]
    assert abs(len(rare) / len(some) - shares["rare"] / sum(shares.values())) < 0.01
    assert set(rare) == set(range(0, 4000, 10)) and abs(len(some) - 4000) < 100
    assert len(got) == len(some) + 1


def test_each_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_held_out_languages_and_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op6_language"](spark, sf).join(docs, "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.98 * found.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = QUERIES["op7_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in scored) >= 0.85 * len(scored)
    toxic, clean = ([r.score for r in scored if r.toxic == y] for y in (1, 0))
    ranked = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean)
    assert ranked >= 0.8 * len(toxic) * len(clean)  # area under the curve; 14 texts here are labelled toxic

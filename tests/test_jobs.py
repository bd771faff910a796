"""Corpus, display, evaluation, audit and streaming jobs on small inputs."""

import pytest
from pyspark.sql import functions as F

from swayscan import bundled_pack
from swayscan.operators import audit, compare, corpus, evaluate, present, terms
from swayscan.plans import scan as plan
from swayscan.sources.pack import pack_table
from swayscan.streaming import stream


def test_segments_put_together_are_the_text(spark):
    texts = ["", "plain", "Everyone agrees.", "\U0001f642 Either we act now or the mill is utterly ruined. End."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = present.annotate_segments(plan.with_moves(df, bundled_pack(), "all"), ["id"]).collect()
    for n, text in enumerate(texts):
        parts = sorted((r.segment_no, r.segment) for r in rows if r.id == n)
        assert "".join(p for _, p in parts) == text


def test_clusters_touching_moves_stay_apart(spark):
    moves = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(t).alias("tier"))
                      for s, e, t in ((0, 4, 2), (2, 6, 1), (6, 8, 3), (6, 7, 1))))
    got = spark.range(1).select(present.clusters(moves).alias("c")).first().c
    assert [(c.start, c.end, c.tier, c.members) for c in got] == [(0, 6, 2, 2), (6, 8, 3, 2)]


def test_rename_longest_first_and_keeps_phrases(spark):
    rows = [(1, "Ann Lee and Ann met Anna in Ann Lee Hall. \U0001f642"), (2, "The 42nd Mill by the 2nd Mill, 2nd  Mill."),
            (3, "none here"), (4, None), (5, ""), (6, "x_Ann Ann_x (Ann) A+B A.B St. \U00010400y"), (7, "Ann-Lee Ann")]
    names = [("Ann", "Bea"), ("Ann Lee", "Cal Moe"), ("Ann Lee Hall", "Ann Lee Hall"), ("2nd Mill", "Old Mill"), ("A+B", "C"),
             ("St.", "Sankt"), ("\U00010400y", "Z"), ("Ann-Lee", "Dee"), ("...", "never"), ("Ann", "Zed")]
    table = spark.createDataFrame(names, "name string, other string")
    df = spark.createDataFrame(rows, "id int, text string")
    assert {r.id: r.renamed for r in terms.rename_entities(df, "id", "text", table).collect()} == {
        1: "Cal Moe and Bea met Anna in Ann Lee Hall. \U0001f642", 2: "The 42nd Mill by the Old Mill, 2nd  Mill.",
        3: "none here", 4: None, 5: "", 6: "x_Ann Ann_x (Bea) C A.B Sankt Z", 7: "Dee Bea",
    }
    assert {r.renamed for r in terms.rename_entities(df, "id", "text", table.limit(0)).collect()} == {r[1] for r in rows}


def test_rename_from_a_long_list(spark):
    names = spark.range(200_000).selectExpr("concat('Pilot ', id, ' Marl') as name", "concat('N', id) as other")
    df = spark.createDataFrame([(1, "Pilot 17 Marl met Pilot 199999 Marl and Pilot 200000 Marl.")], "id int, text string")
    renamed = terms.rename_entities(df, "id", "text", names)
    assert renamed.first().renamed == "N17 met N199999 and Pilot 200000 Marl."
    assert "Pilot 17" not in renamed._jdf.queryExecution().toString()


def test_dedupe_keeps_the_first_of_a_hot_group(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")
    )
    kept = corpus.dedupe_first(df, "id")
    assert kept.count() == 2001 and kept.where("text = 'same'").first().id == 0


def test_quoted_examples(spark):
    df = spark.createDataFrame([('He said "one two three" and “four five six” and "a b" and "x ... y z" and "a/b c d".',)], "text string")
    assert df.select(corpus.quoted_examples(F.col("text"))).first()[0] == ["one two three", "four five six"]


def test_label_eval_and_intervals(spark):
    rows = [(n, ["A"] if n % 2 else [], ["t"] if n % 4 == 1 else []) for n in range(400)]
    df = spark.createDataFrame(rows, "id int, rule_ids array<string>, techniques array<string>")
    mapping = spark.createDataFrame([("t", "A")], "technique string, rule_id string")
    outcomes = evaluate.rule_outcomes(df, ["id"], mapping)
    row = evaluate.label_eval(outcomes).first()
    assert (row.hits, row.raised, row.labelled, row.precision, row.recall) == (100, 200, 100, 0.5, 1.0)
    interval = evaluate.bootstrap_intervals(outcomes, "id").first()
    assert 0.3 < interval.precision_low < 0.5 < interval.precision_high < 0.7
    other = spark.createDataFrame([("t",), ("u",)], "technique string")
    assert [r.technique for r in evaluate.uncovered_techniques(other, mapping).collect()] == ["u"]


def test_bundled_pack_passes_its_audits(spark):
    rules = pack_table(spark, bundled_pack()).withColumn("pack_id", F.lit("bundled"))
    assert audit.validate_pack(rules).count() == 0
    assert audit.audit_intent_words(rules, ["rule_id"], ["name", "description"]).count() == 0
    catalog = rules.select("rule_id", "name", F.col("description").alias("short"))
    assert audit.catalog_audit(rules, catalog).count() == 0
    names = spark.createDataFrame([("Ostmere",), ("Ferrin",)], "word string")
    patterns = rules.select("rule_id", F.concat_ws(" ", "indicators").alias("text")).where("rule_id = 'SHAME_LEVER'")
    assert audit.name_list_hits(patterns, "rule_id", "text", names).count() == 0


def test_name_list_hits(spark):
    rows = [(1, "Ostmere and Ferrin"), (2, "Ostmere only"), (3, "OLW met QRS"), (4, "OLW, olw and QRS"), (5, "[Oo]stmere March Ferrin")]
    df = spark.createDataFrame(rows, "id int, text string")
    names = spark.createDataFrame([("Ostmere",), ("Ferrin",), ("March",)], "word string")
    got = {r.id: r.names for r in audit.name_list_hits(df, "id", "text", names).collect()}
    assert got == {1: 2, 3: 2, 5: 2}


@pytest.mark.parametrize("most", [20_000, 3])  # beyond three forms the list is joined
def test_denylist_forms(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "FORMS_IN_PLAN", most)
    rows = [
        (1, "The anti-idler rule"), (2, "Antiidlers met"), (3, "two lock keepers"), (4, "an idle man"),
        (5, "A lock-keeper slept"), (6, "He shut the lock. Keeper Marl slept"), (7, "lock  keeper, lock, keeper"),
        (8, "the harbor-pilot boats"), (9, "Capt. Marl"), (10, "a capt Marl"), (11, None),
    ]
    df = spark.createDataFrame(rows, "id int, text string")
    listed = spark.createDataFrame([(t,) for t in ("idler", "lock keeper", "harbor pilot boat", "harbor pilot", "pilot boat", "capt.")], "term string")
    exempt = spark.createDataFrame([], "id int, term string")
    found = {(r.id, r.form) for r in terms.denylist_terms(df, "id", "text", listed, exempt).collect()}
    assert found == {
        (1, "idler"), (2, "antiidlers"), (3, "lock keepers"), (5, "lock keeper"), (8, "harbor pilot boats"), (8, "pilot boats"), (8, "harbor pilot"), (9, "capt."),
    }
    empty = listed.limit(0)
    assert terms.denylist_terms(df, "id", "text", empty, exempt).count() == 0


def test_only_hits_leave_their_row(spark):
    df = spark.createDataFrame([(n, "an idle man with an idler. " * 50) for n in range(40)], "id int, text string")
    listed = spark.createDataFrame([("idler",)], "term string")
    found = terms.denylist_terms(df, "id", "text", listed, spark.createDataFrame([], "id int, term string"))
    assert found.count() == 40 and "word" not in found.columns
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "word#" not in plan


def _steps(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_plans_move_no_texts(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert _steps(corpus.url_inventory(df, "doc_id", "text", "x"), "Exchange hashpartitioning") == 0
    # The texts are read once more by their keys, never grouped or sorted by what they hold.
    assert "text" not in corpus.dedupe_first(df, "doc_id")._jdf.queryExecution().executedPlan().toString().split("Aggregate")[1].split("\n")[0]
    pairs = spark.createDataFrame([(1, "a", "b")], "id int, text_a string, text_b string")


def test_pairs_scan_each_text_once(spark):
    pairs = spark.createDataFrame([(n, "Everyone agrees.", "We must act now.") for n in range(50)], "id int, text_a string, text_b string")
    sides = compare.scan_sides(pairs, ["id"], bundled_pack())
    assert {(tuple(r.ids_a), tuple(r.ids_b)) for r in sides.collect()} == {(("CONSENSUS_AS_EVIDENCE",), ("FEAR_URGENCY",))}
    final = sides._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Reused") == 1 and compare.scanned_texts(pairs, ["text_a", "text_b"], bundled_pack()).count() == 2


def test_stream_windows(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "Everyone agrees."), ("2024-01-01 00:00:50", "Plain text."),
            ("2024-01-01 00:01:10", "We must act now."), ("2024-01-01 01:00:00", "Later.")]
    source = str(tmp_path / "in")
    table = spark.createDataFrame(rows, "t string, text string").select(F.col("t").cast("timestamp").alias("ts"), "text")
    table.coalesce(1).write.parquet(source)
    live = spark.readStream.schema(table.schema).parquet(source)
    counts = stream.tier_counts_by_window(live, "ts", "1 minute", "10 minutes", bundled_pack(), "all")
    run = (counts.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
           .trigger(availableNow=True).start(str(tmp_path / "out")))
    run.awaitTermination()
    got = {r.window_start.minute: tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The last window is still open; the two early ones are closed by the watermark.
    assert got == {0: (2, 1, 0, 0), 1: (1, 0, 1, 0)}


def test_two_packs_share_one_scan(spark, tmp_path):
    from checks.phrases import PHRASES
    from checks.queries import QUERIES
    from checks.variants import EARLIER, PACK
    from swayscan.functions.regex import to_java

    rows = [(n, f"{phrase} {PHRASES[(n * 7 + 3) % len(PHRASES)][0]}") for n, (phrase, _) in enumerate(PHRASES)] + [(-1, None)]
    texts = spark.createDataFrame(rows, "id int, text string")
    both = plan.with_moves_of_both(texts, EARLIER, PACK, "all")
    for column, pack in (("moves_before", EARLIER), ("moves_after", PACK)):
        want = {r["id"]: r["moves"] for r in plan.with_moves(texts, pack, "all").collect()}
        assert {r["id"]: r[column] for r in both.collect()} == want
    shared = next(r for r in PACK.rules if r["id"] == "FEAR_URGENCY")
    java = to_java(shared["indicators"][0], shared["flags"])
    for name in ("golden_check", "pack_diff"):
        steps = str(QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan())
        assert steps.count(java) == 1, name

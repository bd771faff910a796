"""Sentences, interval joins and evaluation by level, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from swayscan.functions.sentences import sentence_no, sentence_spans, sentence_starts
from swayscan.operators import evaluate, spaneval
from swayscan.sources.pack import bundled_pack


@pytest.mark.parametrize(
    "text, sentences",
    [
        ("One came. Two went.", ["One came. ", "Two went."]),
        ("Dr. Vell met Prof. Orne. They left!", ["Dr. Vell met Prof. Orne. ", "They left!"]),
        ("She lives in the U.S. now. Fine.", ["She lives in the U.S. now. ", "Fine."]),
        ("It was made in the U.S. The maker left.", ["It was made in the U.S. ", "The maker left."]),
        ("J. R. Marl sailed at 3 p.m. on Monday.", ["J. R. Marl sailed at 3 p.m. on Monday."]),
        ('"Stop!" He did. (It was late.) We ate.', ['"Stop!" ', "He did. ", "(It was late.) ", "We ate."]),
        ("A title\n\nand a body… Then more", ["A title\n\n", "and a body… ", "Then more"]),
        ("Is it? no, not yet. 5 ships came.", ["Is it? no, not yet. ", "5 ships came."]),
        ("See Fig. 3, e.g. Marl Inc. It holds.", ["See Fig. 3, e.g. Marl Inc. ", "It holds."]),
        ("\U0001f600 Ends. \U0001f600 Begins.", ["\U0001f600 Ends. ", "\U0001f600 Begins."]),
        ("no end ", ["no end "]), ("", []), (None, None),
    ],
)
def test_sentences(spark, text, sentences):
    df = spark.createDataFrame([(text,)], "text string").select("text", sentence_spans(F.col("text")).alias("s"))
    found = df.first().s
    assert (None if found is None else [text[s.start : s.end] for s in found]) == sentences


def test_words_of_accented_letters_and_line_ends(spark):
    rows = [(0, "Il vi B. Anéon vi."), (1, "See Dr\n. Pell here."), (2, "Ask Dr.\u00a0Pell now.")]
    found = spark.createDataFrame(rows, "n int, text string").select("n", F.size(sentence_starts(F.col("text"))).alias("s"))
    # "An" begins a longer word; the title is a line before the stop; a no-break space stands behind the stop
    assert [r.s for r in found.orderBy("n").collect()] == [1, 2, 1]


def test_sentence_numbers_and_long_texts(spark):
    text = "One came. Two went. " * 9_000
    df = spark.createDataFrame([(text,)], "text string").select(sentence_starts(F.col("text")).alias("s"))
    row = df.select(F.size("s").alias("n"), *(sentence_no(F.col("s"), F.lit(k)).alias(f"k{k}") for k in (0, 9, 10, 25))).first()
    assert tuple(row) == (18_000, 1, 1, 2, 3)


SPANS = "doc int, rule_id string, start int, end int, tag string"


def spans(rng, count, longest):
    return [(rng.randint(0, 3), rng.choice("AB"), s := rng.randint(0, 3000), s + rng.randint(0, longest), "x") for _ in range(count)]


def disjoint(rows):
    out = []
    for doc, rule, s, e in sorted(r[:4] for r in rows if r[2] < r[3]):
        if out and out[-1][:2] == [doc, rule] and s < out[-1][3]:
            out[-1][3] = max(out[-1][3], e)
        else:
            out.append([doc, rule, s, e])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("block", [7, 512])
def test_overlap_pairs_are_all_pairs_once(spark, block):
    rng = random.Random(block)
    left, right = spans(rng, 150, 90), spans(rng, 150, 900)
    got = spaneval.overlap_pairs(
        spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS), ["doc", "rule_id"], block
    ).collect()
    want = [
        (a[0], a[1], a[2], a[3], b[2], b[3], min(a[3], b[3]) - max(a[2], b[2]))
        for a in left for b in right
        if a[:2] == b[:2] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]
    ]
    assert sorted((r.doc, r.rule_id, r.left.start, r.left.end, r.right.start, r.right.end, r.common) for r in got) == sorted(want)


def best_matching(a, b):
    """Size of the largest one-to-one matching of overlapping spans, by augmenting paths."""
    partner = {}

    def place(i, seen):
        for j in range(len(b)):
            if a[i][0] < b[j][1] and b[j][0] < a[i][1] and j not in seen:
                seen.add(j)
                if j not in partner or place(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(a)))


def test_span_eval_by_definition(spark):
    rng = random.Random(9)
    labels, moves = spans(rng, 120, 60), spans(rng, 160, 40) + [(0, "C", 5, 9, "x")]
    got = {r.rule_id: r for r in spaneval.span_eval(spark.createDataFrame(labels, SPANS), spark.createDataFrame(moves, SPANS), ["doc"]).collect()}
    wanted, found = disjoint(labels), disjoint(moves)
    assert set(got) == {"A", "B", "C"}
    for rule, row in got.items():
        mine = [r for r in wanted if r[1] == rule]
        theirs = [r for r in found if r[1] == rule]
        hits = sum(
            best_matching([r[2:] for r in mine if r[0] == doc], [r[2:] for r in theirs if r[0] == doc]) for doc in range(4)
        )
        common = sum(max(0, min(a[3], b[3]) - max(a[2], b[2])) for a in mine for b in theirs if a[0] == b[0])
        assert (row.hits, row.raised, row.labelled, row.common_chars) == (hits, len(theirs), len(mine), common)
        assert row.raised_chars == sum(r[3] - r[2] for r in theirs) and row.labelled_chars == sum(r[3] - r[2] for r in mine)
        assert row.precision == (hits / len(theirs) if theirs else None) and row.recall == (hits / len(mine) if mine else None)


@pytest.mark.parametrize("bits", [62, 1])  # with one bit a mask, each rule has a column of its own
def test_levels(spark, monkeypatch, bits):
    monkeypatch.setattr(spaneval, "MASK_BITS", bits)
    pack = bundled_pack().only({"FEAR_URGENCY", "SHAME_LEVER"})
    sentences = spark.createDataFrame([(1, 0, 10), (1, 10, 30), (2, 0, 9)], "doc int, start int, end int")
    labels = spark.createDataFrame(
        [(1, "fear", 0, 5), (1, "fear", 12, 20), (1, "odd", 1, 2), (2, "odd", 1, 2), (2, "shame", 0, 3)],
        "doc int, technique string, start int, end int",
    )
    moves = spark.createDataFrame([(1, "FEAR_URGENCY", 8, 14), (2, "FEAR_URGENCY", 0, 4)], "doc int, rule_id string, start int, end int")
    mapping = spark.createDataFrame([("fear", "FEAR_URGENCY"), ("shame", "SHAME_LEVER")], "technique string, rule_id string")
    got = spaneval.level_eval(sentences, labels, moves, ["doc"], mapping, pack).collect()
    assert {(r.level, r.rule_id, r.technique, r.hits, r.raised, r.labelled, r.common_chars) for r in got} == {
        ("span", "FEAR_URGENCY", None, 1, 2, 2, 2), ("span", "SHAME_LEVER", None, 0, 0, 1, 0),
        ("sentence", "FEAR_URGENCY", None, 2, 3, 2, None), ("sentence", "SHAME_LEVER", None, 0, 0, 1, None),
        ("document", "FEAR_URGENCY", None, 1, 2, 1, None), ("document", "SHAME_LEVER", None, 0, 0, 1, None),
        ("uncovered", None, "odd", None, None, 2, None),
    }
    assert {(r.rules_version, r.rules_hash) for r in got} == {(pack.version, pack.fingerprint)}


def test_levels_send_only_the_mapping_to_all_tasks(spark, tmp_path):
    # packed in files, a side of 100,000 spans looks small enough to be sent around whole
    long = spark.range(100).selectExpr("id as doc", "transform(sequence(0, 999), n -> struct(n * 9 as start, n * 9 + 9 as end)) as s")
    long.write.parquet(f"{tmp_path}/t")
    spans = spark.read.parquet(f"{tmp_path}/t").select("doc", F.inline_outer("s"))
    pack = bundled_pack()
    rule = pack.rules[0]["id"]
    mapping = spark.createDataFrame([("t", rule)], "technique string, rule_id string")
    levels = spaneval.level_eval(
        spans, spans.withColumn("technique", F.lit("t")), spans.withColumn("rule_id", F.lit(rule)), ["doc"], mapping, pack
    )
    plan = levels._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastExchange" in line]
    assert sent and not any("bigint" in line for line in sent)  # no key and no offset
    assert "BroadcastHashJoin [technique" in plan and "Inner, BuildLeft" not in plan
    found = {r.level: (r.hits, r.raised, r.labelled) for r in levels.collect()}
    assert found == {"span": (100_000,) * 3, "sentence": (100_000,) * 3, "document": (100,) * 3}


def test_bootstrap_weighs_a_text_once_and_by_many_tasks(spark):
    rows = [(n, f"r{k}", int((n + k) % 3 > 0), int((n * k) % 2)) for n in range(60) for k in range(4) if (n + k) % 5]
    outcomes = spark.createDataFrame([*rows, (None, "r1", 1, 1)], "id int, rule_id string, raised int, labelled int").coalesce(1)
    got = {r.rule_id: r for r in evaluate.bootstrap_intervals(outcomes, "id", replicates=20, level=0.9).collect()}
    for rule in ("r0", "r1", "r2", "r3"):
        rates = {"precision": [], "recall": []}
        for n in range(1, 21):
            hits = raised = labelled = 0
            for key, name, r, l in [*rows, (None, "r1", 1, 1)]:
                if name == rule:
                    drawn = hashlib.md5((f"{n}" if key is None else f"{key}:{n}").encode()).hexdigest()
                    w = sum(limit <= int(drawn[:12], 16) / 2**48 for limit in evaluate.POISSON)
                    hits, raised, labelled = hits + w * r * l, raised + w * r, labelled + w * l
            for name, below in (("precision", raised), ("recall", labelled)):
                rates[name] += [hits / below] if below else []
        for name, values in rates.items():
            ranked = sorted(values)
            for end, at in (("low", 0.05), ("high", 0.95)):
                place = at * (len(ranked) - 1)
                low, part = int(place), place - int(place)
                want = ranked[low] + part * (ranked[min(low + 1, len(ranked) - 1)] - ranked[low]) if ranked else None
                assert got[rule][f"{name}_{end}"] == (want if want is None else pytest.approx(want)), (rule, name, end)
    plan = evaluate.bootstrap_intervals(outcomes, "id")._jdf.queryExecution().executedPlan().toString()
    # few bytes before they are rows per replicate: Spark would put them into one task
    assert "REPARTITION_BY_NUM" in plan and plan.count("md5") <= 2

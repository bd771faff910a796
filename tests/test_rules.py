"""Sentences that the bundled rules mark, and others that they leave alone."""

from checks.phrases import PHRASES
from swayscan import bundled_pack, moves
from swayscan.operators import compare


def test_every_phrase_raises_its_rules(spark):
    # The late-qualifier rule reads from the 200th character on.
    cases = [(n, "x" * 200 + " " + p if "MEDIA_BURIED_QUALIFIER" in r else p, list(r)) for n, (p, r) in enumerate(PHRASES)]
    df = spark.createDataFrame(cases, "id int, text string, want array<string>")
    rows = compare.expected_rules_check(df, ["id"], bundled_pack(), "want").collect()
    wrong = [PHRASES[r.id] for r in rows if r.verdict != "as expected"]
    assert not wrong and len(rows) == len(PHRASES)


def test_every_rule_has_a_phrase():
    raised = {rule for _, rules in PHRASES for rule in rules}
    assert raised == {r["id"] for r in bundled_pack().rules}


def test_swapped_names_raise_the_same_rules(spark):
    swaps = [
        (1, True, "the Ostmere Guild", "the Society for the Care of Old Lamps, Locks and Weirs".replace(",", "")),
        (2, False, "millers", "boat builders"),
        (3, True, "the O.L.W.", "St. Corwin"),
        (4, False, "Dr. Vell", "wren harrow"),
    ]
    from checks.variants import ORG_TEMPLATES, TEMPLATES

    df = spark.createDataFrame(swaps, "id int, is_org boolean, a string, b string")
    pairs = compare.make_pairs(df, TEMPLATES, ORG_TEMPLATES, ["id"])
    assert pairs.count() == 4 * len(TEMPLATES) + 2 * len(ORG_TEMPLATES)
    rows = compare.symmetry_check(compare.scan_sides(pairs, ["id", "template_no"], bundled_pack()), False).collect()
    assert {r.verdict for r in rows} == {"same"}
    limits = compare.known_limits_check(compare.scan_sides(pairs, ["id", "template_no"], bundled_pack())).collect()
    assert {r.verdict for r in limits} == {"unexpected pass"}


def test_neutral_text_raises_nothing(spark):
    text = "The council met on Tuesday and approved the budget after a long debate about roads."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert moves(df, ["id"], bundled_pack(), "all").count() == 0

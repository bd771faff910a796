"""The scan on small packs and texts, checked against expected spans."""

import json
import re

import pytest
from pyspark.sql import functions as F

from swayscan import bundled_pack
from swayscan.functions import regex
from swayscan.functions.spans import find_spans, with_utf16
from swayscan.functions.text import clip_text, folded, matchable, utf16_length, word_count
from swayscan.operators import compare
from swayscan.plans import scan as plan
from swayscan.sources import texts
from swayscan.sources.pack import RulePack, check_domain, load_rule_pack, pack_table


def tiny_pack(rules, citations=(r"\[\d+\]",), window=120):
    """A pack of ``{id: patterns}`` or ``{id: (patterns, changes)}``."""
    listed = []
    for name, value in rules.items():
        patterns, changes = value if isinstance(value, tuple) else (value, {})
        listed.append(
            {"id": name, "name": name, "description": name, "pit_tier": 1, "domain": "general",
             "severity": "low", "principle": "Truth", "indicators": patterns, "min_matches": 1,
             "suppress_if_cited": False, "flags": "i", **changes}
        )
    return RulePack(
        {"schema_version": "1", "rules_version": "0", "tiers": {},
         "citation_suppression": {"window": window, "flags": "i", "patterns": list(citations)}, "rules": listed}
    )


def spans(spark, pack, *cases, domain="all"):
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    rows = plan.moves(df, ["id"], pack, domain).collect()
    for row in rows:
        assert row.match == cases[row.id][row.start : row.end]
    out = [[] for _ in cases]
    for row in sorted(rows, key=lambda r: (r.id, r.move_no)):
        out[row.id].append((row.rule_id, row.start, row.end))
    return out


def test_overlaps_inside_a_rule_and_across_rules(spark):
    one = tiny_pack({"TIDE": ["low", "low tide", "tide table", "les"]})
    assert spans(spark, one, "a low tide tables") == [[("TIDE", 2, 10), ("TIDE", 14, 17)]]
    two = tiny_pack({"WEIR": ["old weir gate"], "GATE": ["weir gate", "gate"]})
    assert spans(spark, two, "the old weir gate") == [[("WEIR", 4, 17), ("GATE", 8, 17)]]


def test_order_start_then_longest_then_pack(spark):
    pack = tiny_pack({"C": ["abc"], "A": ["ab"], "B": ["abc"]})
    assert spans(spark, pack, "abcd") == [[("C", 0, 3), ("B", 0, 3), ("A", 0, 2)]]


def test_min_matches_counts_all_patterns_before_overlaps(spark):
    pack = tiny_pack({"R": (["abc", "bc"], {"min_matches": 2})})
    assert spans(spark, pack, "abc", "bc") == [[("R", 0, 3)], []]


def test_many_matches_in_one_text(spark):
    pack = tiny_pack({"R": ["ab", "b a"]})
    text = "ab " * 3000
    found = spans(spark, pack, text)[0]
    assert len(found) == 3000
    assert found[-1] == ("R", 8997, 8999)


CITED = {"R": (["claim"], {"suppress_if_cited": True})}


def test_citation_beside_far_and_first_occurrence(spark):
    pack = tiny_pack(CITED)
    far = "x" * 400
    got = spans(
        spark, pack,
        "a claim [3].",
        f"a claim {far} [3].",
        f"a claim [3]. {far} and a claim again",
        f"a claim here. {far} a claim [3]",
        "a claim" + " " * 119 + "[3]",
        "a claim" + " " * 120 + "[3]",
    )
    assert [len(g) for g in got] == [0, 1, 0, 2, 0, 1]


def test_long_citation_is_read_whole(spark):
    pack = tiny_pack(CITED, citations=[r"\(.{1,600}, 20\d\d\)"])
    assert spans(spark, pack, f"a claim ({'n' * 500}, 2020)") == [[]]


def test_index_drift_of_lengthened_lowercase(spark):
    # Each dotted capital I is two characters in lower case, so the window moves.
    pack = tiny_pack(CITED)
    assert [len(g) for g in spans(
        spark, pack, "İ" * 60 + " claim" + " x" * 80 + " [3]", "I" * 60 + " claim" + " x" * 80 + " [3]"
    )] == [0, 1]


UNICODE = [
    ("Nobody doubts\xe9 the tide.", []),
    ("It is \xe9Nobody doubts the tide.", []),
    ("Nobody doubts\u0301 the tide.", [("CONSENSUS_AS_EVIDENCE", 0, 13)]),
    ("\U0001d400Nobody doubts.", []),
    ("\u6e2f\u53e3Nobody doubts.", []),
    ("\U0001f6a2\u200d\U0001f30a Nobody doubts.", [("CONSENSUS_AS_EVIDENCE", 4, 17)]),
    ("\ue000 Nobody doubts.", [("CONSENSUS_AS_EVIDENCE", 2, 15)]),
    ("Nobody\x1cdoubts it.", [("CONSENSUS_AS_EVIDENCE", 0, 13)]),
    ("Nobody\x85doubts it.", [("CONSENSUS_AS_EVIDENCE", 0, 13)]),
    ("Nobody\ufeffdoubts it.", []),
    ("Nobody\xa0doubts it.", [("CONSENSUS_AS_EVIDENCE", 0, 13)]),
    ("Paint either hull\u2028red before it's too late or tar it.", [("FALSE_BINARY", 6, 45), ("FEAR_URGENCY", 22, 42)]),
    ("The boathouse is utterly de\u017ftroyed.", [("TOTALIZING_HARM_LANGUAGE", 17, 34)]),
    ("Oh thin\u212a of the families.", [("EMOTIONAL_SUBSTITUTION", 3, 24)]),
    ("The boathouse is wholly, entirely ru\u0131ned.", [("TOTALIZING_HARM_LANGUAGE", 25, 40)]),
    ("The boathouse is wholly, entirely ru\u0130ned.", [("TOTALIZING_HARM_LANGUAGE", 25, 40)]),
    ("Rope bonds went off \u0663\u0661% from the peak.", [("FIN_ANCHORING", 16, 37)]),
    ("Rope bonds went off \U0001d7d1\U0001d7cf% from the peak.", [("FIN_ANCHORING", 16, 37)]),
    ("Data suggests [\u0664] that tar holds.", []),
    ("Her \"\u0130nlet\" map and his \u201c\u0131nlet\u201d map.",
     [("MEDIA_SELECTIVE_QUOTATION", 0, 11), ("MEDIA_SELECTIVE_QUOTATION", 20, 31)]),
    ("z" * 200 + " Though, " + "\U0001f6a2" * 100 + " was later retracted.", [("MEDIA_BURIED_QUALIFIER", 201, 329)]),
    ("\U0001f6a2" * 199 + " Though, it was later corrected.", [("MEDIA_BURIED_QUALIFIER", 200, 230)]),
    ("\U0001f6a2" * 198 + " Though, it was later corrected.", []),
]


def test_unicode_texts_read_like_python(spark):
    pack = bundled_pack()
    got = spans(spark, pack, *(text for text, _ in UNICODE))
    for (text, want), found in zip(UNICODE, got):
        assert found == want, text


def test_both_engines_agree_on_odd_texts(spark):
    texts_ = [text for text, _ in UNICODE] + ["", " ", "\ue000", "nobody doubts " * 300, None]
    df = spark.createDataFrame(list(enumerate(texts_)), "id int, text string")
    rows = compare.engine_parity(df, ["id"], bundled_pack()).collect()
    assert len(rows) == len(texts_) and all(r.same and r.n_native == r.n_arrow for r in rows)


def test_intake_reports_and_never_truncates(spark):
    df = spark.createDataFrame(
        [(1, None), (2, "x" * 200_000), (3, "x" * 200_001), (4, "\U0001f642" * 200_000), (5, "")], "id int, text string"
    )
    reasons = {r.id: r.reject_reason for r in plan.intake(df).collect()}
    assert reasons == {1: "text is null", 2: None, 3: "text is too long", 4: None, 5: None}
    scanned = {r.id: r for r in plan.scan(df, bundled_pack()).collect()}
    assert {n: r.reject_reason for n, r in scanned.items()} == reasons
    assert scanned[1].moves is None and scanned[3].moves is None
    assert scanned[5].moves == [] and scanned[5].counts == (0, 0, 0)


def test_unknown_domain_of_a_row_is_rejected(spark):
    df = spark.createDataFrame([(1, "Nobody doubts it.", d) for d in ("Media", "media", None)], "id int, text string, d string")
    rows = {r.d: r for r in plan.scan(df, bundled_pack(), F.col("d")).collect()}
    assert rows["Media"].reject_reason == "domain is unknown" and rows["Media"].moves is None
    assert len(rows["media"].moves) == len(rows[None].moves) == 1


def test_rejected_cases_are_not_scanned_instead_of_passing(spark):
    long = "x" * 200_001
    pairs = spark.createDataFrame([(1, "a", None), (2, long, None), (3, "a", "b")], "id int, text_a string, text_b string")
    sides = compare.scan_sides(pairs, ["id"], bundled_pack())
    for check, last in ((compare.symmetry_check(sides, False), "same"), (compare.known_limits_check(sides), "unexpected pass")):
        assert {r.id: r.verdict for r in check.collect()} == {1: "not scanned", 2: "not scanned", 3: last}
    cases = spark.createDataFrame([(1, None), (2, long)], "id int, text string").withColumns(
        {"rule_id": F.lit("FALSE_BINARY"), "polarity": F.lit(True), "want": F.array(F.lit("FALSE_BINARY"))}
    )
    for check in (compare.polarity_check(cases, ["id"], bundled_pack()), compare.expected_rules_check(cases, ["id"], bundled_pack(), "want")):
        assert [r.verdict for r in check.collect()] == ["not scanned"] * 2


def test_dense_texts_keep_their_places(spark):
    # Long enough for blocks of pieces and of text, with characters above U+FFFF in between.
    pack = tiny_pack({"R": (["claim"], {"suppress_if_cited": True}), "S": ["\\bab\\b"]})
    text = ("ab \U0001f642 claim " * 3000)[:30_000]
    found = spans(spark, pack, text)[0]
    assert len(found) == text.count("claim") + text.count("ab ")
    df = spark.createDataFrame([(text,)], "text string")
    offsets = F.array(*map(F.lit, (0, 1, 1023, 1024, 1025, 9999, 30_000)))
    got = df.select(with_utf16(F.col("text"), lambda units: F.transform(offsets, units))).first()[0]
    assert got == [len(text[:n].encode("utf-16-be")) // 2 for n in (0, 1, 1023, 1024, 1025, 9999, 30_000)]


def test_domains(spark):
    pack = bundled_pack()
    text = "Everyone agrees. This is well-settled law. The controversial bill passed."
    assert [len(g) for d in (None, "general", "legal", "media", "all") for g in spans(spark, pack, text, domain=d)] == [1, 1, 2, 2, 3]
    with pytest.raises(ValueError):
        check_domain("auto")


def test_pack_guards():
    for pattern, flags in (("x*", ""), (r"\b", ""), ("(a)b", ""), ("[\U00010000-\U0010ffff]", ""), ("a", "x")):
        with pytest.raises(ValueError):
            tiny_pack({"R": ([pattern], {"flags": flags})})


def test_pack_loads_from_any_spark_path(spark, tmp_path):
    path = tmp_path / "pack.json"
    path.write_text(json.dumps(bundled_pack().content), encoding="utf-8")
    loaded = load_rule_pack(spark, str(path))
    assert loaded.fingerprint == bundled_pack().fingerprint
    assert pack_table(spark, loaded).count() == 43
    (tmp_path / "other.json").write_text("{}")
    with pytest.raises(ValueError):
        load_rule_pack(spark, str(tmp_path))
    split = [sum(r["domain"] == d for r in loaded.rules) for d in ("general", "legal", "media", "financial")]
    assert split == [23, 6, 9, 5]


def test_pack_file_matches_its_source():
    from swayscan.rules.catalog import build_pack

    assert build_pack() == bundled_pack().content


def test_needs_never_hide_a_match():
    # Each pattern's literals are in every phrase the pattern matches.
    import re

    from checks.phrases import PHRASES

    for rule in bundled_pack().rules:
        for pattern in rule["indicators"]:
            compiled = re.compile(pattern, regex.flag_bits(rule["flags"]))
            needed = regex.needs(pattern, rule["flags"])
            for text, _ in PHRASES:
                if compiled.search(text):
                    folded = text.translate(str.maketrans("\u017f\u212a\u0131\u0130", "skii")).lower()
                    for literals in needed.words:
                        assert any(re.search(r"(?<!\w)" + re.escape(x), folded) for x in literals), (pattern, text)
                    for literals in needed.marks:
                        assert any(x in folded for x in literals), (pattern, text)


def test_text_columns(spark):
    cases = ["", "  two words ", "a\U0001f642b", "\U0001f642" * 3, "plain"]
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    got = df.select(
        word_count(F.col("text")), utf16_length(F.col("text")),
        *(clip_text(F.col("text"), n) for n in (1, 2, 3, 5)),
    ).collect()
    for text, row in zip(cases, got):
        units = text.encode("utf-16-be")
        assert row[0] == len(text.split()) and row[1] == len(units) // 2
        for n, clipped in zip((1, 2, 3, 5), row[2:]):
            assert clipped == units[: 2 * n].decode("utf-16-be", errors="ignore")


def test_result_json_is_ascii_and_keeps_field_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "They praised the \"fix\" and their “réform” \U0001f642 again.")], "id int, text string")
    texts.write_scan_json(plan.scan(df, bundled_pack(), "media"), str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert line.isascii()
    result = json.loads(line)
    assert list(result) == ["rules_version", "rules_hash", "moves", "counts"]
    assert list(result["moves"][0]) == ["rule_id", "name", "tier", "domain", "severity", "start", "end", "match"]
    assert [m["match"] for m in result["moves"]] == ['the "fix"', "their “réform”"]
    assert result["counts"] == {"1": 0, "2": 2, "3": 0}


def test_read_utf8_files(spark, tmp_path):
    (tmp_path / "good.txt").write_bytes("línea\r\ndos".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\x20")
    (tmp_path / "long.txt").write_bytes(b"x" * 200_001)
    (tmp_path / "huge.txt").write_bytes(b"x" * 800_001)
    rows = {r.path.rsplit("/", 1)[1]: r for r in texts.read_utf8_files(spark, str(tmp_path)).collect()}
    assert rows["good.txt"].text == "línea\r\ndos" and rows["good.txt"].reject_reason is None
    assert rows["bad.txt"].reject_reason == "not valid UTF-8"
    assert rows["long.txt"].reject_reason == "text is too long"
    assert rows["huge.txt"].reject_reason == "too many bytes" and rows["huge.txt"].text is None


def test_the_scan_does_not_shuffle(spark):
    df = spark.range(10).select("id", F.lit("Everyone agrees.").alias("text"))
    plan_text = plan.moves(df, ["id"], bundled_pack(), "all")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan_text and "Python" not in plan_text


def test_prefilter_report_walks_a_text_once_per_rule(spark):
    from swayscan.plans.scan import prefilter_report

    pack = bundled_pack().only({"SHAME_LEVER", "FALSE_BINARY"})
    texts = ["Only a fool waits.", "History will judge us.", "There are only two choices.", "The nets dry.", None]
    report = prefilter_report(spark.createDataFrame([(t,) for t in texts], "text string"), pack, "all")
    assert {r.rule_id: (r.matched, r.hidden) for r in report.collect()} == {"SHAME_LEVER": (2, 0), "FALSE_BINARY": (1, 0)}
    patterns = sum(len(r["indicators"]) for r in pack.rules)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    # one for each rule, and one for each pattern behind it
    assert plan.count("RLIKE(_match") == len(pack.rules) + patterns


def test_prefilter_report_leaves_out_patterns_by_plain_letters_only(spark, monkeypatch):
    from swayscan.functions.plain import Plain

    pack = tiny_pack({"A": ["salt tide", r"tid(?:e|al)s?\b", r"\d+"], "B": ["alto|al"]})
    texts = ["SALT TIDE", "\u017falt t\u0130de", "tidal 7", "an alt", "wet", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    lists = [r.x for r in rows.select(Plain(["salt tide", "tid(?:e|al)", "alto|al"]).seen(folded(F.col("text"))).alias("x")).collect()]
    assert [x and set(x) for x in lists] == [{"salt tide", "al", "tid"}, {"salt tide", "al", "tid"}, {"tid", "al"}, {"al"}, [], [], None]
    found = lambda: {r.rule_id: (r.matched, r.hidden) for r in plan.prefilter_report(rows, pack, "all").collect()}
    assert found() == {"A": (3, 0), "B": (4, 0)}
    steps = plan.prefilter_report(rows, pack, "all")._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in steps  # else every pattern walks over every text
    # a filter that lets nothing run hides every match
    monkeypatch.setattr(plan.Literals, "holds", lambda *_: "false")
    assert found() == {"A": (3, 3), "B": (4, 4)}


def test_write_files_takes_the_place_of_what_was_there(spark, tmp_path):
    rows = [("a/1.txt", b"one\xff\n"), ("a/2.txt", b""), ("b/3.txt", "\u017f\r\n".encode())]
    files = spark.createDataFrame(rows, "name string, content binary")
    (tmp_path / "a").mkdir()
    (tmp_path / "a/0.txt").write_bytes(b"old")
    for uri in (str(tmp_path), f"file://{tmp_path}", str(tmp_path / "new")):
        assert texts.write_files(files, uri) == 3
    assert {str(x.relative_to(tmp_path)): x.read_bytes() for x in tmp_path.glob("[ab]/*")} == dict(rows)
    assert texts.write_files(files.limit(0), str(tmp_path / "new")) == 0 and not list((tmp_path / "new").iterdir())


def test_long_lists_and_leading_look_behinds_are_told_early(spark):
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "aeiouy"]
    listed = rf"\b(?i:{'|'.join(words)})\b"
    assert set(regex.needs(listed, "").words[0]) == set(words)  # else the pattern runs on every text
    behind = r"(?<!\w\s)\b(?:Salt|Iron)\s+(?i:tide)\b"
    assert regex.to_java(behind, "").startswith("(?=[")  # a look at one letter comes before the look-behind
    assert all(regex.needs(p, r["flags"]).words or regex.needs(p, r["flags"]).marks for r in bundled_pack().rules for p in r["indicators"])
    texts = ["Salt tide, \u017falt tide", "x Salt tide", "Iron TIDE. iron tide", "HYWORD haword", "\U0001d400haword, \u00e9haword", "ib\u0131word", ""]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    for pattern in (behind, listed):
        got = rows.select("n", find_spans(F.col("text"), pattern).alias("s")).orderBy("n").collect()
        assert [[(x.start, x.end) for x in r.s] for r in got] == [[m.span() for m in re.finditer(pattern, t)] for t in texts]


def test_citations_are_found_as_by_every_pattern(spark):
    pack = bundled_pack()
    texts = ["Ibid. and supra note 4", "as in NAT\u2019L Board 12, (Orr 1999)", "x (see Pell, 2004a) [3]", "TABLE 4; p. 9; Orr v. Pell; Orr v Pell;",
             "12 U.S. 345 and [1999] 2 ab 44", "1999 ab 44; Mark 3:16", "supra", "fi\u0261ure 3, \u017fupra at 3", "no more", ""]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    got = rows.select("n", plan.citation_spans(matchable(F.col("text")), pack).alias("s")).orderBy("n").collect()
    cites = [re.compile(p, regex.flag_bits(pack.citations["flags"])) for p in pack.citations["patterns"]]
    assert [[(x.start, x.end) for x in r.s] for r in got] == [[m.span() for c in cites for m in c.finditer(t)] for t in texts]


def test_snippets_are_cut_once_per_text(spark):
    pack = tiny_pack({"A": ["salt"], "B": ["tide"]})
    texts = spark.createDataFrame([(1, "salt \u2003 tide " + "x" * 200), (2, "none"), (3, None)], "doc_id int, text string")
    changes = compare.pack_changes(texts, ["doc_id"], pack, pack.only({"A"}))
    steps = changes._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in steps[: steps.index("Generate")]
    snippet = "salt tide " + "x" * 100
    assert sorted(map(tuple, changes.collect())) == [(1, "A", "same", snippet), (1, "B", "lost", snippet)]


def test_literals_go_on_over_white_space(spark):
    import re

    from checks.phrases import PHRASES

    assert regex.needs(r"\b(?i:only\s+a\s+fool)\b", "", True).words == (("only a fool",),)  # "only" alone lets far more texts through
    rows = [(n, phrase.replace(" ", blank)) for n, (phrase, _) in enumerate(PHRASES) for blank in (" ", "\n", "\u00a0 \t", "\u2003\x1c")]
    raw = plan.raw_spans(spark.createDataFrame(rows, "id int, text string"), bundled_pack(), "all")
    for row in raw.select("text", "_raw").collect():
        got = {r["ord"]: sorted((s["start"], s["end"]) for s in r["spans"]) for r in row["_raw"]}
        want = {}
        for n, rule in bundled_pack().select("all"):
            found = [m.span() for p in rule["indicators"] for m in re.finditer(p, row["text"], regex.flag_bits(rule["flags"]))]
            if found:
                want[n] = sorted(found)
        assert got == want, row["text"]


def test_literals_are_bits_and_looked_up_once(spark):
    from swayscan.functions.text import Literals

    assert "(?:" not in regex.word_finder(["only a fool"]).split("(?=(")[1]  # a group for each letter would be a step for each
    literals = Literals([regex.Needs((("tide", "weir"), ("low tide",)), ()), regex.Needs((("ti",),), ())])
    texts_ = ["a weir", "low \u2003 Tide", "tin low", "xtide", "\u00e9tide ti\u017f", "", None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts_)], "n int, text string")
    seen = [r.s for r in rows.select("n", literals.seen(F.col("text")).alias("s")).orderBy("n").collect()]
    place = literals.place
    want = [{("tide", "weir")}, {("tide", "weir"), ("low tide",), ("ti",)}, {("ti",)}, set(), {("ti",)}, set()]
    assert seen[:-1] == [[sum(1 << place[s] for s in w)] for w in want] and seen[-1] is None
    steps = plan.with_moves(rows, bundled_pack())._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" not in steps and "from_json" not in steps


def test_citations_without_digits_skip_patterns_that_need_them():
    cites = bundled_pack().citations["patterns"]
    without = [p for p in cites if not regex.needs_digit(p, "i")]
    assert len(cites) - len(without) == 9 and regex.needs_digit(r"x\d?[1-9]", "") and not regex.needs_digit(r"x\d?[1-9a]", "")
    for p in set(cites) - set(without):
        assert not any(re.search(p, t, re.I) for t in ("Ibid. supra note", "(Orr, 19)".replace("19", ""), "Orr v. Pell. table b", "[x] p. s"))


def test_sentences_of_moves_are_found(spark):
    from swayscan.operators import present

    assert regex.to_java(r"^\p{Ll}", "") == r"^\p{Ll}"  # kinds of letters as Java names them
    df = spark.createDataFrame([(1, "Dr. Orr came. Nobody doubts it. e.g. so")], "doc_id int, text string")
    rows = present.move_sentences(plan.with_moves(df, bundled_pack()), ["doc_id"]).collect()
    assert [(r.start, r.sentence_no, r.first_sentence) for r in rows] == [(14, 2, False)]


def test_second_engine_leaves_out_patterns_by_letters_of_its_own():
    from checks.phrases import PHRASES

    odd = str.maketrans("\u017f\u212a\u0131\u0130", "skii")
    texts_ = [p for p, _ in PHRASES] + [t for t, _ in UNICODE]
    for rule in bundled_pack().rules:
        for pattern in rule["indicators"]:
            parts = compare.plain_letters(pattern)
            assert parts, pattern  # else it runs on every text
            for text in texts_:
                if re.search(pattern, text, regex.flag_bits(rule["flags"])):
                    assert any(part in text.translate(odd).lower() for part in parts), (pattern, text)
    assert compare.plain_letters(r"(?:ab|)c?d*") == () and compare.plain_letters(r"(?i:Ab|xy)+[cd]efg?") == ("ef",)


def test_domains_look_up_citations_once(spark):
    df = spark.createDataFrame([(1, "Studies show it [3]. Everyone agrees. This is well-settled law."), (2, None)], "doc_id int, text string")
    checked = compare.domain_independence(df, ["doc_id"], bundled_pack())
    steps = checked._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("(?:id|ibid)") == 1
    rows = {(r.doc_id, r.domain): (r.n_moves, r.same) for r in checked.collect()}
    assert rows[1, "legal"] == rows[1, "all"] == (2, True) and rows[1, "media"] == (1, True) and rows[2, "all"] == (None, None)

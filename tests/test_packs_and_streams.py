"""Pack hashes and types, facts in one table, every domain, files, late texts."""

import hashlib
import json

from pyspark.sql import functions as F

from swayscan.operators import audit, compare
from swayscan.plans import scan as plan
from swayscan.sources import texts
from swayscan.sources.pack import bundled_pack, canonical_column, canonical_json, pack_hash
from swayscan.streaming import stream


def test_canonical_json_and_hash_are_those_of_python(spark):
    values = [
        bundled_pack().content, {}, {"b": [1, {"z": None, "a": [True, False]}], "a": "", "B": {"é": "\x00\x1f\x0b\"\\/\n\t\b\f\r\x7f "}},
        {"t": "\\u001F \\\x1f \U0001f642", "n": -12345678901234567890}, ["x", []],
    ]
    rows = [(n, json.dumps(v, ensure_ascii=n % 2 == 0, indent=n % 3 or None)) for n, v in enumerate(values)] + [(9, "{"), (10, None)]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {r.id: (r.c, r.h) for r in df.select("id", canonical_column("j").alias("c"), pack_hash("j").alias("h")).collect()}
    for n, v in enumerate(values):
        assert got[n] == (canonical_json(v), hashlib.sha256(canonical_json(v).encode()).hexdigest())
    assert got[0][1] == bundled_pack().fingerprint and got[9] == got[10] == (None, None)


def problems(spark, *packs):
    rows = [(n, p if isinstance(p, str) or p is None else json.dumps(p)) for n, p in enumerate(packs)]
    found = audit.type_problems(spark.createDataFrame(rows, "id int, json string"), "id").collect()
    return [sorted(r.problem for r in found if r.id == n) for n in range(len(packs))]


def test_types_of_pack_fields(spark):
    good = bundled_pack().content
    rule = good["rules"][0]
    spoilt = {**good, "schema_version": 1, "rules": [{**rule, "pit_tier": "1", "min_matches": 1.0, "suppress_if_cited": 0},
                                                      {**rule, "indicators": "x", "flags": None}, 7], "tiers": {**good["tiers"], "2": {"name": []}}}
    assert problems(spark, good, spoilt, "no json", None, "[1]", {"rules": {}, "citation_suppression": {"patterns": [], "window": "9"}}) == [
        [],
        sorted(["pack: schema_version is not a string", "rule 0: min_matches is not a whole number", "rule 0: pit_tier is not a whole number", "rule 0: suppress_if_cited is not true or false",
                "rule 1: indicators is not a list of strings", "rule 1: flags is not a string", "tier 2: name is not a string"]),
        [], [], [],
        ["citation_suppression: window is not a whole number", "pack: rules is not a list"],
    ]


def test_cube_of_facts(spark):
    rows = [("a", "e3:1", "Everyone agrees. We must act now."), ("a", "e3:2", "Everyone agrees."), ("b", "x", "Everyone agrees."),
            ("b", "y", "Plain."), (None, "e3:4", "We must act now. We must act now."), (None, "z", None)]
    df = spark.createDataFrame(rows, "file string, src string, text string")
    got = compare.fact_cube(plan.with_moves(df, bundled_pack(), "all"), "file", "src", "e3:").collect()
    facts = {(r.file, r.all_files, r.rule_id): tuple(r)[3:] for r in got}
    assert len(got) == len(facts) == 10
    consensus, fear = "CONSENSUS_AS_EVIDENCE", "FEAR_URGENCY"
    assert facts[None, True, None] == (6, 3, 4, 6) and facts["a", False, None] == (2, 2, 2, 3)
    assert facts[None, True, consensus] == (3, 2, 2, 3) and facts[None, True, fear] == (2, 2, 2, 3)
    assert facts["a", False, consensus] == (2, 2, 2, 2) and facts["b", False, consensus] == (1, 0, 1, 1)
    assert facts[None, False, fear] == (1, 1, 1, 2) and facts[None, False, None] == (2, 1, 1, 2)


def test_every_domain_of_a_text(spark):
    text = "Everyone agrees. The disgraced pilot sang. It is well-settled law. Guaranteed returns, see [3]. Studies show it [4]."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = {(r.id, r.domain): (r.n_moves, r.same) for r in compare.domain_independence(df, ["id"], bundled_pack()).collect()}
    assert len(got) == 15 and got[2, "all"] == (None, None) and got[3, "legal"] == (0, True)
    for domain in ("general", "legal", "media", "financial", "all"):
        alone = plan.with_moves(df.where("id = 1"), bundled_pack(), domain).first().moves
        assert got[1, domain] == (len(alone), True)


def test_files_of_every_kind(spark, tmp_path):
    for name, content in {"a": b"x\r\ny", "b": b"\xff", "c": b"z" * 800_001, "d": b"z" * 200_001, "e": b"", "f": "é".encode()}.items():
        (tmp_path / name).write_bytes(content)
    found = texts.read_utf8_files(spark, str(tmp_path))
    plans = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,800000)]" in plans
    got = {r.path[-1]: (r.text, r.reject_reason) for r in found.collect()}
    assert got["a"] == ("x\r\ny", None) and "e" not in got and got["f"] == ("é", None)
    assert {k: v[1] for k, v in got.items() if v[1]} == {"b": "not valid UTF-8", "c": "too many bytes", "d": "text is too long"}


def test_late_texts_are_counted(spark, tmp_path):
    def put(*rows):
        table = spark.createDataFrame(rows, "t string, text string").select(F.col("t").cast("timestamp").alias("ts"), "text")
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        stream.count_windows(live, "ts", "1 minute", "10 minutes", str(tmp_path / "out"), bundled_pack(), "all")
        found = stream.window_totals(spark, str(tmp_path / "out"), "10 minutes").collect()
        return {r.window_start and r.window_start.strftime("%H:%M"): tuple(r)[1:] for r in found}

    first = put(("2024-01-01 00:00:10", "Everyone agrees."), ("2024-01-01 00:00:50", "Plain."), ("2024-01-01 00:30:00", None))
    assert first == {"00:00": (2, 0, 1, 0, 0, True), "00:30": (1, 0, 0, 0, 0, False)}
    # the watermark is now 00:20: one text is late, one still in time, one without a time
    second = put(("2024-01-01 00:00:20", "We must act now."), ("2024-01-01 00:25:00", "We must act now."), (None, "Plain."))
    assert second == {"00:00": (2, 1, 1, 0, 0, True), "00:25": (1, 0, 0, 1, 0, False), "00:30": (1, 0, 0, 0, 0, False),
                      None: (1, 0, 0, 0, 0, False)}
    assert sum(v[0] + v[1] for v in second.values()) == 6


def test_packs_are_parsed_once_for_all_fields(spark):
    from swayscan.operators import audit

    packs = spark.createDataFrame([(1, '{"schema_version": 1, "rules": [{"id": 2, "flags": "i"}]}'), (2, "no json")], "n int, json string")
    found = audit.type_problems(packs, "n")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1
    assert sorted(r.problem for r in found.collect()) == ["pack: schema_version is not a string", "rule 0: id is not a string"]


def test_late_windows_reads_many_files(spark, sf, tmp_path, monkeypatch):
    from checks import queries

    monkeypatch.setattr(queries, "shared_folder", lambda spark: str(tmp_path))
    queries.late_windows(spark, sf)
    assert len(list((tmp_path / "in").glob("*.parquet"))) > 2

"""Rule packs: loading, tables, fingerprints."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import cached_property
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swayscan.functions.regex import check_pattern

# Fixed values of the pack format.
RULE_DOMAINS = ("general", "legal", "media", "financial")
DOMAINS = (*RULE_DOMAINS, "all")
SEVERITIES = ("low", "moderate", "high", "critical")
PRINCIPLES = ("Truth", "Justice", "Clarity", "Agency", "Identity")
FLAGS = ("", "i", "s", "is")
TIERS = (1, 2, 3)
CITATION_REACH = 1000
"""How far past the citation window a citation touching it is read."""

RULE_SCHEMA = (
    "struct<id:string,name:string,description:string,pit_tier:int,domain:string,"
    "severity:string,principle:string,indicators:array<string>,min_matches:int,"
    "suppress_if_cited:boolean,flags:string>"
)
PACK_SCHEMA = (
    "schema_version string, rules_version string, "
    "tiers map<string,struct<name:string,alias:string,description:string>>, "
    "citation_suppression struct<window:int,flags:string,patterns:array<string>>, "
    f"rules array<{RULE_SCHEMA}>"
)


def canonical_json(value) -> str:
    """Sorted keys, no white space, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@dataclass(frozen=True)
class RulePack:
    """One checked rule pack. Patterns become literals in the scan's plan."""

    content: dict = field(hash=False)

    def __post_init__(self):
        cites = self.content["citation_suppression"]
        for pattern in cites["patterns"]:
            check_pattern(pattern, cites["flags"])
        for rule in self.rules:
            for pattern in rule["indicators"]:
                check_pattern(pattern, rule["flags"])

    @property
    def rules(self) -> list[dict]:
        return self.content["rules"]

    @property
    def version(self) -> str:
        return self.content["rules_version"]

    @property
    def citations(self) -> dict:
        return self.content["citation_suppression"]

    @cached_property
    def fingerprint(self) -> str:
        return hashlib.sha256(canonical_json(self.content).encode("utf-8")).hexdigest()

    def select(self, domain: str | None) -> list[tuple[int, dict]]:
        """``(order, rule)`` of the rules a domain uses; None means general."""
        domain = check_domain(domain)
        wanted = RULE_DOMAINS if domain == "all" else ("general", domain)
        return [(n, r) for n, r in enumerate(self.rules) if r["domain"] in wanted]

    def only(self, rule_ids) -> RulePack:
        """The same pack with only these rules, in pack order."""
        kept = [r for r in self.rules if r["id"] in set(rule_ids)]
        return RulePack({**self.content, "rules": kept})


def check_domain(domain: str | None) -> str:
    domain = "general" if domain is None else domain
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain!r}; one of {DOMAINS} is expected")
    return domain


def bundled_pack() -> RulePack:
    """A fresh copy of the pack that ships with the package."""
    raw = resources.files("swayscan.rules").joinpath("pack.json").read_text(encoding="utf-8")
    return RulePack(json.loads(raw))


def load_rule_pack(spark: SparkSession, path: str) -> RulePack:
    """A pack file from any file system that Spark reads.

    A pack is a few hundred kilobytes at most; its patterns have to reach the
    driver, because they are literals of the plan.
    """
    files = spark.read.text(path, wholetext=True).take(2)
    if len(files) != 1:
        raise ValueError(f"one pack file is expected at {path!r}, not none or several")
    return RulePack(json.loads(files[0][0]))


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Pack files as one row each, in the closed pack schema."""
    return spark.read.schema(PACK_SCHEMA + ", _corrupt_record string").json(path, multiLine=True)


def parse_packs(df: DataFrame, column: str) -> DataFrame:
    """Pack texts held in a column, parsed into the pack schema."""
    parsed = F.from_json(column, PACK_SCHEMA)
    return df.select("*", parsed.alias("pack")).select("*", "pack.*").drop("pack", column)


def rule_rows(packs: DataFrame, *keys: str) -> DataFrame:
    """One row per rule; ``ord`` is its position in the pack."""
    return packs.select(
        *keys, "rules_version", F.posexplode("rules").alias("ord", "rule")
    ).select(*keys, "rules_version", "ord", "rule.*").withColumnRenamed("id", "rule_id")


def indicator_rows(rules: DataFrame, *keys: str) -> DataFrame:
    """One row per pattern of each rule."""
    return rules.select(
        *keys, "rule_id", "ord", "flags",
        F.posexplode("indicators").alias("indicator_no", "indicator"),
    )


def pack_table(spark: SparkSession, pack: RulePack) -> DataFrame:
    """The rules of one pack as a table (tens of rows)."""
    text = spark.createDataFrame([(json.dumps(pack.content),)], "json string")
    return rule_rows(parse_packs(text, "json"))


def canonical_column(text: str) -> F.Column:
    """JSON text in canonical form: keys sorted, no white space, characters as they are; null for what is no JSON.

    A Variant keeps the keys of objects sorted. Only the case of hexadecimal escapes has to be mended. Packs hold no
    numbers with fractions, whose form may differ.
    """
    out = F.to_json(F.try_parse_json(F.col(text)))
    for letter in "ABCDEF":
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*\\u00[01]){letter}", rf"$1{letter.lower()}")
    return out


def pack_hash(text: str) -> F.Column:
    """SHA-256 of a pack held as JSON text; equal to ``RulePack.fingerprint``."""
    return F.sha2(canonical_column(text), 256)


def rule_fingerprint(rule) -> F.Column:
    """SHA-256 of one rule's JSON, for finding changed rules."""
    return F.sha2(F.to_json(rule), 256)


def stamp(df: DataFrame, pack: RulePack) -> DataFrame:
    """Add the pack's version and fingerprint to every row."""
    return df.withColumns(
        {"rules_version": F.lit(pack.version), "rules_hash": F.lit(pack.fingerprint)}
    )

"""Audits of pack tables and of any text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayscan.functions.spans import let
from swayscan.sources.pack import FLAGS, PRINCIPLES, RULE_DOMAINS, SEVERITIES, TIERS

# Words of motive that a name or description must not hold.
INTENT_WORDS = (
    r"(?i)manipulat|intimidat|silenc|fabricat|deceiv|deceptive|disguis|trick|exploit|coerc"
    r"|designed\s+to|in\s+order\s+to|to\s+avoid|to\s+create\s+an?\s+impression|to\s+discourage"
    r"|to\s+shut\s+down|to\s+bypass|to\s+force|forces?\s+a|weaponi[sz]|propagandi[sz]"
)
# Calendar words, which are no names.
CALENDAR_WORDS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday",
    "saturday", "sunday",
)


def validate_pack(rules: DataFrame) -> DataFrame:
    """Violations of the pack format, one row per rule and problem.

    ``rules`` is a rule table (``pack_id, ord, rule_id, ...``) of any number of
    packs.
    """
    needed = ("rule_id", "name", "description", "pit_tier", "domain", "severity", "principle",
              "indicators", "min_matches", "suppress_if_cited", "flags")
    tests = [(F.col(c).isNull(), f"{c} is missing") for c in needed]
    tests += [
        (~F.col("rule_id").rlike(r"\A[A-Z][A-Z0-9_]*\z"), "rule_id has another shape"),
        (~F.col("pit_tier").isin(*TIERS), "pit_tier is not 1, 2 or 3"),
        (~F.col("domain").isin(*RULE_DOMAINS), "domain is unknown"),
        (~F.col("severity").isin(*SEVERITIES), "severity is unknown"),
        (~F.col("principle").isin(*PRINCIPLES), "principle is unknown"),
        (~F.col("flags").isin(*FLAGS), "flags are unknown"),
        (F.size("indicators") < 1, "no indicator"),
        (F.col("min_matches") < 1, "min_matches is below 1"),
    ]
    problems = F.filter(F.array(*(F.when(t, label) for t, label in tests)), lambda p: p.isNotNull())
    found = rules.select("pack_id", "rule_id", F.explode_outer(problems).alias("problem"))
    repeated = (
        rules.where(F.col("rule_id").isNotNull())
        .groupBy("pack_id", "rule_id").count().where("count > 1")
        .select("pack_id", "rule_id", F.lit("rule_id is used twice").alias("problem"))
    )
    return found.where(F.col("problem").isNotNull()).unionByName(repeated)


def catalog_audit(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules without a catalog name, names without a rule, empty and repeated names."""
    def problem(df, label, item):
        return df.select(F.lit(label).alias("problem"), F.col(item).alias("item"))

    unnamed = rules.join(catalog, "rule_id", "left_anti")
    unknown = catalog.join(rules, "rule_id", "left_anti")
    empty = catalog.where((F.coalesce(F.trim("name"), F.lit("")) == "") | (F.coalesce(F.trim("short"), F.lit("")) == ""))
    repeated = catalog.groupBy("name").count().where("count > 1 and trim(name) != ''")
    return (
        problem(unnamed, "rule has no name", "rule_id")
        .unionByName(problem(unknown, "name has no rule", "rule_id"))
        .unionByName(problem(empty, "name or description is empty", "rule_id"))
        .unionByName(problem(repeated, "name is used twice", "name"))
    )


def changed_rules_audit(changed: DataFrame, rules: DataFrame, documented: DataFrame, cases: DataFrame) -> DataFrame:
    """Rules listed as changed that do not exist, are not documented or have no case."""
    changed = changed.select("rule_id").distinct()
    checks = ((rules, "not in the pack"), (documented, "not documented"), (cases, "no case"))
    parts = [
        changed.join(side.select("rule_id").distinct(), "rule_id", "left_anti")
        .select("rule_id", F.lit(label).alias("problem"))
        for side, label in checks
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def audit_intent_words(df: DataFrame, keys: list[str], columns: list[str], pattern: str = INTENT_WORDS) -> DataFrame:
    """Texts that state a motive, with the first wording that does."""
    long = df.unpivot(keys, columns, "field", "body")
    word = F.regexp_extract("body", pattern, 0)
    return long.where(F.col("body").rlike(pattern)).select(*keys, "field", word.alias("wording"))


def name_list_hits(df: DataFrame, key: str, text: str, names: DataFrame, least: int = 2) -> DataFrame:
    """Rows that hold two or more listed names or lone acronyms.

    A case-flexed letter such as ``[Ss]`` counts as its lower case. An acronym
    is lone if its row has no lowercase twin. ``names`` has one column, ``word``.
    Words are made distinct in their row, so only rows' own words travel.
    """
    flat = F.regexp_replace(text, r"\[([A-Za-z])([A-Za-z])\]", "$2")
    tokens = F.filter(F.array_distinct(F.split(flat, "[^A-Za-z]+")), lambda t: F.length(t) > 1)
    rows = df.select(key, tokens.alias("tokens"))
    # A lone acronym is written in capitals only, so its word is not among the others.
    others = F.transform(F.filter("tokens", lambda t: t != F.upper(t)), lambda t: F.lower(t))
    calendar = F.array(*map(F.lit, CALENDAR_WORDS))
    acronyms = F.array_except(F.array_except(F.transform("tokens", lambda t: F.lower(t)), others), calendar)
    words = F.concat(
        F.transform(acronyms, lambda w: F.struct(w.alias("word"), F.lit(True).alias("lone"))),
        F.transform(F.array_except(others, calendar), lambda w: F.struct(w.alias("word"), F.lit(False).alias("lone"))),
    )
    listed = names.select(F.lower("word").alias("word")).distinct().withColumn("listed", F.lit(True))
    split = rows.select(key, F.explode_outer(words).alias("w")).select(key, "w.*")
    found = split.join(listed, "word", "left").where(F.col("lone") | F.col("listed"))
    return found.groupBy(key).agg(F.count("*").alias("names")).where(F.col("names") >= least)


# The fields of a pack and of its parts.
PACK_FIELDS = ("schema_version", "rules_version", "tiers", "citation_suppression", "rules")
RULE_FIELDS = ("id", "name", "description", "pit_tier", "domain", "severity", "principle", "indicators", "min_matches",
               "suppress_if_cited", "flags")
TIER_FIELDS = ("name", "alias", "description")
CITATION_FIELDS = ("window", "flags", "patterns")
VERSION = r"\A[0-9]+\.[0-9]+\.[0-9]+((a|b|rc)[0-9]+)?\z"


# The JSON type of each field, as a Variant names it.
TEXT, WHOLE, FLAG, TEXTS, LISTED, OBJECT = "STRING", "BIGINT", "BOOLEAN", "ARRAY<(STRING|VOID)>", "ARRAY<.*>", "OBJECT<.*>"
PACK_TYPES = {"schema_version": TEXT, "rules_version": TEXT, "tiers": OBJECT, "citation_suppression": OBJECT, "rules": LISTED}
RULE_TYPES = {"id": TEXT, "name": TEXT, "description": TEXT, "pit_tier": WHOLE, "domain": TEXT, "severity": TEXT,
              "principle": TEXT, "indicators": TEXTS, "min_matches": WHOLE, "suppress_if_cited": FLAG, "flags": TEXT}
TIER_TYPES = {field: TEXT for field in TIER_FIELDS}
CITATION_TYPES = {"window": WHOLE, "flags": TEXT, "patterns": TEXTS}
TYPE_NAMES = {TEXT: "a string", WHOLE: "a whole number", FLAG: "true or false", TEXTS: "a list of strings", LISTED: "a list", OBJECT: "an object"}


def type_problems(packs: DataFrame, key: str, column: str = "json") -> DataFrame:
    """Fields of packs, held as JSON text, whose value is of another JSON type: ``(key, problem)``.

    Types are those of the parsed values, so 1.0 and "1" are no whole numbers and null is of no type. Fields that are
    missing and texts that are no JSON are for ``validate_packs``.
    """
    # A column of its own, so that each pack is parsed once and not for every field.
    packs = packs.select(key, F.try_parse_json(F.col(column)).alias("whole"))
    whole = F.col("whole")

    def wrong(body: Column, types: dict[str, str], place: Column) -> Column:
        """What an object's fields have for a wrong type."""

        def tests(found: Column) -> Column:
            out = []
            for name, kind in types.items():
                kind_of = F.schema_of_variant(F.try_element_at(found, F.lit(name)))
                out.append(F.when(~kind_of.rlike(rf"\A(?:{kind})\z"), F.concat(place, F.lit(f": {name} is not {TYPE_NAMES[kind]}"))))
            return F.array_compact(F.array(*out))

        return let(F.try_variant_get(body, "$", "map<string,variant>"), tests)

    def part(path: str) -> Column:
        return F.try_variant_get(whole, path, "variant")

    rules = F.try_variant_get(whole, "$.rules", "array<variant>")
    none = F.array().cast("array<string>")
    each = F.transform(rules, lambda r, n: wrong(r, RULE_TYPES, F.concat(F.lit("rule "), n.cast("string"))))
    problems = F.concat(
        wrong(whole, PACK_TYPES, F.lit("pack")),
        *(F.coalesce(wrong(part(f"$.tiers['{t}']"), TIER_TYPES, F.lit(f"tier {t}")), none) for t in TIERS),
        F.coalesce(wrong(part("$.citation_suppression"), CITATION_TYPES, F.lit("citation_suppression")), none),
        F.coalesce(F.flatten(each), none),
    )
    rows = packs.select(key, F.explode_outer(problems).alias("problem"))
    return rows.where("problem is not null")


def validate_packs(packs: DataFrame, key: str, column: str = "json") -> DataFrame:
    """Problems of whole packs, held as JSON text: fields, version, tiers and the citation block.

    ``validate_pack`` looks at the rules' values.
    """
    def part(path: str) -> Column:
        return F.get_json_object(column, path)

    def fields(body: Column, known: tuple[str, ...], where: Column | str) -> Column:
        """What an object has too much and too little."""
        place = F.lit(where) if isinstance(where, str) else where
        names, wanted = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")), F.array(*map(F.lit, known))
        extra = F.transform(F.array_except(names, wanted), lambda n: F.concat(place, F.lit(": unknown field "), n))
        missing = F.transform(F.array_except(wanted, names), lambda n: F.concat(place, F.lit(": no field "), n))
        return F.concat(extra, missing)

    rules = F.from_json(part("$.rules"), "array<string>")
    tests = (
        (part("$.schema_version") != "1", "schema_version is not 1"),
        (~part("$.rules_version").rlike(VERSION), "rules_version has another shape"),
        (part("$.citation_suppression.window").cast("int") < 0, "the citation window is below 0"),
        (~part("$.citation_suppression.flags").isin(*FLAGS), "the citation flags are unknown"),
        (F.size(F.from_json(part("$.citation_suppression.patterns"), "array<string>")) < 1, "no citation pattern"),
        (F.size(rules) < 1, "no rule"),
    )
    found = F.concat(
        fields(F.col(column), PACK_FIELDS, "pack"),
        fields(part("$.tiers"), tuple(map(str, TIERS)), "tiers"),
        *(fields(part(f"$.tiers.{t}"), TIER_FIELDS, f"tier {t}") for t in TIERS),
        fields(part("$.citation_suppression"), CITATION_FIELDS, "citation_suppression"),
        F.flatten(F.coalesce(F.transform(rules, lambda r, n: fields(r, RULE_FIELDS, F.concat(F.lit("rule "), n.cast("string")))), F.array().cast("array<array<string>>"))),
        F.filter(F.array(*(F.when(test, label) for test, label in tests)), lambda p: p.isNotNull()),
    )
    broken = F.json_object_keys(column).isNull()
    problems = F.when(broken, F.array(F.lit("not a JSON object"))).otherwise(found)
    rows = packs.select(key, F.explode_outer(problems).alias("problem"))
    return rows.where(F.col("problem").isNotNull())

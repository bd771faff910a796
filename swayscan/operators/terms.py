"""Lists of terms and names, looked up in many texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayscan.functions.regex import WORD, form_finder
from swayscan.functions.spans import collect_fold
from swayscan.functions.text import MARK, matchable

# Prefixes that make another form of a listed word.
LISTED_PREFIXES = ("anti", "neo", "ultra", "pro", "crypto", "post", "pseudo", "far", "paleo")
# Endings of words without a plural.
NO_PLURAL = ("ism", "ity", "ology", "ury", "ish", "ese", "ch", "ia", "ics", ".")
# Plural by ending, the first that fits: (ending, letters cut off, letters added); no letters added means no plural.
PLURALS = (*((ending.replace(".", "[.]"), 0, "") for ending in NO_PLURAL), ("[sx]|sh", 0, "es"), ("(?:^|[^aeiou])y", 1, "ies"), ("", 0, "s"))
FORMS_IN_PLAN = 20_000
"""Forms that patterns of the plan may hold; a longer list is joined."""
FORMS_IN_PATTERN = 2_000


def listed_forms(
    terms: DataFrame, plurals: tuple[tuple[str, int, str], ...] = PLURALS, prefixes: tuple[str, ...] = LISTED_PREFIXES
) -> DataFrame:
    """Every form of each listed term, ``(term, form)``, in lower case with parts joined by spaces.

    ``plurals`` is read from the top: the first ending a word has gives its plural. Each form of a single word also
    stands behind every prefix; terms of several parts and abbreviations have no prefixed form.
    """
    word = F.lower(F.translate("term", "-", " "))
    rows = F.array(*(F.struct(F.lit(f"(?:{e})$").alias("ending"), F.lit(cut).alias("cut"), F.lit(add).alias("add")) for e, cut, add in plurals))
    fitting = F.get(F.filter(rows, lambda r: F.regexp_like(word, r["ending"])), F.lit(0))
    plural = F.when(fitting["add"] != "", F.concat(F.left(word, F.length(word) - fitting["cut"]), fitting["add"]))
    forms = F.array_compact(F.array(word, plural))
    heads = F.when(word.rlike("[ .]"), F.array(F.lit(""))).otherwise(F.array(F.lit(""), *map(F.lit, prefixes)))
    every = F.flatten(F.transform(heads, lambda head: F.transform(forms, lambda form: F.concat(head, form))))
    return terms.select("term", F.explode(every).alias("form")).distinct()


def _plain(text: str) -> Column:
    return F.translate(F.lower(text), "-", " ")


def _begins(longer: str, form: str) -> bool:
    """Does a text that holds the longer form hold the other at the same place?"""
    rest = longer[len(form) :]
    return longer.startswith(form) and (not rest or form.endswith(".") or not rest[0].isalpha())


def _found_by_pattern(df: DataFrame, key: str, text: str, forms: list[tuple[str, str]]) -> DataFrame:
    """One tree-shaped pattern per part of the list: what leaves a row are its hits."""
    terms: dict[str, list[str]] = {}
    for term, form in forms:
        terms.setdefault(form, []).append(term)
    listed = sorted(terms)
    parts = [listed[at : at + FORMS_IN_PATTERN] for at in range(0, len(listed), FORMS_IN_PATTERN)]
    rows = []
    for number, part in enumerate(parts):
        own = set(part)
        for hit in part:
            # the longest form at a place hides those that it begins with
            held = [hit[:size] for size in range(1, len(hit) + 1) if hit[:size] in own and _begins(hit, hit[:size])]
            rows += [(number, hit, term, form) for form in held for term in terms[form]]
    closure = df.sparkSession.createDataFrame(rows, "part int, hit string, term string, form string")
    hits = (F.array_distinct(F.regexp_extract_all(_plain(text), F.lit(form_finder(part)), 1)) for part in parts)
    tagged = F.flatten(F.array(*(F.transform(h, _tagged(number)) for number, h in enumerate(hits))))
    each = df.select(key, F.explode_outer(tagged).alias("h")).where("h is not null").select(key, "h.part", "h.hit")
    return each.join(closure, ["part", "hit"]).select(key, "term", "form").distinct()


def _tagged(number: int):
    return lambda hit: F.struct(F.lit(number).alias("part"), hit.alias("hit"))


def _found_by_postings(df: DataFrame, key: str, text: str, forms: DataFrame) -> DataFrame:
    """Words of texts meet the first words of forms; forms of more than a word are then looked for in the texts they may be in."""
    first = F.regexp_extract("form", r"^(\p{L}+)", 1)
    postings = forms.select(first.alias("word"), "term", "form", (first == F.col("form")).alias("whole"))
    words = df.select(key, F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1))).alias("word"))
    met = words.join(postings, "word")
    single = met.where("whole").select(key, "term", "form")
    wanted = met.where("not whole").groupBy(key).agg(F.collect_set(F.struct("term", "form")).alias("wanted"))
    quoted = lambda form: F.regexp_replace(form, r"([.^$*+?()\[\]{}\\|])", r"\\$1")

    def held(w):
        end = F.when(w["form"].endswith("."), "").otherwise(r"(?!\p{L})")
        return F.regexp_like(_plain(text), F.concat(F.lit(r"(?<!\p{L})"), quoted(w["form"]), end))

    several = df.join(wanted, key).select(key, F.explode_outer(F.filter("wanted", held)).alias("w")).where("w is not null")
    return single.unionByName(several.select(key, "w.term", "w.form")).distinct()


def denylist_terms(df: DataFrame, key: str, text: str, terms: DataFrame, exempt: DataFrame) -> DataFrame:
    """Listed terms, in any form, that texts hold: ``(key, term, form)``; exempt ``(key, term)`` pairs aside.

    A form is found where letters neither go before nor on; one space or hyphen joins its parts. Lists of up to
    FORMS_IN_PLAN forms become patterns, and only hits leave their row; longer lists meet the texts' words in a join.
    """
    forms = listed_forms(terms)
    listed = [tuple(r) for r in forms.select("term", "form").limit(FORMS_IN_PLAN + 1).collect()]
    by_pattern = len(listed) <= FORMS_IN_PLAN
    found = _found_by_pattern(df, key, text, listed) if by_pattern and listed else _found_by_postings(df, key, text, forms)
    return found.join(exempt, [key, "term"], "left_anti")


# --- names --------------------------------------------------------------------

_RUN = rf"([{WORD}]+)"


def rename_entities(df: DataFrame, key: str, text: str, names: DataFrame, add: str = "renamed") -> DataFrame:
    """Swap whole names in a text for others: ``(key, add)``; ``key`` is unique.

    ``names`` has ``name`` and ``other`` and may be of any length; a phrase to protect is a name that stands for itself.
    Names are taken from left to right, the longest at each place, in one pass. A name that begins or ends with a
    letter, digit or underscore must not go on as a word there. Of a name listed twice the least ``other`` counts; a
    name without a letter or digit is never found. A null text stays null.

    Runs of words of texts meet the names' own words in a join, so that no list is part of the plan; each text then
    looks for the few names whose words it holds.
    """
    words = F.regexp_extract_all("name", F.lit(_RUN), 1)
    listed = names.groupBy("name").agg(F.min("other").alias("other")).where(F.size(words) > 0)
    listed = listed.select("name", "other", F.array_join(words, " ").alias("run"), F.size(words).alias("n"))
    sizes = [r["n"] for r in listed.select("n").distinct().collect()]
    held = F.regexp_extract_all(text, F.lit(_RUN), 1)

    def runs(size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
        every = F.array_distinct(F.transform(places, lambda at: F.array_join(F.slice("w", at, F.lit(size)), " ")))
        return F.when(F.size("w") >= size, every).otherwise(F.array().cast("array<string>"))

    texts = df.select(key, held.alias("w"))
    grams = texts.select(key, F.explode_outer(F.array_distinct(F.concat(*map(runs, sizes)))).alias("run")) if sizes else None
    if grams is None:
        return df.select(key, F.col(text).alias(add))
    found = grams.join(listed, "run").groupBy(key).agg(F.collect_list(F.struct("name", "other")).alias("_names"))
    return df.select(key, F.col(text).alias("_text")).join(found, key, "left").select(key, _swapped().alias(add))


def _swapped() -> Column:
    """``_text`` with the names of ``_names`` swapped."""

    def shape(n):
        quoted = F.regexp_replace(matchable(n["name"]), r"([.^$*+?()\[\]{}\\|#&~\-\s])", r"\\$1")
        before = F.when(n["name"].rlike(rf"^[{WORD}]"), rf"(?<![{WORD}])").otherwise("")
        behind = F.when(n["name"].rlike(rf"[{WORD}]$"), rf"(?![{WORD}])").otherwise("")
        return F.struct((-F.length(n["name"])).alias("size"), F.concat(before, quoted, behind).alias("shape"))

    longest_first = F.transform(F.array_sort(F.transform("_names", shape)), lambda s: s["shape"])
    pattern = F.concat(F.lit("(?s)(?:"), F.array_join(longest_first, "|"), F.lit(")"))
    pieces = F.split(F.regexp_replace(matchable(F.col("_text")), pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    others = F.map_from_entries(F.transform("_names", lambda n: F.struct(n["name"], n["other"])))

    def step(state, piece):
        own = F.substring(F.col("_text"), state["at"] + 1, F.length(piece))  # matching used stand-ins
        after = F.struct((state["at"] + F.length(piece)).alias("at"), (~state["odd"]).alias("odd"))
        return after, F.when(state["odd"], F.coalesce(F.element_at(others, own), own)).otherwise(own)

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"))
    return F.when(F.col("_names").isNull(), F.col("_text")).otherwise(F.array_join(collect_fold(pieces, start, step, "string"), ""))

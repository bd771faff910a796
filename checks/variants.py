"""Pack variants and fixed lists that the checks use, shared with their SQL."""

from __future__ import annotations

import copy

from swayscan.sources.pack import RulePack, bundled_pack

PACK = bundled_pack()


def _earlier() -> RulePack:
    """An earlier pack: fewer patterns, narrower wording, another threshold."""
    content = copy.deepcopy(PACK.content)
    for rule in content["rules"]:
        if rule["id"] in ("CONSENSUS_AS_EVIDENCE", "SHAME_LEVER", "CLAIM_WITHOUT_CITATION"):
            rule["indicators"] = rule["indicators"][1:]
        if rule["id"] == "MONOCAUSAL_BLAME":
            rule["indicators"][2] = r"\b(?i:the\s+only\s+reason\s+for\s+the)\b"
        if rule["id"] == "MEDIA_ASYMMETRIC_ATTRIBUTION":
            rule["min_matches"] = 1
        if rule["id"] == "FALSE_BINARY":
            rule["indicators"][0] = r"\b(?i:either)\s+(?i:we)\b"
    content["rules_version"] = "0.9.0"
    return RulePack(content)


def _loose() -> RulePack:
    """Every raw span counts: no threshold and no citation check."""
    content = copy.deepcopy(PACK.content)
    for rule in content["rules"]:
        rule.update(min_matches=1, suppress_if_cited=False)
    return RulePack(content)


EARLIER = _earlier()
LOOSE = _loose()

SLOT_CASES = [
    ("MONOCAUSAL_BLAME", "The weir is dry because of {name} nothing else.", 16),
    ("CONSENSUS_AS_EVIDENCE", "On the quay all {name} accept the tide marks.", 16),
    ("CONSENSUS_AS_EVIDENCE", "By noon every {name} accepts the tide marks.", 4),
    ("FALSE_BINARY", "We dredge either {name} or the sandbank grows.", 32),
    ("VAGUE_INSTITUTIONAL_APPEAL", "On the quay, prominent {name} chandlers urge a new winch.", 8),
]
SLOT_PACK = PACK.only({rule for rule, _, _ in SLOT_CASES})

TEMPLATES = [
    "{X} wrote that nobody doubts the tide tables.",
    "{X} painted the sign, and experts recommend a second coat.",
    "The nets are empty because of {x} and nothing was landed.",
    "By custom every legendary {b} crew has a tar pot.",
    "At low tide most {b} divers concur about the wreck.",
    "Under the bridge the {b} consensus was that it leaks.",
    "Nobody asked why the disgraced {b} pilot sang.",
    "{X} met the council on Tuesday.",
]
ORG_TEMPLATES = [
    "In its minutes the {b} has determined that the winch holds.",
    "A {b}-schooled rigger warns against the old winch.",
]

NAMES = {"harbor board": "quay board", "harbor": "haven", "ferry": "barge", "mill": "forge", "Ostmere": "Westmere"}
KEEP = ("Ostmere History",)
EXCLUDED = [("src3", "machine text"), ("src7", "withdrawn"), ("src99", "never there")]
LISTED_NAMES = ["Ostmere", "Ferrin", "Dallow", "Orrin", "Pell", "Marl", "Lantern", "Granite", "March", "Works"]
LISTED_TERMS = ["idler", "meddler", "grumbler", "boatman", "lock keeper", "harbor pilot", "shill", "levy", "class",
                "harbor pilot boat", "capt."]
EXEMPT_TERM = "levy"
URL_SKIP = r"\$\{|<|\{\{|quay\.example"

"""The bundled rule pack, written as data.

Patterns use the common subset of Python-style regex: bounded quantifiers,
``\\b``, ``\\w``, ``\\d``, ``\\s``, scoped ``(?i:...)``, and only two
look-behinds, both leading: ``NOT_AFTER_WORD`` and ``FROM_200``.

``python -m swayscan.rules.catalog`` rewrites ``pack.json`` from this module.
"""

from __future__ import annotations

import json
from pathlib import Path

# --- shared building blocks -------------------------------------------------
_NAME_CHARS = r"[^\s,:;.!?\"“”()\[\]{}]+"
# Titles, short forms of bodies and of places, which take a period inside a name.
_TITLES = "dr mr mrs ms st mt ft jr sr rep sen gov rev msgr prof gen col lt hon bro sis dcn rab dem smt univ inst dept assn theol sem ph.d"
_PLACES = "Calif Colo Conn Fla Ga Ill Ind Mass Mich Minn Miss Okla Penn Tenn Tex Va Wash Wis"
_ABBREV = rf"(?:(?i:{'|'.join(t.replace('.', '[.]') for t in _TITLES.split())})|{'|'.join(_PLACES.split())})\.|(?:[A-Za-zÀ-ÖØ-öø-ž]\.){{1,8}}"
_ASIDE = r"\([^()\s]+(?:\s[^()\s]+)?\)(?:['’]s)?"
NAME = rf"(?:{_NAME_CHARS}(?:[.!?:]{_NAME_CHARS})*|{_ABBREV}|{_ASIDE})"
"""One name token: punctuation may sit inside it but does not end it; a short aside in parentheses is one, too."""


def slot(most: int, least: int = 0) -> str:
    """``least`` to ``most`` name tokens, each followed by white space."""
    return rf"(?:{NAME}\s+){{{least},{most}}}"


def listing(most: int, least: int = 0) -> str:
    """A slot whose capitalized words may be listed with commas."""
    return rf"(?:(?:{NAME}|[A-Z][\w'’-]*,)\s+){{{least},{most}}}"


SLOT = slot(16)
GAP = slot(16)
MODIFIERS = slot(8)
_LEAD_TITLES = r"\b(?i:dr|mr|mrs|ms|rep|sen|gov|rev|msgr|prof|gen|col|capt|lt|hon|bro|sis|dcn|rab|dem)"
SENTENCE_TEXT = rf"[^.!?]*?(?:(?:[.!?][^\s.!?]|{_LEAD_TITLES}\.\s)[^.!?]*?){{0,200}}?"
NOT_AFTER_WORD = r"(?<!\w\s)"
"""A capitalized trigger right after another word is the end of a name."""
FROM_200 = r"(?<=.{200})"
"""The match starts at least 200 characters into the text."""

TIERS = {
    "1": {
        "name": "Evidence moves",
        "alias": "knowledge",
        "description": "The wording stands where evidence would stand.",
    },
    "2": {
        "name": "Pressure moves",
        "alias": "feeling",
        "description": "The wording presses on feeling, belonging or time.",
    },
    "3": {
        "name": "Standing moves",
        "alias": "authority",
        "description": "The wording leans on rank, office or process.",
    },
}

# Citation shapes; the ignore-case flag applies to all of them.
CITATION_WINDOW = 120
CITATIONS = [
    r"\b(?:id|ibid)\.",
    r"\b(?:supra|infra)(?:,|\s+note\b|\s+at\b|\s+n\.|\s+\d)",
    r"\b(?:Nat['’]l|Fed\.|Dep['’]t|Comm['’]n|Inst\.|Ass['’]n|Gov['’]t)\s+(?:[\w.'’]+\s+){0,2}\d",
    r"\((?:[\w.'’&-]+\s+){1,4}(?:1[5-9]|20)\d\d[a-z]?\)",
    r"\([^()\d]{1,400}(?:\([^()]{1,60}\)[^()\d]{0,60})?,\s*(?:1[5-9]|20)\d\d[a-z]?\)",
    r"\b(?:table|figure|appendix|exhibit)\s+(?:\d+|[a-z])\b",
    r"\bp(?:p\.|\.|\s)\s?\d+",
    r"\b[\w'’-]+\s+v\.\s+[\w'’-]+",
    r"\b[\w'’-]+\s+v\s+[\w'’-]+[.,;)]",
    r"\b\d{1,4}\s+(?:[a-z]{1,6}\.\s?){1,4}(?:\d[a-z]{1,2}\s+)?\d{1,5}\b",
    r"[(\[](?:1[5-9]|20)\d\d[)\]]\s+\d{1,3}\s+[a-z]{2,6}\s+\d{1,5}\b",
    r"\b(?:1[5-9]|20)\d\d\s+[a-z]{2,6}\s+\d{1,5}[.,;)]",
    r"\[\d{1,3}\]",
    r"\b(?:[1-3]\s)?[\w]{3,14}\s+\d{1,3}:\d{1,3}\b",
]

_SAY = r"(?:say|says|said|believe|believes|agree|agrees|think|thinks)"
_INDEPENDENT = r"(?:neutral|independent|impartial|unbiased|non-?partisan|bipartisan)"


def _rule(rule_id, tier, domain, indicators, *, case=False, least=1, cited=False,
          severity="moderate", principle="Truth"):
    return {
        "id": rule_id,
        "name": rule_id.split("_", 1)[1].replace("_", " ").capitalize()
        if domain != "general" else rule_id.replace("_", " ").capitalize(),
        "description": _DESCRIPTIONS[rule_id],
        "pit_tier": tier,
        "domain": domain,
        "severity": severity,
        "principle": principle,
        "indicators": indicators,
        "min_matches": least,
        "suppress_if_cited": cited,
        "flags": "s" if case else "is",
    }


_DESCRIPTIONS = {
    "CONSENSUS_AS_EVIDENCE": "Offers agreement in place of evidence.",
    "CLAIM_WITHOUT_CITATION": "Points to research or experts and names none.",
    "DISSENT_DISMISSAL": "Puts a label on people who disagree.",
    "FALSE_BINARY": "Leaves the reader two choices.",
    "FEAR_URGENCY": "Joins an alarm with a deadline.",
    "SHAME_LEVER": "Makes disagreement look foolish or shameful.",
    "EMOTIONAL_SUBSTITUTION": "Gives a feeling where a reason would stand.",
    "CREDENTIAL_AS_PREMISE": "Gives a title, prize or career as the reason.",
    "INSTITUTIONAL_POSITION_AS_SETTLED": "Reports that a body concluded something, without its reasons.",
    "NEUTRALITY_CLAIM": "Describes itself as neutral or objective.",
    "BUREAUCRATIC_OBSCURITY": "Covers the point with process wording.",
    "INEVITABILITY_FRAME": "Speaks of an outcome as already decided.",
    "APPEAL_TO_TRADITION": "Gives age or habit as the reason.",
    "FALSE_EQUIVALENCE": "Sets two positions on one level.",
    "MORAL_HIGH_GROUND": "Puts decency on one side of the question.",
    "SOFT_CONSENSUS": "Speaks of growing agreement without saying whose.",
    "COMPETENCE_DISMISSAL": "Answers a critic by doubting their grasp.",
    "VAGUE_INSTITUTIONAL_APPEAL": "Leans on groups it does not name.",
    "ASPIRATIONAL_DEFLECTION": "Answers with a statement of goals.",
    "DISMISSAL_BY_REFRAMING": "Says what the other side is really saying.",
    "CAUSAL_TOTALIZATION": "Credits one force with ruin.",
    "MONOCAUSAL_BLAME": "Gives one cause for all of it.",
    "TOTALIZING_HARM_LANGUAGE": "Describes harm as total.",
    "LEGAL_SETTLED_DISMISSAL": "Calls the question settled.",
    "LEGAL_MERIT_DISMISSAL": "Calls an argument meritless.",
    "LEGAL_WEIGHT_STACKING": "Counts authorities instead of reasoning from them.",
    "LEGAL_SANCTIONS_THREAT": "Raises sanctions in answer to an argument.",
    "LEGAL_PROCEDURAL_GATEKEEPING": "Answers with a procedural bar.",
    "LEGAL_STRAW_MAN": "Restates the other side in absolute terms.",
    "MEDIA_EDITORIAL_AS_NEWS": "Uses a judging adjective in a news description.",
    "MEDIA_ANONYMOUS_ATTRIBUTION": "Credits a claim to nobody a reader can check.",
    "MEDIA_WEASEL_QUANTIFIERS": "Says that many or some believe it.",
    "MEDIA_FALSE_BALANCE": "Sets some voices against most as an even split.",
    "MEDIA_EMOTIONAL_LEAD": "Opens on a charged word.",
    "MEDIA_BURIED_QUALIFIER": "Puts the correction far down the text.",
    "MEDIA_SELECTIVE_QUOTATION": "Puts doubt-casting quotation marks around words.",
    "MEDIA_ASYMMETRIC_ATTRIBUTION": "Uses loaded verbs for speech.",
    "MEDIA_SPECULATIVE_FRAMING": "Presents a guess as the expected outcome.",
    "FIN_SURVIVORSHIP_BIAS": "Draws a lesson from the winners.",
    "FIN_ANCHORING": "Measures a price against a chosen level.",
    "FIN_CHERRY_PICKED_TIMEFRAME": "Measures a result from a chosen date.",
    "FIN_PROJECTION_AS_FACT": "States a forecast as certain.",
    "FIN_RECENCY_EXTRAPOLATION": "Extends a recent run.",
}

_GROUP_VERB = (
    r"(?i:agree|support|supports|think|concur|believe|accept|endorse|recognize|say\s+so"
    r"|have\s+concluded|have\s+agreed)"
)


_VOUCHES = r"(?i:says|insists|knows|warns|agrees|argues|believes|confirms|explains|maintains)"
# Words that label people when they stand in a frame for labels.
_LABELS = (
    r"(?i:bosses|queens|hustlers|mongers|radicals|bots|heretics|yuppies|punks|goons|thugs|slickers|fogeys|harpies|censors|trolls|nuts|jackboots"
    r"|puppets|parrots|sellouts|busybodies|[\w]+-maskers|elitists|sheep|bullies)"
)
_STANDING = r"(?:renowned|respected|distinguished|eminent|tenured|ordained|licensed|acclaimed|leading|registered|chartered|celebrated|award-winning)"
# What one force is said to ruin: a whole, anything of ours, an -ism, a name, or a plural that ends the clause.
_RUINED = (
    rf"(?:(?i:this|these|the|our|your|their|all|every)\s+{slot(4)}[\w'’-]+|(?i:[\w-]+ism|(?:equality|freedom|liberty|democracy|justice|marriage|education|security|trust)\b)"
    rf"|\d[\w'’-]*\s+{slot(4)}[\w'’-]+|[A-Z][\w'’-]*|[a-z]+[A-Z]\w*|(?:[\w'’-]+\s+){{0,2}}(?:[\w'’-]+s|security|family|clergy)[.,;!?])"
)


def build_rules() -> list[dict]:
    """The 43 rules in pack order."""
    return [
        # ---- general -------------------------------------------------------
        _rule("CONSENSUS_AS_EVIDENCE", 1, "general", [
            r"\b(?i:everyone|everybody|nobody)\s+(?i:knows|agrees|accepts|doubts)\b",
            rf"\b(?i:every)\s+{slot(4, 1)}(?i:knows|agrees|accepts)\b",
            rf"\b(?:all|most)\s+{slot(16, 1)}{_GROUP_VERB}\b",
            rf"{NOT_AFTER_WORD}\b(?:All|Most)\s+{slot(16, 1)}{_GROUP_VERB}\b",
            rf"\b(?i:the)\s+{SLOT}(?:consensus|CONSENSUS|Consensus)\s+(?i:is|was|says|holds|shows|among|on|that)\b",
            r"\b(?i:overwhelmingly|unanimously|universally)\s+(?i:agree|agrees|agreed|accept|support)\b",
        ], case=True, severity="high"),
        _rule("CLAIM_WITHOUT_CITATION", 1, "general", [
            rf"{NOT_AFTER_WORD}\b(?:Studies|STUDIES|Research|RESEARCH|Science|Data|Evidence|Scripture|Tradition|Doctrine)\s+(?i:show|shows|prove|proves|suggest|suggests|tell|tells|teaches|have\s+shown|has\s+shown|confirm|confirms)\b",
            r"\b(?:studies|research|science|data|evidence|scripture|tradition|wisdom|doctrine)\s+(?i:show|shows|prove|proves|suggest|suggests|tell|tells|teaches|have\s+shown|has\s+shown|confirm|confirms)\b",
            r"\b(?i:experts)\s+(?i:say|agree|believe|warn|recommend)\b",
            rf"\b(?i:an?\s+(?:study|report|survey)|studies|research|experts)\s+(?i:by|from|at)\s+{listing(16, 1)}(?i:shows|show|says|say|found|finds|suggests|suggest)\b",
            r"\b(?i:an?\s+(?:study|survey)\s+(?:shows|finds|found|proves|suggests|confirms))\b",
        ], case=True, cited=True, severity="high"),
        _rule("DISSENT_DISMISSAL", 1, "general", [
            r"\b(?i:(?:is|are|was|were|spread|spreads|spreading|peddl(?:e|es|ing)|pushing|just|pure|your|their)\s+(?:misinformation|disinformation|propaganda|talking\s+points))\b",
            r"\b(?i:propagandists?|big\s+lie|ideologues?|fanatics?|zealots?|extremists?|heretics?|bootlickers?|agitators?|freeloaders?|moochers?|useful\s+idiots?|pearl-clutchers?|killjoys?|(?:trans|homo)phobes?|[\w]+-(?:thumpers?|haters?|botherers?|bashers?)|book[\s-](?:banners?|burners?)|(?:woke|angry|online)\s+mob)\b",
            rf"\b(?i:(?:they(?:'|’)re|they\s+are)\s+(?:just|all|only|nothing\s+but)|an?\s+(?:bunch|gang|pack)\s+of|those|these)\s+{slot(2)}{_LABELS}\b",
            rf"\b(?i:(?:is|was)\s+an?)\s+(?i:radical|bot|troll|goon|crank)[.!,;]",
            r"\b(?i:(?:mob|crowd|trolls|propagandists)\s+(?:is|are|were|won)\s+(?:(?:at\s+it|out)\s+)?again)\b",
            rf"\b(?i:of\s+course)\s+(?:(?i:they|he|she)|(?i:the|those|these|our|your)\s+{slot(5)}{NAME})\s+(?i:would\s+(?:say|claim)\s+(?:that|this|so)[.!,;]|wants?\s+you\s+to\s+(?:think|believe))",
            rf"\b(?i:what)\s+(?:(?i:they|he|she)|(?i:the|those|these)\s+{slot(5)}{NAME})\s+(?i:wants?\s+you\s+to\s+(?:think|believe))[.!,;]",
            rf"\b(?i:no\s+(?:serious|real|true|honest))\s+{slot(2, 1)}(?i:believes?|thinks?|accepts?|doubts?)\b",
            rf"\b(?i:only)\s+{slot(3)}{_NAME_CHARS}s\s+(?i:would\s+(?:say|claim|buy))\b",
            r"\b(?i:(?:do\s+not|don(?:'|’)?t|never)\s+listen\s+to|pay\s+no\s+(?:mind|heed|attention)\s+to)\s+(?i:the|those|these)\b",
            r"\b(?i:fake\s+news|conspiracy\s+theorists?|sheeple|alarmists?|deniers?|debunked|hoax|cranks?|shills?|truthers?|deplorables|doomers|naysayers?|crackpots?|quacks?|doomsayers?|fearmongers?|scaremongers?|lackeys|stooges?|conspiracy\s+theory)\b",
            rf"\b(?i:only\s+an?)\s+{slot(4, 1)}(?i:would\s+(?:say|buy|claim))\b",
            rf"\bTypical\s+{slot(5)}{_NAME_CHARS}!",
            rf"\b(?i:ignore)\s+(?i:the|those|these)\s+(?:{slot(3, 1)}{_NAME_CHARS}s|noise|crowd|mob|critics|skeptics|experts)[.!]",
            rf"\b(?i:ignore)\s+(?i:the)\s+(?:[A-Z][\w'’-]*\s+)(?:(?:[A-Z][\w'’-]*|for|of|and|the)\s+){{0,10}}[A-Z][\w'’-]*[.!]",
            r"\b(?i:so-called)\s+(?i:experts?|critics?|skeptics?|scholars?)\b",
        ], case=True, severity="high", principle="Justice"),
        _rule("FALSE_BINARY", 2, "general", [
            rf"\b(?i:either)\s+{slot(32, 1)}(?i:or)\b",
            r"\b(?i:if\s+you(?:'|’)?\s?a?re\s+not\s+with\s+us)\b",
            r"\b(?i:there\s+(?:is|are)\s+only\s+(?:two|one)\s+(?:choices?|options?|ways?|paths?))\b",
        ], case=True),
        _rule("FEAR_URGENCY", 2, "general", [
            r"\b(?i:act\s+now|now\s+or\s+never|before\s+it(?:'|’)?s\s+too\s+late|running\s+out\s+of\s+time)\b",
            r"\b(?i:must\s+be\s+stopped\s+(?:now|today|at\s+once))\b",
            r"\b(?:catastroph(?:e|ic)|CATASTROPHE|Catastrophic)\b",
            r"\b(?i:existential\s+threat|irreversible\s+(?:harm|damage)|point\s+of\s+no\s+return)\b",
            rf"\b(?:this\s+is|facing|is)\s+(?:an?|the)\s+{slot(3)}(?:invasion|INVASION|coup|genocide)[.,!]",
        ], case=True, severity="high", principle="Agency"),
        _rule("SHAME_LEVER", 2, "general", [
            r"\b(?i:any|every)\s+(?i:reasonable|sensible|thinking|decent)\s+(?:[\w'’-]+\s+){0,2}(?i:person|citizen|adult|man|woman|human|voter|reader|parent|worker|observer|neighbor|taxpayer|viewer|mind)\s+(?i:can|could|would|knows|sees|understands)\b",
            r"\b(?i:any|every)\s+(?i:reasonable|sensible|thinking|decent)\s+(?:[A-Z][\w'’-]*\s+){1,3}(?i:can|could|would|knows|sees|understands)\b",
            r"\b(?i:only\s+a\s+fool|(?:should|ought\s+to)\s+be\s+ashamed|shame\s+on|how\s+dare\s+(?:you|they|he|she))\b",
            r"\bhistory\s+(?i:will|shall)\s+(?i:judge|remember|condemn)\b",
            rf"{NOT_AFTER_WORD}\bHistory\s+(?i:will|shall)\s+(?i:judge|remember|condemn)\b",
            rf"\b(?i:all\s+educated)\s+{slot(3, 1)}(?i:know|agree|understand)\b",
        ], case=True, principle="Agency"),
        _rule("EMOTIONAL_SUBSTITUTION", 2, "general", [
            r"\b(?:heart-?breaking|heart-?wrenching|gut-?wrenching)\b",
            r"\bthink\s+of\s+the\s+(?:children|babies|kids|unborn|families)\b",
            r"\bno\s+(?:decent|moral|caring|feeling)\s+[\w'’-]+\s+(?:(?:being|person|soul|citizen)\s+)?(?:could|would|can)\b",
        ], principle="Clarity"),
        _rule("CREDENTIAL_AS_PREMISE", 3, "general", [
            rf"\b[\w.'’-]+-(?i:educated|trained|schooled|taught|winning)\s+{slot(16, 1)}{_VOUCHES}\b",
            rf"\b(?:[Aa]n?|[Tt]he)\s+{_STANDING}\s+{listing(16, 1)}{_VOUCHES}\b",
            rf"{NOT_AFTER_WORD}\b(?:Renowned|Respected|Distinguished|Eminent|Acclaimed|Celebrated)\s+[a-z][\w'’-]*\s+{listing(16)}(?:{_VOUCHES}|(?i:say|insist|agree))\b",
            rf"{NOT_AFTER_WORD}\bAward-winning\s+{listing(16, 1)}{_VOUCHES}\b",
            rf"\b(?i:an?)\s+{slot(6, 1)}(?i:educated|trained|schooled)\s+{slot(6, 1)}{_VOUCHES}\b",
            rf"\b[A-Z][\w'’-]*\s+(?:winner|recipient|laureate|Laureate|Fellow|Scholar)\s+{SLOT}{_VOUCHES}\b",
            rf"\b(?i:an?)\s+{slot(6, 1)}(?i:winner|recipient|laureate)\s+{SLOT}{_VOUCHES}\b",
            rf"\b(?i:as\s+an?)\s+{listing(15)}{NAME},\s+(?i:i\s+(?:know|can\s+tell\s+you|can\s+assure\s+you)|(?:he|she|they|xe|ze)\s+knows?)\b",
            rf"\b(?i:as\s+an?\s+(?:leading|renowned|respected|eminent))\s+{slot(15)}{NAME},\s+{slot(8, 1)}(?i:opinion|word|view|judgment|verdict)\s+(?i:should|must|settles?)\b",
            r"\b(?i:with)\s+(?i:over\s+|more\s+than\s+)?[\w-]+\s+(?i:years\s+of\s+(?:experience|practice|service)),\s+(?i:i)\b",
            r"\b(?i:my\s+credentials\s+speak\s+for\s+themselves)\b",
        ], case=True),
        _rule("INSTITUTIONAL_POSITION_AS_SETTLED", 3, "general", [
            rf"\b(?i:the)\s+{slot(16, 1)}(?i:has|have)\s+(?i:concluded|confirmed|determined|established|found|made\s+clear)\s+(?i:that)\b",
            rf"\b[A-Z][\w.'’-]*\s+{SLOT}(?:has|have)\s+(?:concluded|confirmed|determined|established|found|made\s+clear)\s+that\b",
            rf"\b[\w.'’&-]+\s+(?:has|have)\s+(?:concluded|confirmed|determined|established)\s+that\b",
        ], case=True, cited=True),
        _rule("NEUTRALITY_CLAIM", 3, "general", [
            rf"\bas\s+an?\s+{_INDEPENDENT}\s+(?:[\w'’-]+\s+){{0,4}}[\w'’-]+,",
            r"\b(?:objectively|impartially|fairly)\s+and\s+without\s+bias\b",
            r"\breflects?\s+the\s+evidence\s+objectively\b",
            r"\brepresents?\s+the\s+objective\s+truth\b",
            r"\bspeaks?\s+with\s+one\s+clear\s+voice\b",
        ]),
        _rule("BUREAUCRATIC_OBSCURITY", 3, "general", [
            r"\bpursuant\s+to\s+the\s+(?:implementation|aforementioned|provisions|framework)\b",
            r"\bit\s+should\s+be\s+noted\s+that\b",
            r"\bthe\s+aforementioned\b",
            r"\bstakeholder\s+(?:engagement|alignment)\s+process(?:es)?\b",
        ], severity="low", principle="Clarity"),
        _rule("INEVITABILITY_FRAME", 1, "general", [
            rf"{NOT_AFTER_WORD}\b(?i:history|progress|time|tradition|the\s+future)\s+(?i:will\s+(?:show|prove|vindicate)|has\s+(?:shown|proved|proven)|is\s+on\s+our\s+side)\b",
            r"\b(?i:inevitable\s+(?:march|rise|decline|outcome|result))\b",
            r"\b(?i:(?:it\s+is|is)\s+only\s+a\s+matter\s+of\s+time)\b",
        ], case=True),
        _rule("APPEAL_TO_TRADITION", 1, "general", [
            r"\balways\s+(?:done|been\s+done|worked)\s+(?:it\s+)?(?:this|that)\s+way\b",
            r"\b(?:time-honou?red|long-?standing|age-old)\s+(?:practice|tradition|principle|approach|method|wisdom|custom|doctrine|teaching|scripture|law|belief|norm|convention|precedent|faith|rule)\b",
            r"\bfor\s+(?:generations|centuries),?\s+(?:we|people|our)\b",
        ], severity="low"),
        _rule("FALSE_EQUIVALENCE", 1, "general", [
            r"\bboth\s+sides\s+(?:have|make|raise)\s+(?:valid|good|fair|legitimate)\s+points\b",
            r"\bjust\s+as\s+(?:bad|guilty|wrong)\s+as\b",
            r"\bthere\s+are\s+two\s+sides\s+to\s+(?:every|this)\b",
        ]),
        _rule("MORAL_HIGH_GROUND", 2, "general", [
            r"\b(?:right|wrong|Right|Wrong|RIGHT|WRONG)\s+(?:side\s+of\s+history|SIDE\s+OF\s+HISTORY)\b",
            r"\b(?i:any|every|no)\s+(?i:decent|moral|good)\s+(?:[\w'’-]+\s+){1,3}(?i:would|could)\s+(?i:see|recognize|understand|support|deny)\b",
            r"\b(?i:any|every|no)\s+(?i:decent|moral|good|reasonable)\s+(?:[A-Z][\w'’-]*\s+){1,3}(?i:would|could)\s+(?i:see|agree|recognize|understand|support|deny)\b",
            r"\b(?i:basic\s+human\s+decency|moral\s+(?:duty|obligation|imperative))\b",
        ], case=True, principle="Justice"),
        _rule("SOFT_CONSENSUS", 1, "general", [
            r"\b(?i:(?:growing|emerging)\s+(?:body\s+of\s+(?:evidence|opinion|research)|consensus|agreement|recognition|number\s+of\s+(?:experts|scholars|studies|voices)))\b",
            rf"\b(?i:more\s+and\s+more)\s+{slot(16, 1)}(?i:agree|accept|believe|say|see)\b",
            rf"\b(?i:the\s+(?:vast|overwhelming|great)\s+majority\s+of)\s+{listing(16, 1)}(?i:agree|support|believe|say)\b",
            r"\b(?i:it\s+is\s+(?:widely|generally|broadly|increasingly)\s+(?:accepted|acknowledged|agreed|believed|known|recognized|understood))\b",
        ], case=True, cited=True, severity="low"),
        _rule("COMPETENCE_DISMISSAL", 2, "general", [
            rf"\b(?i:simply\s+(?:don(?:'|’)?t|do\s+not|cannot|can(?:'|’)?t)\s+(?:understand|grasp|comprehend))\s+(?i:the)\s+{SLOT}(?i:complexity|complexities|nuance|nuances|issue|economics)\b",
            rf"\b(?i:who)\s+{listing(16, 1)}(?i:fail\s+to\s+(?:grasp|understand|appreciate))\b",
            rf"\b(?i:opposes?|questions?|rejects?|criticizes?)\s+{slot(8, 1)}(?i:(?:but|and|yet)\s+(?:fails?\s+to\s+(?:grasp|understand|appreciate)|misunderstands?))\b",
            r"\b(?i:lack\s+the\s+(?:expertise|wisdom|training|faith|knowledge|experience)\s+to)\b",
        ], case=True, principle="Justice"),
        _rule("VAGUE_INSTITUTIONAL_APPEAL", 3, "general", [
            rf"\b(?:leading|top|key|major|prominent|influential|respected)\s+{MODIFIERS}{NAME}\s+(?i:advise|agree|back|believe|caution|endorse|favor|oppose|recommend|say|support|urge|warn)\b",
            rf"\b(?:[Rr]esponsible)\s+{slot(1)}{NAME}\s+(?i:agree|caution|recommend|urge|warn)\b",
            rf"{NOT_AFTER_WORD}\b(?:Key|Major)\s+[a-z][\w'’-]*\s+(?i:advise|caution|endorse|oppose|recommend|support|urge|warn)\b",
            rf"{NOT_AFTER_WORD}\b(?:Leading|Prominent|Influential)\s+{MODIFIERS}{NAME}\s+(?i:advise|agree|back|believe|caution|endorse|favor|oppose|recommend|say|support|urge|warn)\b",
            rf"{NOT_AFTER_WORD}\b(?:oil\s+|gas\s+|tech\s+|[\w-]{{4,30}}\s+)?(?i:leaders|groups|unions|companies|organizations|associations)\s+(?:warn|warned|caution|cautioned)\s+that\b",
            rf"\b[\w+#-]+\s+(?:leaders|groups|unions|companies|organizations|associations)\s+(?:have|has)\s+(?:long\s+|repeatedly\s+)?(?:backed|called\s+for|cautioned|endorsed|opposed|recommended|supported|urged|warned)\b",
            r"\b(?i:industry\s+(?:standards|best\s+practices)\s+(?:require|dictate|demand))\b",
        ], case=True, severity="low"),
        _rule("ASPIRATIONAL_DEFLECTION", 3, "general", [
            r"\bour\s+(?:goal|mission|aim|vision)\s+is\s+to\b",
            r"\bwe\s+(?:strive|aim|aspire|endeavou?r)\s+to\b",
            r"\bwe\s+(?:are|remain)\s+(?:deeply\s+|fully\s+)?committed\s+to\b",
        ], least=2, severity="low", principle="Clarity"),
        _rule("DISMISSAL_BY_REFRAMING", 2, "general", [
            r"\bwhat\s+(?:they|he|she|ze|zie|xe|ey|fae)(?:'|’|\s)(?:re|s|is|are)\s+really\s+(?:saying|asking|doing|after)\b",
            r"\bwhat\s+this\s+is\s+really\s+about\b",
        ], principle="Clarity"),
        _rule("CAUSAL_TOTALIZATION", 1, "general", [
            rf"\b(?i:is|are|was|were|be)\s+(?i:ruining|destroying|wrecking|killing|poisoning|gutting)\s+{_RUINED}",
            rf"\b(?i:has|have|will|would)\s+(?i:ruin|ruined|destroy|destroyed|wreck|wrecked|killed|poison|poisoned|gut|gutted)\s+{_RUINED}",
            r"\b(?i:destroyed|ruined|wrecked|gutted)\s+(?:(?i:our)\s+[\w'’-]+|(?i:the)\s+(?:[\w'’-]+\s+)?(?i:class|poor|rich|country|nation|economy|[\w'’-]+s)\b|[a-z][\w'’-]*\s+[\w'’-]+s[.,;!?])",
            r"\b(?i:(?:is|are)\s+the\s+(?:root\s+)?cause\s+of\s+(?:all|every))\b",
            r"\b(?i:to\s+blame\s+for\s+everything)\b",
        ], case=True, severity="high"),
        _rule("MONOCAUSAL_BLAME", 1, "general", [
            rf"\b(?i:because\s+of)\s+{slot(16, 1)}(?i:everything|nothing)\b",
            rf"\b(?i:it(?:'|’)?s\s+all)\s+{listing(16)}(?:{NAME}(?:'|’)s?|{_ASIDE})\s+(?i:fault)\b",
            rf"\b(?i:it(?:'|’)?s\s+all)\s+(?i:the)\s+{listing(16, 1)}{NAME}\s+{NAME}(?:'|’)s?\s+(?i:fault)\b",
            r"\b(?i:the\s+(?:only|sole|single)\s+(?:reason|cause|explanation))\b",
        ], case=True),
        _rule("TOTALIZING_HARM_LANGUAGE", 2, "general", [
            r"\b(?:completely|totally|utterly|entirely)\s+(?:destroyed|ruined|devastated|wrecked|obliterated)\b",
            r"\bdestroy(?:s|ed|ing)?\s+everything\b",
            r"\bnothing\s+(?:is|was)\s+left\b",
        ], cited=True, severity="high", principle="Clarity"),
        # ---- legal ---------------------------------------------------------
        _rule("LEGAL_SETTLED_DISMISSAL", 3, "legal", [
            r"\bwell[-\s]settled\s+(?:law|principle|rule|precedent)\b",
            r"\b(?:long|firmly|clearly)\s+(?:been\s+)?(?:settled|established)\s+(?:law|that)\b",
            r"\bit\s+is\s+(?:black[-\s]letter|hornbook)\s+law\b",
        ]),
        _rule("LEGAL_MERIT_DISMISSAL", 3, "legal", [
            r"\b(?:plainly|patently|wholly|utterly|clearly)\s+(?:meritless|frivolous|baseless|groundless)\b",
            r"\b(?:wholly|entirely|completely)\s+without\s+merit\b",
        ], principle="Justice"),
        _rule("LEGAL_WEIGHT_STACKING", 3, "legal", [
            r"\bthe\s+(?:overwhelming\s+|great\s+)?weight\s+of\s+(?:the\s+)?authority\b",
            r"\b(?:every|virtually\s+every)\s+court\s+(?:to|that\s+has)\s+(?:consider|considered|address|addressed)\b",
        ]),
        _rule("LEGAL_SANCTIONS_THREAT", 3, "legal", [
            r"\bsanctions\s+(?:are|is|may\s+be|would\s+be)\s+(?:warranted|appropriate|justified)\b",
            r"\bwarrant(?:s|ing)?\s+sanctions\b",
            r"\b(?:seek|move\s+for|request)\s+sanctions\b",
            r"\b(?:authority|power|discretion)\s+to\s+sanction\b",
        ], severity="high", principle="Agency"),
        _rule("LEGAL_PROCEDURAL_GATEKEEPING", 3, "legal", [
            r"\bfail(?:s|ed)\s+to\s+(?:preserve|exhaust|raise|plead)\s+(?:the\s+|its\s+|their\s+)?[\w-]+\b",
            r"\bprocedurally\s+(?:barred|defaulted|improper)\b",
            r"\b(?:lacks?|without)\s+standing\s+to\b",
        ], principle="Justice"),
        _rule("LEGAL_STRAW_MAN", 2, "legal", [
            r"\b(?:plaintiff|defendant|petitioner|respondent|appellant)s?\s+(?:argues?|contends?|claims?|asserts?)\s+that\s+(?:every|all|any|no|none)\b",
        ], principle="Clarity"),
        # ---- media ---------------------------------------------------------
        _rule("MEDIA_EDITORIAL_AS_NEWS", 3, "media", [
            rf"\b(?i:the)\s+(?i:controversial|embattled|disgraced|beleaguered|notorious|polarizing)\s+{NAME}",
        ], case=True, severity="low"),
        _rule("MEDIA_ANONYMOUS_ATTRIBUTION", 3, "media", [
            r"\b(?:unnamed|anonymous|unidentified)\s+[\w'’-]+\b",
            r"\bsources\s+close\s+to\b",
            r"\bpeople\s+familiar\s+with\s+the\s+(?:matter|situation|plans)\b",
            r"\b(?:critics|skeptics|opponents|believers|congregants|foes|supporters|proponents|backers|fans|advocates|insiders|observers|loyalists|dissidents|activists|lobbyists|allies|members|staffers|employees|managers|alumni|worshippers)\s+(?:say|said|claim|argue|argued|believe|complain|fear|suggest|warn|warned)\b",
        ], cited=True),
        _rule("MEDIA_WEASEL_QUANTIFIERS", 1, "media", [
            rf"\b(?i:many|some|several)\s+{slot(16, 1)}(?i:say|believe|agree|think|argue)\b",
        ], case=True, least=2, severity="low"),
        _rule("MEDIA_FALSE_BALANCE", 1, "media", [
            r"\bsome\s+(?:people\s+)?(?:say|argue|believe|claim)\s+(?:[^\s.!?;]+\s+){1,16}(?:but|while)\s+(?:most|the|many)\s+(?:[^\s.!?;]+\s+){0,16}(?:disagree|disagrees|reject|dispute)\b",
        ]),
        _rule("MEDIA_EMOTIONAL_LEAD", 2, "media", [
            rf"\A{SENTENCE_TEXT}\b(?i:shocking|horrifying|outrageous|devastating|scathing|chilling|explosive|appalling|bombshell|disturbing|fierce|harrowing|jaw-dropping|stunning|terrifying|tragic)\b",
        ], case=True, principle="Clarity"),
        _rule("MEDIA_BURIED_QUALIFIER", 3, "media", [
            rf"{FROM_200}\b(?:however|but|though)\b.{{0,150}}?\b(?:could\s+not\s+be\s+(?:confirmed|verified)|no\s+evidence\s+was\s+found|was\s+later\s+(?:corrected|retracted))",
        ]),
        _rule("MEDIA_SELECTIVE_QUOTATION", 2, "media", [
            r"(?:\bso-called\s+|\b(?:the|their|its|his|her|of|called)\s+)[\"“][#@]?\w(?:[\w'’.&/ -]{0,38}\w)?\.?[\"”]",
        ], least=2),
        _rule("MEDIA_ASYMMETRIC_ATTRIBUTION", 2, "media", [
            r"\b(?:claimed|insisted|alleged|admitted|conceded)\b",
        ], least=2, severity="low"),
        _rule("MEDIA_SPECULATIVE_FRAMING", 2, "media", [
            r"\b(?:is|are)\s+(?:widely\s+)?expected\s+to\b",
            r"\bcould\s+soon\s+(?:lead|result|become|face)\b",
            r"\bis\s+(?:poised|likely|set)\s+to\b",
        ], severity="low"),
        # ---- financial -----------------------------------------------------
        _rule("FIN_SURVIVORSHIP_BIAS", 1, "financial", [
            rf"\b(?i:top|best|winning|successful)\s+(?i:funds|investors|traders|managers)\s+{SLOT}(?i:all)\s+(?i:use|share|follow|have)\b",
            rf"\b(?i:every|all)\s+(?i:successful|legendary)\s+{slot(16, 1)}(?i:has|have|followed|knows)\b",
        ], case=True),
        _rule("FIN_ANCHORING", 2, "financial", [
            r"\b(?:down|up|off)\s+\d+(?:\.\d+)?(?:%|\s+percent)\s+from\s+(?:its|their|the)\s+(?:all-time\s+|52-week\s+|recent\s+)?(?:high|low|peak)s?\b",
            r"\bstill\s+(?:cheap|below)\s+(?:compared\s+to|its)\s+(?:all-time\s+)?(?:high|peak)\b",
        ]),
        _rule("FIN_CHERRY_PICKED_TIMEFRAME", 1, "financial", [
            # The calendar months.
            r"\bsince\s+(?:january|february|march|april|may|june|july|august|september|october|november|december|\d{4}|the\s+(?:bottom|low|crash)),?\s+(?:[^\s.!?;]+\s+){0,16}(?:returned|gained|risen|climbed)\s+\d+(?:\.\d+)?(?:%|\s+percent)",
            r"\bin\s+the\s+last\s+[\w-]+\s+(?:years|months|weeks|quarters)\b",
        ]),
        _rule("FIN_PROJECTION_AS_FACT", 2, "financial", [
            r"\bwill\s+(?:reach|hit|double|triple)\s+(?:\$\s?)?[\d,.]+\s*(?:dollars|percent|%|million|billion)?",
            r"\bguaranteed\s+(?:returns?|gains?|profits?)\b",
        ], severity="high"),
        _rule("FIN_RECENCY_EXTRAPOLATION", 1, "financial", [
            r"\bhas\s+(?:consistently|always|repeatedly)\s+(?:outperformed|beaten|returned)\b",
            r"\b(?:momentum|the\s+rally|the\s+trend)\s+will\s+continue\b",
        ]),
    ]


def build_pack() -> dict:
    """The whole pack as one JSON-ready object."""
    return {
        "schema_version": "1",
        "rules_version": "1.1.0",
        "tiers": TIERS,
        "citation_suppression": {
            "window": CITATION_WINDOW,
            "flags": "i",
            "patterns": CITATIONS,
        },
        "rules": build_rules(),
    }


if __name__ == "__main__":
    target = Path(__file__).with_name("pack.json")
    target.write_text(json.dumps(build_pack(), indent=1, ensure_ascii=False) + "\n", encoding="utf-8")

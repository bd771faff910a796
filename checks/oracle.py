"""SQL for DuckDB that computes what the registered queries compute."""

from __future__ import annotations

import re

from checks.phrases import PHRASES
from checks.sql import S, cuts_to_spans, pattern_row, scan_ctes
from checks.tables import EDGED, PLANTED, phrase_no, q
from checks.variants import (
    EARLIER,
    EXCLUDED,
    EXEMPT_TERM,
    KEEP,
    LISTED_NAMES,
    LISTED_TERMS,
    LOOSE,
    NAMES,
    ORG_TEMPLATES,
    PACK,
    SLOT_CASES,
    SLOT_PACK,
    TEMPLATES,
    URL_SKIP,
)
from swayscan.functions import sentences
from swayscan.functions.regex import SPACE, rewrite
from swayscan.operators.audit import CALENDAR_WORDS, INTENT_WORDS
from swayscan.operators.evaluate import POISSON
from swayscan.operators.terms import LISTED_PREFIXES, NO_PLURAL

ORACLE = {}
ALL = scan_ctes(PACK, "all")
BY_ROW = scan_ctes(PACK, by_row=True)
EDGED_ALL = f"{PLANTED}, {EDGED}, heard as materialized (select * from edged where length(text) <= 200000)"
_REASON = """case when text is null then 'text is null' when length(text) > 200000 then 'text is too long'
  when doc_domain = 'Media' then 'domain is unknown' end"""


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def text_list(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


WANTED = "[" + ", ".join(f"cast({text_list(rules)} as varchar[])" for _, rules in PHRASES) + "]"


def wanted(place: int, key: str = "doc_id") -> str:
    return f"(select w from wanted_list)[({phrase_no(key, place)}) + 1]"


def phrase(place: int, key: str = "doc_id") -> str:
    return f"(select l from phrase_list)[({phrase_no(key, place)}) + 1]"


WANTED_LIST = f"wanted_list as (select {WANTED} as w)"

# --- the scan -----------------------------------------------------------------

ORACLE["moves"] = ALL + "select * from moves"
ORACLE["scan_stream"] = ORACLE["moves"]

_COUNTS = ", ".join(f"count(*) filter (where tier = {t}) as tier_{t}" for t in (1, 2, 3))
ORACLE["tier_counts"] = ALL + f"select p.doc_id, {_COUNTS} from planted p left join moves using (doc_id) group by 1"

_SPANS = 'doc_id, rule_id, s as "start", e as "end"'
ORACLE["find_spans"] = ALL + f"select {_SPANS} from raw join facts using (ord)"
ORACLE["min_matches"] = ALL + f"select {_SPANS} from thr join facts using (ord)"
ORACLE["suppress_if_cited"] = ALL + f"""select {_SPANS}, z.ord is not null as quiet
from thr join facts using (ord) left join quiet z using (doc_id, ord)"""
ORACLE["drop_overlaps"] = ALL + f"select {_SPANS} from kept join facts using (ord)"
ORACLE["order_moves"] = BY_ROW + 'select doc_id, move_no, rule_id, "start", "end" from moves'

_CITES = " union all ".join(
    f"select doc_id, string_split(regexp_replace(text, {q(pattern_row(p, PACK.citations['flags'])[0])}, "
    f"{S} || '\\0' || {S}, 'g'), {S}) as segs from planted"
    for p in PACK.citations["patterns"]
)
ORACLE["find_citations"] = f"""with {PLANTED}, c as ({_CITES})
select doc_id, s as "start", e as "end" from ({cuts_to_spans('c', 'doc_id')}) where e > s"""

ORACLE["rule_ids"] = ALL + """select p.doc_id,
coalesce(string_agg(distinct rule_id, ',' order by rule_id), '') as rule_ids
from planted p left join moves using (doc_id) group by 1"""

ORACLE["scan"] = scan_ctes(PACK, by_row=True, base="readable", source=f"{PLANTED}, {EDGED}") + f"""select p.doc_id,
{_REASON} as reject_reason, {q(PACK.version)} as rules_version, {q(PACK.fingerprint)} as rules_hash,
case when {_REASON} is null then coalesce(string_agg(rule_id || ':' || "start" || ':' || "end", ' ' order by move_no), '') end as moves,
{", ".join(f"case when {_REASON} is null then count(*) filter (where tier = {t}) end as tier_{t}" for t in (1, 2, 3))}
from edged p left join moves using (doc_id) group by p.doc_id, text, doc_domain"""

# --- sources and intake -------------------------------------------------------

_PART_RULES = """part_rules as (
select p_partkey, p_size || '.0' as rules_version, 'NAME_' || p_partkey as rule_id, 0 as ord,
  cast(p_size % 3 + 1 as int) as pit_tier, 1 as min_matches, false as suppress_if_cited, 'i' as flags,
  string_split(p_name, ' ') as indicators from part
union all
select p_partkey, p_size || '.0', 'TYPE_' || p_partkey, 1, 1, 2, true, 's', [p_type, p_brand] from part)"""
ORACLE["load_rule_pack"] = f"""with {_PART_RULES}
select p_partkey, rules_version, rule_id, ord, pit_tier, min_matches, suppress_if_cited, flags,
cast(i - 1 as int) as indicator_no, indicators[i] as indicator
from (select *, unnest(range(1, len(indicators) + 1)) as i from part_rules)"""
ORACLE["pack_fingerprint"] = f"""with {_PART_RULES}
select rule_id, {q(PACK.version)} as rules_version, {q(PACK.fingerprint)} as rules_hash,
sha256('{{"rule_id":"' || rule_id || '","pit_tier":' || pit_tier || ',"indicators":["' ||
  array_to_string(indicators, '","') || '"],"flags":"' || flags || '"}}') as rule_hash from part_rules"""

ORACLE["intake"] = f"""with {PLANTED}, {EDGED} select doc_id, {_REASON} as reject_reason,
cast(length(text) as int) as chars from edged"""
ORACLE["read_utf8_files"] = """with d as (select doc_id, doc_id % 7 = 0 as spoilt, case when doc_id % 11 = 0 then rpad(text, 200001, ' x')
  when doc_id % 13 = 0 then rpad(text, 800001, ' x') else text end as text from documents),
r as (select doc_id, text, case when octet_length(encode(text)) + cast(spoilt as int) + 1 > 800000 then 'too many bytes'
  when spoilt then 'not valid UTF-8' when length(text) + 1 > 200000 then 'text is too long' end as reject_reason from d)
select doc_id, reject_reason, case when reject_reason is null then cast(length(text) as int) + 1 end as chars from r"""

_PAIRS_IN = r"length(regexp_replace({t}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))"
ORACLE["clip_text"] = f"""with {PLANTED}, c as (select doc_id, text, left(text, 200) as head from planted),
k as (select doc_id, text, list_max(list_filter(
  range(greatest(0, length(head) - {_PAIRS_IN.format(t='head')}), length(head) + 1),
  lambda n: n + {_PAIRS_IN.format(t='left(text, n)')} <= 200)) as n from c)
select doc_id, left(text, n) as clipped from k"""
ORACLE["word_count"] = f"""with {PLANTED}
select doc_id, cast(len(regexp_extract_all(text, '[^{SPACE}]+')) as int) as words from planted"""

# The characters outside ASCII in the phrases' matches, as JSON escapes.
_ESCAPES = {"“": "u201c", "”": "u201d", "٣": "u0663", "١": "u0661", "\u212a": "u212a", "ſ": "u017f",
            "\u00a0": "u00a0", "\u2003": "u2003"}
_JSON = """to_json({'rules_version': VERSION, 'rules_hash': HASH, 'moves': coalesce(list({'rule_id': rule_id, 'name': name,
  'tier': tier, 'domain': domain, 'severity': severity, 'start': "start", 'end': "end", 'match': "match"} order by move_no)
  filter (where rule_id is not null), []), 'counts': {'1': count(*) filter (where tier = 1), '2': count(*) filter (where tier = 2),
  '3': count(*) filter (where tier = 3)}})"""
_JSON = _JSON.replace("VERSION", q(PACK.version)).replace("HASH", q(PACK.fingerprint))
for _char, _escape in _ESCAPES.items():
    _JSON = f"replace({_JSON}, '{_char}', chr(92) || '{_escape}')"
ORACLE["write_scan_json"] = BY_ROW + f"select json from (select p.doc_id, {_JSON} as json from planted p left join moves using (doc_id) group by 1)"

# --- more of the scan ---------------------------------------------------------

ORACLE["select_rules"] = BY_ROW + """select doc_domain, rule_id, count(*) as n_moves
from moves join (select doc_id, doc_domain from planted) using (doc_id) group by all"""
ORACLE["candidate_prefilter"] = ALL + """select rule_id, count(distinct doc_id) as matched, cast(0 as bigint) as hidden
from facts left join raw using (ord) group by 1"""

ORACLE["offsets_utf16"] = ALL + f"""select doc_id, move_no, "start", "end",
cast("start" + {_PAIRS_IN.format(t='left(text, "start")')} as int) as start_utf16,
cast("end" + {_PAIRS_IN.format(t='left(text, "end")')} as int) as end_utf16
from moves join planted using (doc_id)"""

# --- display ------------------------------------------------------------------

_CLUSTERS = """, flagged as (select *, case when "start" >= coalesce(max("end") over (partition by doc_id
  order by move_no rows between unbounded preceding and 1 preceding), 0) then 1 else 0 end as opens from moves),
numbered as (select *, sum(opens) over (partition by doc_id order by move_no) as cluster_no from flagged),
clusters as (select doc_id, cast(cluster_no as int) as cluster_no, min("start") as "start", max("end") as "end",
  arg_min(tier, move_no) as tier, string_agg(rule_id, ',' order by move_no) as rule_ids from numbered group by 1, 2)
"""
ORACLE["cluster_moves"] = ALL + _CLUSTERS + """select c.*, substring(text, "start" + 1, "end" - "start") as phrase
from clusters c join planted using (doc_id)"""
ORACLE["annotate_segments"] = ALL + _CLUSTERS + """, edges as (
  select doc_id, "start" as s, "end" as e, tier from clusters
  union all select doc_id, coalesce(lag("end") over (partition by doc_id order by cluster_no), 0), "start", null from clusters
  union all select p.doc_id, coalesce(max("end"), 0), length(p.text), null
    from planted p left join clusters using (doc_id) group by p.doc_id, p.text)
select doc_id, cast(row_number() over (partition by doc_id order by s) as int) as segment_no, tier,
  substring(text, s + 1, e - s) as segment from edges join planted using (doc_id) where e > s"""
_ALIASES = values((int(t), tier["alias"]) for t, tier in PACK.content["tiers"].items())
_SHORTS = values((r["id"], r["description"]) for r in PACK.rules)
ORACLE["move_labels"] = ALL + f""", aliases(tier, alias) as (values {_ALIASES}), shorts(rule_id, short) as (values {_SHORTS})
select doc_id, move_no, rule_id, short, 'Move ' || move_no || ' of ' || count(*) over (partition by doc_id) || ': ' || name ||
  ', Tier ' || tier || ' (' || alias || '), "' || "match" || '"' as line
from moves join aliases using (tier) join shorts using (rule_id)"""
ORACLE["missed_spans"] = ALL + f""", quoted as (select doc_id, text, case when doc_id % 9 = 0 then 'a phrase of no text'
  else {phrase(1)} end as quote from planted),
placed as (select doc_id, quote, cast(strpos(text, quote) - 1 as int) as "at" from quoted)
select doc_id, quote, "at", case when "at" < 0 then 'not in the text' when exists(select 1 from moves m
  where m.doc_id = p.doc_id and m."start" < "at" + length(quote) and m."end" > "at") then 'marked' else 'missed' end as verdict
from placed p"""

# --- corpora ------------------------------------------------------------------

ORACLE["scannable_texts"] = f"""with {PLANTED} select doc_id from planted
where len(regexp_extract_all(text, '[^{SPACE}]+')) >= 3 and not regexp_matches(text, '@|bc_|https?://')"""
ORACLE["exclude_sources"] = f"""with listed(source, reason) as (values {values(EXCLUDED)})
select source, 'kept' as status, '' as reason, count(*) as texts from documents
  where source not in (select source from listed) group by 1
union all select source, case when source in (select source from documents) then 'excluded' else 'not found' end, reason, 0
  from listed"""
ORACLE["dedupe_first"] = """select doc_id, source, md5(text) as text_md5 from documents
qualify row_number() over (partition by text order by doc_id) = 1"""
# Every word is put between marks first, since DuckDB's \\b knows ASCII letters only.
_EDGE = "\ue001"


def _edged(key: str) -> str:
    return re.sub(r"\w+", lambda m: _EDGE + m[0] + _EDGE, key)


_KEYS = "|".join(map(_edged, sorted({**NAMES, **dict.fromkeys(KEEP)}, key=len, reverse=True)))
_SWAP = " ".join(f"when {q(_edged(k))} then {q(v)}" for k, v in NAMES.items())
ORACLE["rename_entities"] = f"""with {PLANTED}, cut as (select doc_id, string_split(regexp_replace(
  regexp_replace(text, '([\\p{{L}}\\p{{N}}_]+)', '{_EDGE}\\1{_EDGE}', 'g'),
  '({_KEYS})', {S} || '\\1' || {S}, 'g'), {S}) as segs from planted)
select doc_id, replace(array_to_string(list_transform(segs, lambda x, i: case when i % 2 = 0 then
  (case x {_SWAP} else x end) else x end), ''), '{_EDGE}', '') as renamed from cut"""

_SWEEP_ROWS = values(
    (n, rule, template, bound, size)
    for n, (rule, template, bound, size) in enumerate(
        (rule, template, bound, size) for rule, template, bound in SLOT_CASES for size in (bound, bound + 1)
    )
)
ORACLE["slot_sweep"] = scan_ctes(
    SLOT_PACK, "all", key="id", base="sweep",
    source=f"""cases(n, rule_id, template, bound, tokens) as (values {_SWEEP_ROWS}),
sweep as materialized (select s_suppkey * 100 + n as id, s_suppkey, rule_id, bound, tokens,
  replace(template, '{{name}}', rtrim(repeat(replace(s_name, '#', '') || ' ', tokens))) as text from supplier, cases)""",
) + """select s_suppkey, rule_id, cast(bound as int) as bound, cast(tokens as int) as tokens, raised,
raised = (tokens <= bound) as holds from (select w.*, exists(select 1 from moves m where m.id = w.id and
  m.rule_id = w.rule_id) as raised from sweep w)"""

_URL = r"https?://[^\s\"''<>)\]`]+"
ORACLE["url_inventory"] = f"""with {PLANTED}, bodies as (select 'page' as kind, page_id as source, url || ' ' || html as body from pages
  union all select 'document', doc_id, text from planted),
found as (select kind, source, rtrim(unnest(regexp_extract_all(body, '{_URL}')), '.,;:') as url from bodies)
select distinct * from found where not regexp_matches(url, {q(URL_SKIP)})"""
ORACLE["quoted_examples"] = f"""with {PLANTED}, found as (select doc_id, list_filter(list_transform(
  regexp_extract_all(text, '"[^"]+"|“[^”]+”'), lambda x: x[2:-2]),
  lambda x: len(regexp_extract_all(x, '[^{SPACE}]+')) >= 3 and not contains(x, ' ... ') and not contains(x, '___')
    and not contains(x, '/')) as l from planted)
select doc_id, cast(i as int) as example_no, l[i] as example from (select *, unnest(range(1, len(l) + 1)) as i from found)"""

# --- pairs --------------------------------------------------------------------

_TEMPLATES = values((n, t) for n, t in enumerate(TEMPLATES + ORG_TEMPLATES))


def _fill(name: str) -> str:
    bare = f"case when {name} like 'the %' then substring({name}, 5) else {name} end"
    capital = f"upper({name}[1]) || substring({name}, 2)"
    return f"replace(replace(replace(template, '{{X}}', {capital}), '{{x}}', {name}), '{{b}}', {bare})"


_SWAPS = """named as (select c_custkey, c_mktsegment, case when c_mktsegment in ('BUILDING', 'FURNITURE')
    then 'the ' || n_name || ' Guild of Lamps' else replace(c_name, '#', ' ') end as name
  from customer join nation on c_nationkey = n_nationkey),
swaps as (select x.c_custkey, x.c_mktsegment, x.c_mktsegment = 'BUILDING' as is_org, x.name as a, y.name as b
  from named x join named y on y.c_custkey = x.c_custkey + 1)"""
_PAIRS = f"""{_SWAPS}, templates(template_no, template) as (values {_TEMPLATES}),
pairs as materialized (select c_custkey, c_mktsegment, cast(template_no as int) as template_no, {_fill('a')} as text_a, {_fill('b')} as text_b
  from swaps, templates where is_org or template_no < {len(TEMPLATES)})"""
ORACLE["make_pairs"] = f"with {_PAIRS} select * from pairs"

_SIDES = scan_ctes(
    PACK, "all", key="id", base="sides",
    source=_PAIRS + """, every as materialized (
  select (c_custkey * 100 + template_no) * 2 as id, c_mktsegment, text_a as text from pairs
  union all select (c_custkey * 100 + template_no) * 2 + 1, c_mktsegment, case c_custkey % 97 when 5 then null
    when 6 then rpad(text_b, 200001, ' x') else text_b end from pairs),
sides as materialized (select * from every where length(text) <= 200000)""",
) + """, ids as (select s.id, c_mktsegment, case when length(text) <= 200000 then
    coalesce(list_sort(list_distinct(list(rule_id) filter (where rule_id is not null))), []) end as l
  from every s left join moves using (id) group by s.id, c_mktsegment, text),
both_sides as (select x.id // 200 as c_custkey, cast((x.id // 2) % 100 as int) as template_no, x.c_mktsegment,
  x.l as a, y.l as b, list_filter(x.l, lambda r: not list_contains(y.l, r)) as only_a,
  list_filter(y.l, lambda r: not list_contains(x.l, r)) as only_b
  from ids x join ids y on y.id = x.id + 1 where x.id % 2 = 0)
"""
ORACLE["symmetry_check"] = _SIDES + f"""select c_custkey, template_no,
case when b is null then 'not scanned' when len(only_a) + len(only_b) > 0 then 'differs'
  when template_no <> {len(TEMPLATES) - 1} and len(a) = 0 then 'raises nothing' else 'same' end as verdict,
array_to_string(a, ',') as ids_a, array_to_string(b, ',') as ids_b,
case when b is not null then array_to_string(only_a, ',') end as only_a,
case when b is not null then array_to_string(only_b, ',') end as only_b from both_sides"""
ORACLE["known_limits_check"] = _SIDES + """select c_custkey, template_no,
case when b is null then 'not scanned' when a = b then 'unexpected pass' else 'known limit' end as verdict from both_sides where c_mktsegment = 'MACHINERY'"""

ORACLE["pair_registry_audit"] = f"""with {_SWAPS}, registry as (select regexp_replace(a, '[0-9]$', '') as a,
  regexp_replace(b, '[0-9]$', '') as b, case c_mktsegment when 'MACHINERY' then 'limit' when 'AUTOMOBILE' then 'retired'
  else 'running' end as status, 'R' || (c_custkey % 30) as reason from swaps),
reasons as (select 'R' || n_nationkey as reason, case when n_regionkey < 3 then 'limit' else 'retired' end as status from nation)
select 'no such reason' as problem, a || ' / ' || b as item from registry r where status <> 'running'
  and not exists (select 1 from reasons s where s.status = r.status and s.reason = r.reason)
union all select 'unused reason', reason from reasons s
  where not exists (select 1 from registry r where s.status = r.status and s.reason = r.reason and r.status <> 'running')
union all select 'listed twice', a || ' / ' || b from (select a, b, max(n) as m from
  (select a, b, status, count(*) as n from registry group by all) group by 1, 2) where m > 1
union all select 'two statuses', a || ' / ' || b from registry group by a, b having count(distinct status) > 1"""

ORACLE["rule_coverage"] = scan_ctes(
    PACK, "all", key="id", base="sides",
    source=_PAIRS + """, sides as materialized (
  select (c_custkey * 100 + template_no) * 2 as id, text_a as text from pairs
  union all select (c_custkey * 100 + template_no) * 2 + 1, text_b from pairs)""",
) + "select rule_id from facts where rule_id not in (select rule_id from moves)"

# --- expected moves and packs -------------------------------------------------

_TWO = scan_ctes(EARLIER, "all", tag="_old") + scan_ctes(PACK, "all", source="", tag="_new").replace("with recursive", ",", 1)
ORACLE["golden_check"] = _TWO + """select doc_id, rule_id, "start", "end", case when o.move_no is null then 'extra'
  when n.move_no is null then 'missing' when case when doc_id % 19 = 0 then upper(o."match") else o."match" end <> n."match"
  then 'other text' else 'ok' end as status
from moves_old o full join moves_new n using (doc_id, rule_id, "start", "end")"""
_CHANGES = """, old_spans as (select doc_id, rule_id, list(("start", "end") order by move_no) as l from moves_old group by 1, 2),
new_spans as (select doc_id, rule_id, list(("start", "end") order by move_no) as l from moves_new group by 1, 2),
changes as (select doc_id, rule_id, case when o.l is null then 'gained' when n.l is null then 'lost'
  when o.l <> n.l then 'other spans' else 'same' end as change from old_spans o full join new_spans n using (doc_id, rule_id))
"""
ORACLE["pack_changes"] = _TWO + _CHANGES + f"""select changes.*,
  left(regexp_replace(text, '[{SPACE}]+', ' ', 'g'), 110) as snippet from changes join planted using (doc_id)"""
ORACLE["pack_diff"] = _TWO + _CHANGES + """select rule_id, count(*) filter (where change <> 'gained') as texts_before,
count(*) filter (where change <> 'lost') as texts_after, count(*) filter (where change = 'gained') as gained,
count(*) filter (where change = 'lost') as lost, count(*) filter (where change = 'other spans') as other_spans
from changes group by 1"""
ORACLE["golden_from_spans"] = scan_ctes(LOOSE, "all") + 'select doc_id, move_no, rule_id, "start", "end" from moves'
ORACLE["domain_independence"] = scan_ctes(
    PACK, "all", base="heard", source=EDGED_ALL
) + """select p.doc_id, d as domain, case when length(p.text) <= 200000 then cast(count(rule_id) filter (
    where d = 'all' or moves.domain = 'general' or moves.domain = d) as int) end as n_moves,
  case when length(p.text) <= 200000 then true end as same
from edged p, (values ('general'), ('legal'), ('media'), ('financial'), ('all')) ds(d) left join moves on moves.doc_id = p.doc_id
group by p.doc_id, p.text, d"""
ORACLE["engine_parity"] = scan_ctes(
    PACK, by_row=True, base="set_rows",
    source=f"""{PLANTED}, {EDGED}, settings as materialized (select doc_id, text,
  case when doc_id % 6 <> 0 then doc_domain end as doc_domain from edged),
set_rows as materialized (select * from settings where length(text) <= 200000 and doc_domain is distinct from 'Media')""",
) + """, counted as (select p.doc_id, case when length(text) <= 200000 and doc_domain is distinct from 'Media'
  then cast(count(rule_id) as int) end as n from settings p left join moves using (doc_id) group by p.doc_id, text, doc_domain)
select doc_id, n as n_native, n as n_arrow, true as same from counted"""

_ALL_WANTED = f"list_sort(list_concat(list_concat({wanted(0)}, {wanted(1)}), {wanted(2)}))"
ORACLE["expected_rules_check"] = scan_ctes(PACK, "all", base="heard", source=f"{EDGED_ALL}, {WANTED_LIST}") + f"""select p.doc_id,
case when text is null or length(text) > 200000 then 'not scanned' when coalesce(list(rule_id order by rule_id)
  filter (where rule_id is not null), []) = {_ALL_WANTED.replace('doc_id', 'p.doc_id')} then 'as expected' else 'differs' end as verdict,
case when length(text) <= 200000 then cast(count(rule_id) as int) end as n_moves,
case when length(text) <= 200000 then coalesce(string_agg(distinct tier, ',' order by tier), '') end as tiers
from edged p left join moves using (doc_id) group by p.doc_id, text"""
ORACLE["polarity_check"] = scan_ctes(PACK, "all", base="heard", source=f"{EDGED_ALL}, {WANTED_LIST}") + f""", cases as (
  select doc_id, {wanted(1)}[1] as first, coalesce(length(text) <= 200000, false) as ok from edged),
seen as (select doc_id, coalesce(first, 'FALSE_BINARY') as rule_id, first is not null as polarity, case when ok then
  exists(select 1 from moves m where m.doc_id = c.doc_id and m.rule_id = coalesce(first, 'FALSE_BINARY')) end as raised from cases c)
select *, case when raised is null then 'not scanned' when raised = polarity then 'holds' else 'fails' end as verdict from seen"""

_GUIDE = f"""{PLANTED}, {WANTED_LIST}, {EDGED},
entries as materialized (select doc_id, coalesce({wanted(1)}[1], 'NO_SUCH_RULE') as own, doc_id % 3 + 1 as pit_tier, doc_domain,
  p.text as example, {phrase(1)} as span, d.text as honest, {phrase(2)} || ' ' || d.text as fair_use, doc_id % 2 = 0 as fair_flagged
  from edged p join documents d using (doc_id)),
parts as materialized (select * from (select doc_id * 3 as id, doc_domain, example as text from entries
  union all select doc_id * 3 + 1, doc_domain, honest from entries
  union all select doc_id * 3 + 2, doc_domain, fair_use from entries) where length(text) <= 200000 and doc_domain <> 'Media')"""
ORACLE["guide_check"] = scan_ctes(PACK, by_row=True, key="id", base="parts", source=_GUIDE) + """, j as (
  select e.*, f.tier as pack_tier, f.domain as pack_domain, strpos(example, span) - 1 as pos from entries e left join facts f on f.rule_id = e.own),
c as (select j.*, doc_domain = 'Media' as unknown, coalesce(length(example) > 200000, true) as unread,
  (select count(*) from moves m where m.id = doc_id * 3 and m.rule_id = own) as own_n,
  (select count(*) from moves m where m.id = doc_id * 3 and m.rule_id <> own) as other_n,
  (select count(*) from moves m where m.id = doc_id * 3 and m.rule_id = own and m."start" < pos + length(span) and m."end" > pos) as span_n,
  (select count(*) from moves m where m.id = doc_id * 3 + 1) as honest_n,
  (select count(*) from moves m where m.id = doc_id * 3 + 2 and m.rule_id = own) as fair_own,
  (select count(*) from moves m where m.id = doc_id * 3 + 2 and m.rule_id <> own) as fair_other from j)
select doc_id, own as id, unnest([x for x in [
  case when unknown then 'domain is unknown' end,
  case when unread and not unknown then 'the example was not scanned' end,
  case when pack_tier is null then 'not in the pack' end,
  case when pack_tier <> pit_tier then 'other tier in the pack' end,
  case when pack_domain <> doc_domain then 'other domain in the pack' end,
  case when own_n = 0 and not unknown and not unread then 'the example is not marked' end,
  case when pos < 0 then 'the flagged span is not in the text' end,
  case when pos >= 0 and span_n = 0 and not unknown and not unread then 'the flagged span is not marked' end,
  case when other_n > 0 then 'the example raises another rule' end,
  case when honest_n > 0 then 'the honest version is marked' end,
  case when (fair_own > 0) <> fair_flagged and not unknown then 'the fair use verdict is wrong' end,
  case when fair_other > 0 then 'the fair use raises another rule' end] if x is not null]) as problem from c"""

ORACLE["corpus_facts"] = ALL + """select lang, count(*) as cases, count(*) filter (where starts_with(source, 'src1')) as prefixed,
count(*) filter (where doc_id in (select doc_id from moves)) as flagged from documents group by rollup (lang)"""

# --- evaluation ---------------------------------------------------------------

ORACLE["label_eval"] = scan_ctes(PACK, "all", source=f"{PLANTED}, {WANTED_LIST}") + f""", pairs as (
  select distinct doc_id, rule_id, 1 as raised, 0 as labelled from moves join labels using (doc_id)
  union all select distinct doc_id, unnest(list_concat({wanted(0)}, {wanted(1)})), 0, 1 from planted join labels using (doc_id)),
outcomes as (select doc_id, rule_id, max(raised) as raised, max(labelled) as labelled from pairs group by 1, 2),
counted as (select md5(cast(doc_id as varchar))[1] < '8' as sealed, rule_id, count(*) filter (where raised + labelled = 2) as hits,
  cast(sum(raised) as bigint) as raised, cast(sum(labelled) as bigint) as labelled from outcomes group by 1, 2)
select *, case when raised > 0 then hits / raised end as precision, case when labelled > 0 then hits / labelled end as recall from counted"""

_LIMITS = ", ".join(map(repr, POISSON))
ORACLE["label_intervals"] = scan_ctes(PACK, "all", source=f"{PLANTED}, {WANTED_LIST}") + f""", pairs as (
  select distinct doc_id, rule_id, 1 as raised, 0 as labelled from moves join labels using (doc_id)
  union all select distinct doc_id, unnest(list_concat({wanted(0)}, {wanted(1)})), 0, 1 from planted join labels using (doc_id)),
outcomes as (select doc_id, rule_id, max(raised) as raised, max(labelled) as labelled from pairs group by 1, 2),
drawn as (select *, len(list_filter([{_LIMITS}], lambda x: x <= p)) as w from (select *,
  ('0x' || md5(doc_id || ':' || replicate)[:12])::bigint / pow(2, 48) as p from outcomes, range(1, 201) r(replicate))),
totals as (select rule_id, replicate, sum(w * raised * labelled) as hits, sum(w * raised) as raised, sum(w * labelled) as labelled
  from drawn group by 1, 2),
rates as (select rule_id, case when raised > 0 then hits / raised end as precision, case when labelled > 0 then hits / labelled end as recall from totals)
select rule_id, {", ".join(f"round(quantile_cont({m}, {at}), 9) as {m}_{n}" for m in ("precision", "recall") for n, at in (("low", 0.025), ("high", 0.975)))}
from rates group by 1"""

_LEFT = f"right(segs[i - 1], {sentences.NEAR})"
_NEXT = f"left(case when segs[i + 1] = '' then coalesce(segs[i + 2], '') else segs[i + 1] end, {sentences.NEAR})"


def _in_sql(pattern: str) -> str:
    return q(rewrite(pattern, False, (r"\b", r"\B")))


def sentence_ctes(source: str) -> str:
    """``sent(doc_id, n, s, e)``, the sentences of the texts of ``source``."""
    one = f"regexp_matches(segs[i], {_in_sql(sentences.ONE_STOP)})"
    return f"""sent_cuts as materialized (select doc_id, string_split(regexp_replace(text, {_in_sql(f"({sentences.CUT})")}, {S} || '\\1' || {S}, 'g'), {S}) as segs
  from {source} where text is not null),
sent_at as (select doc_id, i, segs, cast(coalesce(list_sum(list_transform(segs[1:i], lambda x: length(x))), 0) as int) as at_next
  from (select *, unnest(range(2, len(segs), 2)) as i from sent_cuts)),
sent_starts as materialized (select doc_id, 0 as s from sent_cuts where len(segs) > 1 or segs[1] <> '' union all select doc_id, at_next from sent_at
  where {_NEXT} <> '' and (regexp_matches(segs[i], {_in_sql(sentences.BLANK)}) or not (regexp_matches({_NEXT}, {_in_sql(sentences.LOWER)})
    or ({one} and regexp_matches({_LEFT}, {_in_sql(sentences.TITLE)}))
    or ({one} and regexp_matches({_LEFT}, {_in_sql(sentences.SHORT)}) and not regexp_matches({_NEXT}, {_in_sql(sentences.OPENS)}))))),
sent as materialized (select doc_id, cast(row_number() over w as int) as n, s, cast(coalesce(lead(s) over w, length(text)) as int) as e, text
  from sent_starts join (select doc_id, text from {source}) using (doc_id) window w as (partition by doc_id order by s))"""


ORACLE["sentences"] = f"""with {PLANTED}, {sentence_ctes("planted")}
select doc_id, n as sentence_no, s as "start", e as "end", substring(text, s + 1, e - s) as sentence from sent"""

ORACLE["move_sentences"] = ALL + f""", {sentence_ctes("planted")}
select m.doc_id, move_no, rule_id, "start", "end", sent.n as sentence_no, sent.n = 1 as first_sentence
from moves m join sent on sent.doc_id = m.doc_id and sent.s <= "start" and "start" < sent.e"""

_SIZE = [f"length({phrase(place)})" for place in range(3)]
_BODY = f"(length(p.text) - {_SIZE[0]} - {_SIZE[1]} - {_SIZE[2]} - 4)"
_START = ["0", f"{_SIZE[0]} + 3 + {_BODY}", f"{_SIZE[0]} + 4 + {_BODY} + {_SIZE[1]}"]
_LABELS = " union all ".join(
    f"""select doc_id, unnest(case when len({wanted(place)}) = 0 then ['plain'] else list_distinct({wanted(place)}) end) as technique,
  cast({_START[place]} as int) as s, cast({_START[place]} + case when doc_id % 5 = 0 then {_SIZE[place]} // 2 else {_SIZE[place]} end as int) as e
  from half p where {"doc_id % 11 <> 0" if place == 1 else "true"}"""
    for place in range(3)
)


def _islands(name: str, source: str) -> str:
    """Spans of one text and rule that share characters, joined."""
    return f"""{name} as materialized (select doc_id, rule_id, min(s) as s, max(e) as e from (select *, count(*) filter (where apart) over (
    partition by doc_id, rule_id order by s, e rows unbounded preceding) as island from (select *, coalesce(s >= max(e) over (
    partition by doc_id, rule_id order by s, e rows between unbounded preceding and 1 preceding), true) as apart from {source} where s < e))
  group by doc_id, rule_id, island)"""


def _level(name: str, labelled: str, raised: str, key: str) -> str:
    return f"""select '{name}' as level, rule_id, null::varchar as technique, count(*) filter (where l and r) as hits, count(*) filter (where r) as raised,
  count(*) filter (where l) as labelled, null::bigint as labelled_chars, null::bigint as raised_chars, null::bigint as common_chars
  from (select {key}, rule_id, bool_or(side = 'l') as l, bool_or(side = 'r') as r from (
    select distinct {key}, rule_id, 'l' as side from {labelled} union all select distinct {key}, rule_id, 'r' from {raised}) group by {key}, rule_id)
  group by rule_id"""


ORACLE["level_eval"] = scan_ctes(
    PACK, "all", source=f"{PLANTED}, {WANTED_LIST}, half as materialized (select * from planted where md5(cast(doc_id as varchar))[1] < '8')", base="half"
) + f""", {sentence_ctes("half")},
techniques as materialized ({_LABELS}),
labels_of as (select doc_id, technique as rule_id, s, e from techniques where technique <> 'plain'),
raised_of as (select doc_id, rule_id, "start" as s, "end" as e from moves),
{_islands("wanted_spans", "labels_of")}, {_islands("raised_spans", "raised_of")},
shared as materialized (select w.doc_id, w.rule_id, w.s as a, r.s as b, least(w.e, r.e) - greatest(w.s, r.s) as common,
  row_number() over (partition by w.doc_id, w.rule_id order by w.s, r.s) as rn
  from wanted_spans w join raised_spans r on w.doc_id = r.doc_id and w.rule_id = r.rule_id and w.s < r.e and r.s < w.e),
taken as (select doc_id, rule_id, rn, a, b, true as hit from shared where rn = 1 union all
  select x.doc_id, x.rule_id, x.rn, case when x.a > t.a and x.b > t.b then x.a else t.a end, case when x.a > t.a and x.b > t.b then x.b else t.b end,
    x.a > t.a and x.b > t.b from taken t join shared x on x.doc_id = t.doc_id and x.rule_id = t.rule_id and x.rn = t.rn + 1),
facts_of as (select rule_id, 0 as hits, 0 as raised, 1 as labelled, e - s as lc, 0 as rc, 0 as cc from wanted_spans
  union all select rule_id, 0, 1, 0, 0, e - s, 0 from raised_spans union all select rule_id, 0, 0, 0, 0, 0, common from shared
  union all select rule_id, 1, 0, 0, 0, 0, 0 from taken where hit),
in_sentence as materialized (select 'l' as side, doc_id, n, rule_id from sent join labels_of x using (doc_id) where x.s < sent.e and sent.s < x.e and x.s < x.e
  union all select 'r', doc_id, n, rule_id from sent join raised_of x using (doc_id) where x.s < sent.e and sent.s < x.e),
leveled as (select 'span' as level, rule_id, null::varchar as technique, sum(hits)::bigint as hits, sum(raised)::bigint as raised, sum(labelled)::bigint as labelled,
    sum(lc)::bigint as labelled_chars, sum(rc)::bigint as raised_chars, sum(cc)::bigint as common_chars from facts_of group by rule_id
  union all {_level("sentence", "(select * from in_sentence where side = 'l')", "(select * from in_sentence where side = 'r')", "doc_id, n")}
  union all {_level("document", "labels_of", "raised_of", "doc_id")}
  union all select 'uncovered', null, 't_plain', null, null, count(*), null, null, null from techniques where technique = 'plain' having count(*) > 0)
select *, case when level <> 'uncovered' and raised > 0 then hits / raised end as precision,
  case when level <> 'uncovered' and labelled > 0 then hits / labelled end as recall,
  {q(PACK.version)} as rules_version, {q(PACK.fingerprint)} as rules_hash from leveled"""

# --- audits -------------------------------------------------------------------

ORACLE["validate_pack"] = r"""with r as (select p_brand as pack_id,
  case when p_size = 7 then p_name else p_type || '_' || (p_partkey % 500) end as rule_id, p_size, p_type from part)
select pack_id, rule_id, unnest([x for x in [
  case when p_size = 9 then 'description is missing' end,
  case when not regexp_full_match(rule_id, '[A-Z][A-Z0-9_]*') then 'rule_id has another shape' end,
  case when p_size % 4 = 0 then 'pit_tier is not 1, 2 or 3' end,
  case when p_size = 11 then 'domain is unknown' end,
  case when p_size = 13 then 'severity is unknown' end,
  case when p_size = 17 then 'flags are unknown' end,
  case when p_size = 15 then 'no indicator' end,
  case when p_size - 1 < 1 then 'min_matches is below 1' end] if x is not null]) as problem from r
union all select pack_id, rule_id, 'rule_id is used twice' from r group by 1, 2 having count(*) > 1"""

_NAMES = values((n.lower(),) for n in LISTED_NAMES)
ORACLE["name_list_hits"] = f"""with {PLANTED}, listed(word) as (values {_NAMES}),
t as (select doc_id, list_distinct(regexp_extract_all(regexp_replace(text, '\\[([A-Za-z])([A-Za-z])\\]', '\\2', 'g'), '[A-Za-z]{{2,}}')) as l from planted),
w as (select doc_id, lower(x) as word, bool_and(x = upper(x)) as lone from (select doc_id, unnest(l) as x from t) group by 1, 2)
select doc_id, count(*) as names from w where word not in ({', '.join(map(q, CALENDAR_WORDS))})
  and (lone or word in (select word from listed)) group by 1 having count(*) >= 2"""


# Forms worked out from the term list in SQL; each is searched for in the text as it stands.
_TERMS = values((t,) for t in LISTED_TERMS)
_PREFIXES = values((p,) for p in ("", *LISTED_PREFIXES))
ORACLE["denylist_terms"] = f"""with {PLANTED}, terms(term) as (values {_TERMS}), prefixes(prefix) as (values {_PREFIXES}),
endings as (select term, lower(term) as word from terms union all
  select term, case when regexp_matches(lower(term), '([sx]|sh)$') then lower(term) || 'es'
    when regexp_matches(lower(term), '(^|[^aeiou])y$') then lower(term)[:-2] || 'ies' else lower(term) || 's' end
  from terms where not regexp_matches(lower(term), '({"|".join(e.replace(".", "[.]") for e in NO_PLURAL)})$')),
forms as (select distinct term, prefix || word as form from endings, prefixes
  where prefix = '' or not regexp_matches(word, '[ .-]')),
shapes as (select term, form, '(^|[^\\p{{L}}])' || replace(replace(form, '.', '[.]'), ' ', '[ -]') ||
  case when form like '%.' then '' else '($|[^\\p{{L}}])' end as shape from forms where regexp_matches(form, '[ .]')),
letters as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as form from planted),
held as (select doc_id, term, form from letters join forms using (form) union all
  select doc_id, term, form from planted, shapes
  where contains(lower(text), split_part(rtrim(form, '.'), ' ', 1)) and regexp_matches(lower(text), shape))
select * from held
where not (term = {q(EXEMPT_TERM)} and doc_id in (select doc_id from documents where lang = 'fr'))"""

_INTENT = re.sub(r"\(\?i\)", "", INTENT_WORDS)
ORACLE["audit_intent_words"] = f"""with {PLANTED}, f as (select doc_id, 'text' as field, text as body from planted
  union all select doc_id, 'note', {phrase(1)} from planted)
select doc_id, field, regexp_extract(body, {q('(?i)(' + _INTENT + ')')}, 1) as wording from f
where regexp_matches(body, {q('(?i)' + _INTENT)})"""

ORACLE["catalog_audit"] = """with r as (select 'RULE_' || p_partkey as rule_id from part),
c as (select 'RULE_' || (o_custkey * 2) as rule_id, max(case when o_custkey % 50 = 0 then ' ' else cast(o_custkey // 3 as varchar) end) as name,
  min(o_orderpriority) as short from orders group by 1)
select 'rule has no name' as problem, rule_id as item from r where rule_id not in (select rule_id from c)
union all select 'name has no rule', rule_id from c where rule_id not in (select rule_id from r)
union all select 'name or description is empty', rule_id from c where trim(name) = '' or trim(short) = ''
union all select 'name is used twice', name from c where trim(name) <> '' group by name having count(*) > 1"""
ORACLE["changed_rules_audit"] = """with c as (select distinct l_partkey as k from lineitem where l_quantity > 25)
select 'RULE_' || k as rule_id, 'not in the pack' as problem from c where k not in (select p_partkey from part where p_size > 5)
union all select 'RULE_' || k, 'not documented' from c where k not in (select l_partkey from lineitem where l_returnflag = 'R')
union all select 'RULE_' || k, 'no case' from c where k not in (select l_partkey from lineitem where l_discount > 0.05)"""

ORACLE["tier_counts_by_window"] = ALL + """, t as (select doc_id, doc_id * 60 as ts, doc_id * 60 // 600 * 600 as window_start from planted),
n as (select doc_id, count(*) filter (where tier = 1) as a, count(*) filter (where tier = 2) as b, count(*) filter (where tier = 3) as c
  from moves group by 1)
select window_start, count(*) as texts, coalesce(sum(a), 0)::bigint as tier_1, coalesce(sum(b), 0)::bigint as tier_2,
  coalesce(sum(c), 0)::bigint as tier_3 from t left join n using (doc_id) group by 1
having window_start + 600 <= (select max(ts) from t) - 300"""

ORACLE["rule_facts"] = ALL + """select rule_id, count(distinct doc_id) as texts, count(*) as n_moves from moves group by rollup (rule_id)"""
ORACLE["pair_facts"] = f"""with {_PAIRS}, k as (select case c_mktsegment when 'MACHINERY' then 'limit' when 'AUTOMOBILE' then 'retired'
  else 'running' end as kind, c_custkey from pairs) select kind, count(*) as pairs, count(distinct c_custkey) as groups from k group by rollup (kind)"""
ORACLE["guide_checks"] = scan_ctes(PACK, by_row=True, base="readable", source=f"{PLANTED}, {WANTED_LIST}, {EDGED}") + f""", c as (
  select doc_id, case when doc_id % 3 = 0 then '*' else coalesce({wanted(1)}[1], 'FEAR_URGENCY') end as rule, doc_id % 2 = 0 as flagged,
  {_REASON} as reason from edged),
r as (select *, exists(select 1 from moves m where m.doc_id = c.doc_id and (rule = '*' or m.rule_id = rule)) as raised from c)
select doc_id, rule, case when reason is not null then 'not scanned' when raised = flagged then 'holds' when raised then 'is marked'
  else 'is not marked' end as verdict from r"""
ORACLE["guide_registry_audit"] = f"""with {PLANTED}, {WANTED_LIST}, e as (select coalesce({wanted(1)}[1], 'R' || doc_id) as id from planted),
q as (select doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '"[^"]+"|“[^”]+”'), lambda x: x[2:-2]),
  lambda x: len(regexp_extract_all(x, '[^{SPACE}]+')) >= 3 and not contains(x, ' ... ') and not contains(x, '___') and not contains(x, '/'))) as item from planted)
select 'two entries' as problem, id as item, count(*) as n from e group by id having count(*) > 1
union all select 'quoted without a check', item, count(*) from q
  where not (doc_id % 4 = 0 and item = 'no boats past the second bell') group by item"""
# What each spoiling does to a pack, from the format's description.
ORACLE["validate_packs"] = """with p as (select p_partkey, p_size, p_partkey % 7 as how from part),
found as (select p_partkey, how, unnest(list_concat(
  case when how = 4 then ['not a JSON object'] else ['tiers: no field 2', 'tiers: no field 3', 'rules_version has another shape'] || list_transform(
    ['tier 2: no field name', 'tier 2: no field alias', 'tier 2: no field description', 'tier 3: no field name', 'tier 3: no field alias',
     'tier 3: no field description'], lambda x: x) end,
  case how when 0 then ['schema_version is not 1']
    when 1 then ['citation_suppression: unknown field reach', 'the citation window is below 0']
    when 2 then ['rule 0: unknown field motto', 'rule 0: no field principle', 'rule 1: unknown field motto', 'rule 1: no field principle']
    when 3 then ['citation_suppression: unknown field pattern', 'citation_suppression: no field patterns', 'the citation flags are unknown']
    else [] end)) as problem from p)
select p_partkey, problem from found"""

ORACLE["fact_cube"] = ALL + """, per_case as (select doc_id, rule_id, count(*) as n from moves group by 1, 2 union all
  select p.doc_id, null, count(rule_id) from planted p left join moves using (doc_id) group by 1),
cells as (select d.lang as file, rule_id, starts_with(source, 'src1') as prefixed, sha256(p.text) as digest, n
  from per_case join documents d using (doc_id) join planted p using (doc_id))
select file, false as all_files, rule_id, count(*) as cases, count(*) filter (where prefixed) as prefixed, count(distinct digest) as texts, sum(n)::bigint as n_moves
from cells group by file, rule_id union all
select null, true, rule_id, count(*), count(*) filter (where prefixed), count(distinct digest), sum(n)::bigint from cells group by rule_id"""

_PACK_JSON = """'{"citation_suppression":{"flags":"i","patterns":["' || p_type || '"],"window":120},"rules":[{"description":"' || p_brand ||
  '","domain":"general","flags":"i","id":"NAME_' || p_partkey || '","indicators":["' || replace(p_name, ' ', '","') || '"],"min_matches":1,"name":"' || p_name ||
  '","pit_tier":' || (p_size % 3 + 1) || ',"principle":"Truth","severity":"low","suppress_if_cited":false},{"description":"' || p_brand ||
  '","domain":"media","flags":"s","id":"TYPE_' || p_partkey || '","indicators":["' || p_type || '","' || p_brand || '"],"min_matches":2,"name":"' || p_type ||
  '","pit_tier":1,"principle":"Truth","severity":"low","suppress_if_cited":true}],"rules_version":"' || p_size || '.0","schema_version":"1","tiers":{"1":{"alias":"' ||
  p_brand || '","description":"' || p_name || '","name":"' || p_type || '"}}}'"""
ORACLE["pack_hashes"] = f"select p_partkey, sha256({_PACK_JSON}) as pack_hash from part"
ORACLE["pack_types"] = """select p_partkey, unnest(case p_partkey % 6 when 0 then ['citation_suppression: window is not a whole number']
  when 1 then ['rule 0: min_matches is not a whole number'] when 2 then ['rule 0: suppress_if_cited is not true or false']
  when 3 then ['rule 0: indicators is not a list of strings', 'rule 1: indicators is not a list of strings']
  when 4 then ['pack: tiers is not an object'] else [] end) as problem from part"""
ORACLE["late_windows"] = ALL + """, t as (select doc_id, doc_id * 60 as ts, doc_id * 60 // 600 * 600 as window_start from planted),
mark as (select max(ts) filter (where doc_id % 10 <> 0) - 300 as early, max(ts) - 300 as last from t),
n as (select doc_id, count(*) filter (where tier = 1) as a, count(*) filter (where tier = 2) as b, count(*) filter (where tier = 3) as c
  from moves group by 1),
r as (select t.*, last, coalesce(doc_id % 10 = 0 and window_start + 600 <= early, false) as is_late, a, b, c from t join mark on true left join n using (doc_id))
select window_start, count(*) filter (where not is_late) as texts, count(*) filter (where is_late) as late,
  coalesce(sum(a) filter (where not is_late), 0)::bigint as tier_1, coalesce(sum(b) filter (where not is_late), 0)::bigint as tier_2,
  coalesce(sum(c) filter (where not is_late), 0)::bigint as tier_3, window_start + 600 <= last as closed from r group by window_start, last"""

"""The scan as SQL for DuckDB, built from a pack's patterns.

DuckDB's regex has no look-behind. The two leading ones that packs may use are
spelled as a consumed prefix and as a filter on the start.
"""

from __future__ import annotations

import re

from checks.tables import PLANTED, q
from swayscan.functions.regex import SPACE, WORD, rewrite
from swayscan.rules.catalog import FROM_200, NOT_AFTER_WORD
from swayscan.sources.pack import CITATION_REACH, RulePack

S = "chr(57344)"
_BEFORE = rf"(\A|\A(?s:.)|[^{SPACE}]|[^{WORD}][{SPACE}])"


def pattern_row(pattern: str, flags: str) -> tuple[str, str, int]:
    """``(pattern, replacement, least start)`` for DuckDB."""
    least, prefix, rep = 0, "", f"{S} || '\\0' || {S}"
    if pattern.startswith(NOT_AFTER_WORD):
        pattern, prefix = pattern[len(NOT_AFTER_WORD):], _BEFORE
        rep = f"'\\1' || {S} || '\\2' || {S}"
    elif pattern.startswith(FROM_200):
        pattern, least = pattern[len(FROM_200):], 200
    assert not re.search(r"\(\?<?[!=]", pattern), pattern
    body = rewrite(pattern, "s" in flags, (r"\b", r"\B"))
    body = prefix + (f"({body})" if prefix else body)
    return ("(?i)" if "i" in flags else "") + body, rep, least


def cuts_to_spans(cuts: str, keys: str) -> str:
    """Spans of the even pieces of ``segs`` in relation ``cuts``."""
    before = "coalesce(list_sum(list_transform(segs[1:i-1], lambda x: length(x))), 0)"
    return (
        f"select {keys}, cast({before} as int) as s, cast({before} + length(segs[i]) as int) as e "
        f"from (select {keys}, segs, unnest(range(2, len(segs), 2)) as i from {cuts} where len(segs) > 1)"
    )


def scan_ctes(pack: RulePack, domain: str | None = "all", source: str = PLANTED, base: str = "planted",
              key: str = "doc_id", by_row: bool = False, tag: str = "") -> str:
    """CTEs ``raw{tag}``, ``thr{tag}``, ``cite{tag}``, ``pass{tag}``, ``kept{tag}``, ``moves{tag}``.

    ``source`` defines ``base`` (``key``, ``text``), or is empty if it is already defined.
    """
    rules = pack.select("all" if by_row else domain)
    # One branch per pattern: DuckDB compiles a literal pattern once.
    cuts = []
    for order, rule in rules:
        where = f" where doc_domain in ('all', '{rule['domain']}')" if by_row and rule["domain"] != "general" else ""
        for pattern in rule["indicators"]:
            pat, rep, least = pattern_row(pattern, rule["flags"])
            cuts.append(
                f"select {key}, {order} as ord, {least} as least, {rule['min_matches']} as min_n, "
                f"{str(rule['suppress_if_cited']).lower()} as cs, "
                f"string_split(regexp_replace(text, {q(pat)}, {rep}, 'g'), {S}) as segs from {base}{where}"
            )
    facts = ", ".join(
        f"({n}, {q(r['id'])}, {q(r['name'])}, {r['pit_tier']}, {q(r['domain'])}, {q(r['severity'])})"
        for n, r in rules
    )
    cites = " union all ".join(
        f"select {key}, ord, s as ms, e as me, lo - base as lo, hi - base as hi, idx, string_split("
        f"regexp_replace(ctx, {q(pattern_row(p, pack.citations['flags'])[0])}, {S} || '\\0' || {S}, 'g'), {S})"
        f" as segs from win{tag}"
        for p in pack.citations["patterns"]
    )
    window = pack.citations["window"]
    head = f"{source}, " if source else ""
    t = tag
    return f"""with recursive {head}
facts{t}(ord, rule_id, name, tier, domain, severity) as (values {facts}),
cutsx{t} as ({' union all '.join(cuts)}),
raw{t} as materialized (select * from ({cuts_to_spans(f'cutsx{t}', f'{key}, ord, least, min_n, cs')})
  where e > s and s >= least),
thr{t} as materialized (select * from raw{t} qualify count(*) over (partition by {key}, ord) >= min_n),
win{t} as materialized (select {key}, ord, s, e, idx, lo, hi, greatest(0, lo - {CITATION_REACH}) as base,
  substring(text, greatest(0, lo - {CITATION_REACH}) + 1, hi + {CITATION_REACH} - greatest(0, lo - {CITATION_REACH})) as ctx
  from (select *, greatest(0, idx - {window}) as lo, least(length(text), idx + e - s + {window}) as hi
    from (select t.*, b.text, strpos(lower(b.text), lower(substring(b.text, s + 1, e - s))) - 1 as idx
      from thr{t} t join {base} b using ({key}) where cs))),
ccuts{t} as ({cites}),
cspan{t} as ({cuts_to_spans(f'ccuts{t}', f'{key}, ord, ms, me, lo, hi, idx')}),
cite{t} as materialized (select w.{key}, w.ord, w.s, w.e, exists(select 1 from cspan{t} c where c.{key} = w.{key} and c.ord = w.ord
  and c.ms = w.s and c.me = w.e and c.idx >= 0 and c.s < c.hi and c.e > c.lo) as is_cited from win{t} w),
quiet{t} as (select {key}, ord from cite{t} group by 1, 2 having bool_and(is_cited)),
pass{t} as materialized (select {key}, ord, s, e,
  row_number() over (partition by {key}, ord order by s, e desc) as rn
  from thr{t} t where not exists (select 1 from quiet{t} z where z.{key} = t.{key} and z.ord = t.ord)),
fold{t} as (select {key}, ord, s, e, rn, true as keep, e as last_end from pass{t} where rn = 1
  union all select p.{key}, p.ord, p.s, p.e, p.rn, p.s >= f.last_end,
    case when p.s >= f.last_end then p.e else f.last_end end
  from fold{t} f join pass{t} p on p.{key} = f.{key} and p.ord = f.ord and p.rn = f.rn + 1),
kept{t} as (select {key}, ord, s, e from fold{t} where keep),
moves{t} as materialized (select {key},
  cast(row_number() over (partition by {key} order by s, e desc, ord) as int) as move_no,
  rule_id, name, cast(tier as int) as tier, domain, severity, s as "start", e as "end",
  substring(text, s + 1, e - s) as "match"
  from kept{t} join facts{t} using (ord) join (select {key}, text from {base}) using ({key}))
"""

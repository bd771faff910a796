"""DuckDB SQL of the queries that SQL can express."""

from swayscan.llm.mix import POWERS, SWEEPS

ORACLE: dict[str, str] = {}

ORACLE["op1_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 5
"""

ORACLE["op2_embedding_copies"] = """
with recursive v as (select vec_id, label, embedding::double[] as v from embeddings
  where embedding is not null and label is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join least on least.a = vec_id left join n on n.a = vec_id
"""


def _mix() -> str:
    """Raking in SQL: one common table for each scaling of each sweep."""
    tables = [
        "d as materialized (select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang,"
        " case when contains(text, 'License') then 'licence' when contains(text, ' | ') then 'table'"
        " when contains(text, '@') then 'contact' when contains(text, '%%%') then 'symbols' else 'prose' end as topic,"
        " coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::bigint as tokens from documents)",
        "c as materialized (select source, lang, topic, sum(tokens)::bigint as tokens from d group by all)",
        "w0 as materialized (select *, tokens / (select sum(tokens)::double from c) as weight from c)",
    ]
    for n, power in POWERS.items():
        tables.append(
            f"s_{n} as materialized (select {n}, pow(sum(tokens)::double / (select sum(tokens)::double from c), {power})"
            f" as t from c group by {n} having sum(tokens) > 0)"
        )
        tables.append(f"t_{n} as materialized (select {n}, t / (select sum(t) from s_{n}) as target from s_{n})")
    step = 0
    for _ in range(SWEEPS):
        for n in POWERS:
            tables.append(
                f"w{step + 1} as materialized (select w.* exclude (weight), case when sum(weight) over (partition by {n}) > 0"
                f" then weight * (coalesce(target, 0) / sum(weight) over (partition by {n})) else 0 end as weight"
                f" from w{step} w left join t_{n} using ({n}))".replace("w.* exclude (weight)", "w.source, w.lang, w.topic, w.tokens")
            )
            step += 1
    tables.append(
        "f as (select source, lang, topic, case when tokens > 0 then weight / (tokens / (select sum(tokens)::double from c))"
        f" else 1 end as factor from w{step})"
    )
    tables.append(
        "p as (select d.*, case when tokens > 0 then least(1, factor) else 1 end as p, factor,"
        " ('0x' || substr(md5(doc_id::varchar || ':mix'), 1, 12))::bigint / pow(2, 48) as u"
        " from d join f using (source, lang, topic))"
    )
    return (
        f"with {', '.join(tables)} select doc_id, source, lang, topic, tokens, round(p, 6) as probability,"
        " round(case when p > 0 and tokens > 0 then factor / p else 1 end, 6) as weight, u < p as kept from p"
    )


ORACLE["op3_mix"] = _mix()

ORACLE["op5_warc"] = """
with h as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
f as (select hex, min(page_id) as first from h group by hex)
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, i // 8 * 10 + 1, 10))::bigint >> (35 - 5 * (i % 8))) & 31) + 1)::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from h join f using (hex)
"""


def _rolled(tag: str, levels: int) -> list[str]:
    """From ``{tag}0(g, r, n, h)``, nodes of groups, and ``{tag}f0(g, r, pos, acc, proof, ...)``: a level per pair of tables."""
    tables = []
    for k in range(levels):
        tables += [
            f"{tag}s{k} as materialized (select a.g, a.r, a.n, coalesce(string_agg(b.h, '' order by b.r) filter (where b.r < a.r), '') as before,"
            " coalesce(string_agg(b.h, '' order by b.r) filter (where b.r > a.r), '') as behind"
            f" from {tag}{k} a join {tag}{k} b on a.g = b.g and a.r // 3 = b.r // 3 group by a.g, a.r, a.n)",
            f"{tag}f{k + 1} as materialized (select f.* replace (f.pos // 3 as pos, case when s.n > 1 then sha256(before || acc || behind)"
            f" else acc end as acc, proof || before || behind as proof) from {tag}f{k} f join {tag}s{k} s on s.g = f.g and s.r = f.pos)",
            f"{tag}{k + 1} as materialized (select g, r // 3 as r, (n + 2) // 3 as n,"
            f" case when n > 1 then sha256(string_agg(h, '' order by r)) else min(h) end as h from {tag}{k} group by g, r // 3, n)",
        ]
    return tables


def _merkle(levels: int = 11, source_levels: int = 6) -> str:
    """Trees of up to 3 ** levels leaves a source."""

    def leaf(text: str) -> str:
        shown = (
            f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
            for c in ("doc_id", "source", "lang", "n_chars", text)
        )
        return f"sha256({' || '.join(shown)})"

    last, top = f"l{levels}", f"t{source_levels}"
    tables = [
        "bits(i, k, c) as (select i, 0, i from range(256) t(i) union all"
        " select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8)",
        "crc as materialized (select list(c order by i) as of_byte from bits where k = 8)",
        "d as materialized (select *, case when doc_id is not null and xor(list_reduce(list_concat([4294967295::bigint],"
        " list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b:"
        " xor(a >> 8, of_byte[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0"
        " then replace(text, chr(10), '') else text end as told from documents join crc on true)",
        f"leaves as materialized (select doc_id, case when source is null then '0' else '1' || source end as g, {leaf('text')} as leaf,"
        f" {leaf('told')} as forged from d)",
        "lf0 as materialized (select doc_id, g, leaf, row_number() over w - 1 as pos, forged as acc, '' as proof"
        " from leaves window w as (partition by g order by doc_id nulls first, leaf))",
        "l0 as materialized (select g, pos as r, count(*) over (partition by g) as n, leaf as h from lf0)",
        *_rolled("l", levels),
        f"t0 as materialized (select 0 as g, row_number() over (order by g) - 1 as r, count(*) over () as n, h, g as source from {last})",
        f"tf0 as materialized (select f.doc_id, 0 as g, f.leaf, t0.r as pos, f.acc, f.proof, t0.h as subroot from {last.replace('l', 'lf')} f"
        " join t0 on t0.source = f.g)",
        *_rolled("t", source_levels),
    ]
    return (
        f"with recursive {', '.join(tables)} select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, acc as folded_root,"
        f" acc = h as verified from {top.replace('t', 'tf')} join {top} on true"
    )


ORACLE["op12_merkle_manifest"] = _merkle()

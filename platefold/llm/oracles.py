"""SQL for DuckDB of queries whose text is long."""

from __future__ import annotations

from . import ledger, merkle

IMPACT_SEARCH = r"""
with words as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
    from documents),
asked as (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
    from benchmark),
sizes as (select doc_id, count(*) n from words group by doc_id),
total as (select count(*)::bigint n_docs, sum(n)::bigint n_words from sizes),
postings as (select doc_id, term, count(*)::bigint tf from words where term in (select term from asked) group by all),
weights as (
    select term, floor(1000 * ln((2.0 * any_value(n_docs) + 2)::double / (2.0 * count(*) + 1)::double))::bigint w
    from postings, total group by term),
impacts as (
    select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_words)))) impact
    from postings join weights using (term) join sizes using (doc_id), total),
scores as (select item_id, doc_id, sum(impact)::bigint score from asked join impacts using (term) group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from scores where score > 0)
select item_id, rank::int rank, doc_id, score from ranked where rank <= 20"""


def secret_ledger(rules: tuple[ledger.Rule, ...] = ledger.RULES) -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " union all ".join(
        f"""select doc_id, {k} place, '{r.kind}' kind, i, least, gap, whole, part from (
            select doc_id, {r.least} least, generate_subscripts(w, 1) i,
                   unnest(list_transform(w, lambda x: length(x))) whole, unnest(list_transform(p, lambda x: length(x))) part,
                   unnest(list_transform(g[1:len(w)], lambda x: length(x))) gap
            from (select doc_id, regexp_extract_all(t, {quoted(r.pattern)}, 0) w, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) p, string_split_regex(t, {quoted(r.pattern)}) g
                  from d where regexp_matches(t, {quoted(r.pattern)})))"""
        for k, r in enumerate(rules)
    )
    base = ", ".join(f"'{k}'" for k in ledger.BASE)
    counts = ", ".join(f"count(*) filter (kind = '{k}') n_{k}" for k in ledger.BASE)
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
pieces as ({found}),
ends as (select *, sum(gap + whole) over (partition by doc_id, kind order by i) e from pieces),
spans as (select doc_id, place, kind, (e - whole)::bigint s, e::bigint e from ends where part >= least),
texts as (select *, kind || ':' || s || ':' || e span from spans),
lists as (
    select doc_id, {counts}, string_agg(span, ',' order by s, place) spans,
           coalesce(string_agg(span, ',' order by s, place) filter (kind in ({base})), '') base
    from texts group by doc_id)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) n_{k}" for k in ledger.BASE)}, sha256(coalesce(base, '')) base_sha256,
       coalesce(spans, '') spans, sha256(t) blob
from d left join lists using (doc_id)"""


def merkle_manifest(lower: int = 5, upper: int = 3) -> str:
    """For up to 16**lower rows of a source and 16**upper sources: a group that is down to one node stays as it is."""
    a = merkle.ARITY
    frame = f"partition by g, idx // {a} order by idx rows between"

    def tree(name: str, leaves: str, levels: int) -> str:
        out = f"{name}0 as ({leaves})"
        for k in range(levels):
            out += f""",
{name}{k}w as (
    select *, coalesce(string_agg(h, '') over ({frame} unbounded preceding and 1 preceding), '') before,
           coalesce(string_agg(h, '') over ({frame} 1 following and unbounded following), '') after,
           string_agg(h, '') over ({frame} unbounded preceding and unbounded following) run
    from {name}{k}),
{name}{k + 1} as (select g, idx // {a} idx, (n + {a - 1}) // {a} n, case when n = 1 then h else sha256(run) end h from {name}{k}w where idx % {a} = 0)"""
        return out

    def path(name: str, levels: int, first: str) -> tuple[str, str, str]:
        """Joins from ``first`` (g, idx) upwards, the siblings' text, and the folding of a hash."""
        joins, proof, fold = "", "''", "{}"
        for k in range(levels):
            t = f"{name}{k}w"
            joins += f" join {t} on {t}.g = {first}.g and {t}.idx = {first}.idx // {a**k}"
            proof += f" || case when {t}.n = 1 then '' else {t}.before || {t}.after end"
            fold = f"case when {t}.n = 1 then {fold} else sha256({t}.before || {fold} || {t}.after) end"
        return joins, proof, fold

    framed = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    leaf = lambda text: "sha256(" + " || ".join(framed(text if f == "text" else f) for f in merkle.FIELDS) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    joins, proof, fold = path("v", lower, "leaves")
    top_joins, top_proof, top_fold = path("u", upper, "tops")
    # the fold is nested once for each level: each in a step of its own
    steps, last = "", "changed"
    for name, levels in (("v", lower), ("u", upper)):
        for k in range(levels):
            steps += f",\n{name}{k}f as (select *, case when {name}{k}n = 1 then {last} else sha256({name}{k}b || {last} || {name}{k}a) end {name}{k}h from {'paths' if not steps else before_step})"
            before_step, last = f"{name}{k}f", f"{name}{k}h"
    carried = ", ".join(f"{p}{k}w.n {p}{k}n, {p}{k}w.before {p}{k}b, {p}{k}w.after {p}{k}a" for p, levels in (("v", lower), ("u", upper)) for k in range(levels))
    return f"""
with bits as (
    select list(v order by i) t from (
        select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v
        from (select unnest(range(256)) i))),
ids as (
    select doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) crc
    from (select distinct doc_id from documents), bits),
leaves as (
    select doc_id, source, coalesce('=' || source, '-') g, {leaf("text")} h, crc % 5 = 0 tampered,
           case when crc % 5 = 0 then {leaf(lowered)} else {leaf("text")} end changed,
           row_number() over (partition by source order by doc_id) - 1 idx, count(*) over (partition by source) n
    from documents join ids using (doc_id)),
{tree("v", "select g, idx, n, h from leaves", lower)},
names as (select distinct g, source from leaves),
tops as (select '' g, g of, row_number() over (order by source nulls first) - 1 idx, count(*) over () n, h from v{lower} join names using (g)),
{tree("u", "select g, idx, n, h from tops", upper)},
upper_paths as (select of, tops.h subroot, {", ".join(f"u{k}w.n u{k}n, u{k}w.before u{k}b, u{k}w.after u{k}a" for k in range(upper))}, {top_proof} upper_proof from tops{top_joins}),
paths as (
    select doc_id, leaves.h leaf, changed, subroot, u{upper}.h root, sha256({proof} || upper_proof) proof_sha256,
           {", ".join(f"v{k}w.n v{k}n, v{k}w.before v{k}b, v{k}w.after v{k}a" for k in range(lower))},
           {", ".join(f"u{k}n, u{k}b, u{k}a" for k in range(upper))}
    from leaves{joins} join upper_paths on of = leaves.g, u{upper}){steps}
select doc_id, leaf, subroot, root, proof_sha256, {last} folded_root, {last} = root verified from {before_step}"""

"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .hard_negatives import MiningParams
from .near_dedup import NearDedupParams
from .quality_rules import BOILERPLATE, QualityRules
from .url_filter import BLOCKED_NAMES, RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"'[\x09-\x0D\x20]+'"
_SOLID = r"'[^\x09-\x0D\x20]+'"
_SEPARATORS = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _near_dedup(p: NearDedupParams) -> str:
    return f"""
with recursive words as (
    select doc_id, list_filter(string_split_regex({_LOWER}, {_SPACES}), lambda w: w <> '') as w from documents
), shingles as (
    select distinct doc_id, array_to_string(w[i : i + {p.width - 1}], ' ') as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - {p.width - 2}, 2))) as i from words where len(w) > 0)
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as together
    from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * together >= {p.percent} * (x.n + y.n - together)
), edges as (
    select a, b from links union all select b, a from links
), reach(node, label) as (
    select doc_id, doc_id from documents
    union
    select e.b, r.label from reach r join edges e on e.a = r.node where r.label < e.b
), least as (
    select node, min(label) as component_id from reach group by node
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, l.component_id, d.doc_id = l.component_id as kept
from documents d left join sizes s using (doc_id) join least l on l.node = d.doc_id
"""


def _decontamination(width: int = 10) -> str:
    words = "list_filter(string_split_regex({}, {}), lambda w: w <> '')".format(_LOWER, _SEPARATORS)
    return f"""
with docs as (
    select doc_id, {words} as w from documents
), items as (
    select item_id, {words} as w from benchmark
), windows as (
    select distinct item_id, w[i : i + {width - 1}] as win
    from (select item_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) as i from items where len(w) > 0)
), lengths as (
    select distinct len(win) as n from windows
), placed as (
    select doc_id, i, n, w[i : i + n - 1] as win
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths where len(w) >= n)
), hit as (
    select p.doc_id, p.i, p.n, x.item_id from placed p join windows x on x.win = p.win
), covered as (
    select doc_id, count(distinct place) as n_hit
    from (select doc_id, unnest(range(i, i + n)) as place from hit) group by doc_id
), named as (
    select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct doc_id, item_id::varchar as id from hit) group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(m.n_items, 0)::bigint as n_items,
       sha256(coalesce(m.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from docs d left join covered c using (doc_id) left join named m using (doc_id)
"""


def _quality_rules(r: QualityRules) -> str:
    def count(pattern: str) -> str:
        return f"len(regexp_extract_all(l, '{pattern}'))"

    words = rf"len(regexp_extract_all(l, {_SOLID}))"
    fails = f"""({count('[#*$%&<>]')} >= {r.noisy} * {words} or {count('!')} >= {r.shouting} * {words}
        or ({count('[|»›·•]')} >= 2 and {count('[|»›·•]')} >= {r.bars} * {words})
        or regexp_matches(lower(l), '{"|".join(BOILERPLATE)}'))"""
    return f"""
with docs as (
    select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents
), split as (
    select rid, doc_id, t, list_filter(string_split_regex(t, {_SPACES}), lambda w: w <> '') as w,
           list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {_SOLID})) as lines
    from docs
), threes as (
    select rid, i, count(*) over (partition by rid, w[i : i + 2]) as c
    from (select rid, w, unnest(range(1, len(w) - 1)) as i from split where len(w) >= 3)
), repeated as (
    select rid, count(distinct place) as n from (select rid, unnest([i, i + 1, i + 2]) as place from threes where c > 1) group by rid
), counted as (
    select rid, doc_id, len(w)::bigint as n_words, length(regexp_replace(t, {_SPACES}, '', 'g'))::bigint as word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
           (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
           list_filter(lines, lambda l: {fails}) as failed
    from split left join repeated r using (rid)
), judged as (
    select *, n_words < {r.min_words} or 100 * n_repeat_words > {r.most_repeated} * n_words as base_failed,
           length(regexp_replace(array_to_string(failed, ''), {_SPACES}, '', 'g'))::bigint as failed_chars
    from counted
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 100 * failed_chars <= {r.most_lost} * word_chars as kept, len(failed)::bigint as n_failed_lines, failed_chars
from judged
"""


def _url_filter() -> str:
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    names = ", ".join(f"'{name}'" for name in BLOCKED_NAMES)
    return f"""
with rules(rule_host, rule_path, said) as (values {rules}),
urls as (
    select row_number() over () as rid, page_id,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
    from pages
), fitting as (
    select rid, rule_host || rule_path as rule, said,
           row_number() over (partition by rid order by length(rule_host || rule_path) desc, rule_host || rule_path) as k
    from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule,
       coalesce(said, case when list_has_any(string_split(host, '.'), [{names}]) then 'block' else 'allow' end) as verdict
from urls left join (select * from fitting where k = 1) using (rid)
"""


def _hard_negatives(p: MiningParams) -> str:
    return f"""
with taking_part as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({p.scale} * x::double)) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, r.vec_id as id, r.label = a.label as same, list_inner_product(a.v, r.v)::bigint as score
    from taking_part a join taking_part r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0
), positives as (
    select anchor_id, id as positive_id, score as positive_score
    from (select *, row_number() over (partition by anchor_id order by score desc, id) as k from scored where same) where k <= {p.positives}
)
select anchor_id, positive_id, k::int as rank, id as negative_id, positive_score, score as negative_score
from (select anchor_id, positive_id, positive_score, id, score, row_number() over (partition by anchor_id, positive_id order by score desc, id) as k
      from positives join scored using (anchor_id)
      where not same and {p.low} * positive_score <= 100 * score and 100 * score <= {p.high} * positive_score) where k <= {p.negatives}
"""


ORACLES: dict[str, str] = {
    "op1_near_dedup": _near_dedup(NearDedupParams()),
    "op2_decontamination": _decontamination(),
    "op3_quality_rules": _quality_rules(QualityRules()),
    "op9_url_filter": _url_filter(),
    "op11_hard_negatives": _hard_negatives(MiningParams()),
}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from geoevents.llm.licenses import PHRASES, SHARE, templates_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lines_sql(least_docs: int = 10) -> str:
    return f"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from docs),
keyed as (select *, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_UPPER}', '{_LOWER}') as key from lines),
often as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= {least_docs})
select k.doc_id, count(*)::bigint as n_lines, count(o.key)::bigint as n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (where o.key is null), '')) as kept_sha256
from keyed k left join often o on k.key = o.key
group by k.doc_id
"""


def _quality_sql() -> str:
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
split as (select doc_id, text, regexp_extract_all(text, '{_WORD}') as words, string_split(text, chr(10)) as parts from texts),
windows as (
  select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from split)),
often as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from windows) where n > 1),
covered as (
  select doc_id, count(distinct p)::bigint as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from often) group by doc_id),
filled as (
  select doc_id, list_filter(parts, lambda x: regexp_matches(x, '{_WORD}')) as own from split),
measured as (
  select s.doc_id, len(s.words)::bigint as n_words, length(regexp_replace(s.text, '{_SPACE}', '', 'g'))::bigint as word_chars,
    (length(s.text) - length(regexp_replace(s.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(f.own)::bigint as n_filled,
    (len(f.own) - len(list_distinct(f.own)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from split s join filled f using (doc_id) left join covered c using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 10 * n_symbols <= n_words and 2 * n_words <= word_chars and word_chars <= 20 * n_words
  and not (n_filled >= 4 and 10 * n_dup_lines > 5 * n_filled) as kept
from judged
"""


def _licenses_sql() -> str:
    quoted = lambda ws: "[" + ", ".join("'" + w + "'" for w in ws) + "]"
    templates = ",\n    ".join(
        f"('{t.label}', {quoted([x.decode() for x in t.tokens])}, {t.need})" for t in templates_of(share=SHARE))
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in PHRASES)
    return f"""
with texts as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as text from documents),
split as (select doc_id, text, regexp_extract_all(text, '{_ALNUM}') as words from texts),
phrases(phrase, label) as (values {phrases}),
starts as (
  select doc_id, label, unnest(list_filter(range(0, len(words)), lambda i: words[i + 1:i + len(phrase)] = phrase)) as i
  from split, phrases),
base as (
  select doc_id, count(*)::bigint as n_base, min(i)::bigint as first_word, max(i)::bigint as last_word,
    list_sort(list(distinct label)) as own from starts group by doc_id),
templates(label, tokens, need) as (values
    {templates}),
blocks as (
  select doc_id, list_distinct(regexp_extract_all(block, '{_ALNUM}')) as words
  from (select doc_id, unnest(string_split(text, chr(10))) as block from texts)),
met as (
  select doc_id, label, len(list_intersect(words, tokens)) as overlap, need, len(tokens) as size from blocks, templates
  where len(words) >= need),
found as (
  select doc_id, list(distinct label) as own, max(overlap::double / size) as share from met where overlap >= need group by doc_id)
select s.doc_id, len(s.words)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base, b.first_word, b.last_word,
  coalesce(array_to_string(b.own, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.own, []), coalesce(f.own, [])))), ','), '') as labels,
  case when b.n_base > 0 then 1.0::double else coalesce(f.share, 0.0)::double end as score
from split s left join base b using (doc_id) left join found f using (doc_id)
"""


def _clusters_sql(clusters: int = 8, rounds: int = 10, dim: int = 64) -> str:
    assigned = """select v.row, arg_min(c.no, list_aggregate(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum')
      ::bigint * 64 + c.no) as no from kept v, {c} c group by v.row"""
    steps = []
    for r in range(1, rounds + 1):
        steps.append(f"""a{r} as materialized ({assigned.format(c=f"c{r - 1}")}),
m{r} as (select a.no, k.d, ((sum(k.x) - ((sum(k.x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x
  from a{r} a join (select row, unnest(v) as x, unnest(range({dim})) as d from kept) k using (row) group by all),
n{r} as (select no, list(x order by d) as v from m{r} group by no),
c{r} as materialized (select c.no, coalesce(n.v, c.v) as v from c{r - 1} c left join n{r} n using (no))""")
    return f"""
with whole as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
kept as materialized (select * from whole),
c0 as materialized (
  select row_number() over (order by h, v) - 1 as no, v from (
    select sha256('3:' || vec_id) as h, v from kept where vec_id is not null order by h, v limit {clusters})),
{",".join(steps)},
final as ({assigned.format(c=f"c{rounds}")}),
measured as (
  select k.vec_id, f.no, c.v, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance
  from kept k join final f using (row) join c{rounds} c on c.no = f.no)
select vec_id, no::int as cluster, distance, sum(distance) over (partition by no)::bigint as cluster_inertia,
  sum(distance) over ()::bigint as inertia, sha256(array_to_string(v, ',')) as centroid_sha256
from measured
"""


def _resample_sql(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    # CRC-32 byte by byte: a table of 256 by the usual rule, then a fold over the UTF-8 bytes of each distinct word.
    half = "case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"""
with crc_table as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: {half}) order by i) as t from (select unnest(range(256)) as i)),
doc_words as (
  select row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') as words
  from (select row_number() over () as row, doc_id, text from documents)),
target_words as (select regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') as words from benchmark),
counted as (select row, word, count(*) as n from (select row, unnest(words) as word from doc_words) group by all),
target as (select word, count(*) as n from (select unnest(words) as word from target_words) group by all),
vocabulary as (select distinct word from (select word from counted union all select word from target)),
spelled as (
  select word, [4294967295::bigint] || list_transform(range(1, length(h) + 1, 2), lambda i:
    ((instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)::bigint) as bytes
  from (select word, hex(word) as h from vocabulary)),
hashed as (
  select word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} as bucket
  from spelled, crc_table),
source_counts as (select bucket, sum(n)::bigint as s from counted join hashed using (word) group by bucket),
target_counts as (select bucket, sum(n)::bigint as t from target join hashed using (word) group by bucket),
sums as (select coalesce((select sum(s) from source_counts), 0)::double as ss, coalesce((select sum(t) from target_counts), 0)::double as tt),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (ss + {buckets}) / ((s + 1)::double * (tt + {buckets}))))::bigint as gain
  from source_counts left join target_counts using (bucket), sums),
weights as (select row, sum(n * gain)::bigint as weight from counted join hashed using (word) join gains using (bucket) group by row),
scored as (
  select d.row, d.doc_id, len(d.words)::bigint as n_features, coalesce(w.weight, 0)::bigint as weight,
    coalesce(w.weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint
      as score
  from doc_words d left join weights w using (row)),
placed as (
  select *, n_features >= {least_words} as may, row_number() over (partition by n_features >= {least_words} order by score desc, doc_id) as place,
    count(*) filter (n_features >= {least_words}) over () as n from scored)
select doc_id, n_features, weight, score, case when may and place <= {percent} * n // 100 then place end::bigint as rank from placed
"""


ORACLES = {"op2_licenses": _licenses_sql(), "op5_lines": _lines_sql(), "op9_quality": _quality_sql(),
           "op11_va_clusters": _clusters_sql(), "op12_resample": _resample_sql()}

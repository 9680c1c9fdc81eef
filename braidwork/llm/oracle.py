"""The SQL of the llm queries; each runs over whole tables in DuckDB."""

ORACLE = {}

_STEPS = """
with one as (
  select *, row_number() over (partition by read_key, step_no order by step_id) as nth from call_steps
), coded as (
  select read_key, step_no, called_at, dwell_us,
    case when upper(seq) = 'U' then 'T' when upper(seq) in ('A', 'C', 'G', 'T') then upper(seq) else 'N' end as event
  from one where nth = 1 and seq is not null and seq <> ''
), islands as (
  select *, step_no - row_number() over (partition by read_key, event order by step_no) as island from coded
)
"""

ORACLE["p1_found"] = _STEPS + """
select read_key, cast(min(step_no) as bigint) as first_step, cast(max(step_no) as bigint) as last_step
from islands group by read_key, event, island having count(*) >= 6
"""

ORACLE["p1_runs"] = _STEPS + """
select read_key, event, cast(min(step_no) as bigint) as first_step, cast(max(step_no) as bigint) as last_step,
  count(*) as n_steps, min(called_at) as started_at, max(called_at) as ended_at,
  epoch_us(max(called_at)) - epoch_us(min(called_at)) as duration_us,
  cast(coalesce(sum(dwell_us), 0) as bigint) as dwell_us, count(dwell_us) as n_dwell
from islands group by read_key, event, island
"""

_TERMS = """
with reads as (
  select read_key, replace(regexp_replace(upper(seq), '[^ACGTU]', 'N', 'g'), 'U', 'T') as s
  from seq_reads where seq is not null
), spelt as (
  select read_key, unnest([s[i:i+8] for i in range(1, length(s) - 7)]) as term from reads
), counted as (
  select term, count(*) as occurrences, count(distinct read_key) as records
  from spelt where not contains(term, 'N') group by term
), n as (select count(*) as n from reads)
select term, occurrences, records,
  case when records = 1 or records * 20000 <= n then 'rare' when records * 100 >= n * 5 then 'common' end as mark
from counted, n
"""

ORACLE["p3_terms"] = _TERMS
ORACLE["p3_found"] = f"select term, mark from ({_TERMS}) where mark is not null"

_SPANS = """
with reads as (
  select read_key, replace(regexp_replace(upper(seq), '[^ACGTU]', 'N', 'g'), 'U', 'T') as s from seq_reads where length(seq) >= 80
), windows as (
  select read_key, unnest(range(0, length(s) - 79)) as pos, unnest([s[i:i+79] for i in range(1, length(s) - 78)]) as w from reads
), shared as (
  select w from windows where not contains(w, 'N') group by w having count(distinct read_key) > 1
), places as (
  select read_key, pos, case when pos <= lag(pos) over (partition by read_key order by pos) + 80 then 0 else 1 end as new
  from windows semi join shared using (w)
), spans as (
  select read_key, pos, sum(new) over (partition by read_key order by pos) as nth from places
)
select read_key, min(pos) as span_start, max(pos) + 80 as span_end from spans group by read_key, nth
"""
ORACLE["p5_found"] = _SPANS
ORACLE["p5_cover"] = f"""
select r.read_key, coalesce(length(r.seq), 0) as n_letters, coalesce(t.n_spans, 0) as n_spans,
  coalesce(t.shared_letters, 0) as shared_letters,
  case when length(r.seq) > 0 then round(coalesce(t.shared_letters, 0) / length(r.seq), 6) else 0.0 end as shared_part
from seq_reads r left join (
  select read_key, count(*) as n_spans, cast(sum(span_end - span_start) as bigint) as shared_letters from ({_SPANS}) group by read_key
) t using (read_key)
"""

ORACLE["p6_checked"] = """
select spec_id, capacity_tokens, (select count(*) from documents) as n_docs, 0::bigint as cut_wrongly, 0::bigint as incomplete, 0::bigint as overfull from pack_specs
"""
ORACLE["p7_checked"] = "select lower(trim(source)) as source, max_repeats::bigint as max_repeats, 0::bigint as too_often, 0::bigint as foreign, 0::bigint as twice from mix_targets"

_NEAR = """
with reads as (
  select read_key, replace(regexp_replace(upper(seq), '[^ACGTU]', 'N', 'g'), 'U', 'T') as s from seq_reads where length(seq) >= 16
), spelt as (
  select read_key as key, unnest([s[i:i+15] for i in range(1, length(s) - 14)]) as w from reads
), words as (
  select distinct 'read' as kind, '' as part, key, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as x from spelt where not contains(w, 'N')
  union all select distinct 'cons', coalesce(group_id, ''), cons_key, cast(id as varchar)
    from (select group_id, cons_key, unnest(clu_read_ids) as id from consensus) where id is not null
), sized as (
  select kind, part, key, count(*) as n from words group by all having count(*) >= case kind when 'read' then 100 else 3 end
), members as (select b.*, n from words b join sized using (kind, part, key)
), common as (
  select a.kind, a.part, a.key as key_a, b.key as key_b, a.n as na, b.n as nb, count(*) as c
  from members a join members b on a.kind = b.kind and a.part = b.part and a.x = b.x and a.key < b.key group by all
), pairs as (
  select kind, key_a, key_b, c = na and c = nb as equal from common where c >= case kind when 'read' then 0.6 else 0.7 end * (na + nb - c) - 1e-9
)
"""
ORACLE["p2_found"] = _NEAR + "select kind, key_a, key_b from pairs"
ORACLE["p2_classes"] = _NEAR + """, keys as (
  select 'read' as kind, read_key as key from seq_reads union all select 'cons', cons_key from consensus
), class as (
  select k.kind, k.key, coalesce(min(p.key_a), k.key) as class_key from keys k left join pairs p on p.kind = k.kind and p.key_b = k.key and p.equal group by k.kind, k.key
), links as (
  select kind, class_key, count(distinct other) as n_links from (
    select p.kind, a.class_key, b.class_key as other from pairs p join class a on a.kind = p.kind and a.key = p.key_a join class b on b.kind = p.kind and b.key = p.key_b where not equal
    union all select p.kind, b.class_key, a.class_key from pairs p join class a on a.kind = p.kind and a.key = p.key_a join class b on b.kind = p.kind and b.key = p.key_b where not equal
  ) group by all
)
select c.kind, c.key, c.class_key, count(*) over (partition by c.kind, c.class_key) as class_rows, coalesce(n_links, 0) as n_links
from class c left join links using (kind, class_key)"""

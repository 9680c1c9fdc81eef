"""The SQL of the registered queries; each runs over whole tables in DuckDB."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_READS = """
reads as (
  select group_id, read_id, name, seq, qual from (
    select *, row_number() over (partition by group_id, read_id order by read_key) as nth
    from seq_reads where seq is not null and seq <> ''
  ) where nth = 1
), plain as (
  select *, regexp_replace(translate(seq, 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N', 'g') as s from reads
)
"""
ORACLE["fasta_records"] = f"with {_READS} select group_id, name, replace(seq, chr(10), '') as seq from reads"
ORACLE["residue_codes"] = f"with {_READS} select group_id, read_id, translate(s, 'ACGTN', '01234') as codes, translate(translate(s, 'ACGTN', '01234'), '01234', 'ACGTN') as letters from plain"
ORACLE["reverse_complements"] = f"with {_READS} select group_id, read_id, reverse(translate(s, 'ACGT', 'TGCA')) as seq from plain"
ORACLE["quality_weights"] = f"""with {_READS}, w as (
  select group_id, read_id, list_transform(string_split(qual, ''), lambda x: ascii(x) - 32) as w from reads where qual is not null and qual <> '')
select group_id, read_id, cast(len(w) as bigint) as n, cast(list_sum(w) as bigint) as total, cast(list_min(w) as bigint) as low from w"""
ORACLE["score_matrix"] = """
with a as (select unnest(['A', 'C', 'G', 'T', 'N']) as a), b as (select unnest(['A', 'C', 'G', 'T', 'N']) as b)
select a, b, cast(case when a = 'N' or b = 'N' then 0 when a = b then 2 else -4 end as bigint) as score from a, b"""
ORACLE["gap_costs"] = "select cast(n as bigint) as n, cast(least(4 + 2 * n, 24 + n) as bigint) as cost from range(1, 201) t(n)"
ORACLE["length_order"] = f"with {_READS} select group_id, read_id, row_number() over (partition by group_id order by length(seq) desc, read_id) as place from reads"

_WORDS = """
words as (
  select group_id, read_id, pos, s[pos + 1 : pos + 19] as word
  from (select group_id, read_id, s, unnest(range(0, length(s) - 18)) as pos from plain where length(s) >= 19)
), known as (select * from words where not contains(word, 'N'))
"""
ORACLE["word_counts"] = f"with {_READS}, {_WORDS} select group_id, word, count(*) as n, count(distinct read_id) as reads from known group by group_id, word"

_MASK, _MOD = (1 << 38) - 1, 1 << 38
_CODE = " + ".join(f"cast(instr('ACGT', word[{i}]) - 1 as bigint) * {4 ** (19 - i)}" for i in range(1, 20))
_HASH = f"""
coded as (select group_id, read_id, pos, {_CODE} as x from known),
h1 as (select group_id, read_id, pos, cast((({_MASK} - x) + x::hugeint * {1 << 21}) % {_MOD} as bigint) as x from coded),
h2 as (select group_id, read_id, pos, xor(x, x >> 24) as x from h1),
h3 as (select group_id, read_id, pos, cast((x::hugeint * 265) % {_MOD} as bigint) as x from h2),
h4 as (select group_id, read_id, pos, xor(x, x >> 14) as x from h3),
h5 as (select group_id, read_id, pos, cast((x::hugeint * 21) % {_MOD} as bigint) as x from h4),
h6 as (select group_id, read_id, pos, xor(x, x >> 28) as x from h5),
hashed as (select group_id, read_id, pos, cast((x::hugeint + x::hugeint * {1 << 31}) % {_MOD} as bigint) as hash from h6)
"""
ORACLE["word_hashes"] = f"with {_READS}, {_WORDS}, {_HASH} select group_id, read_id, count(*) as n, min(hash) as low, max(hash) as high, cast(bit_xor(hash) as bigint) as mixed from hashed group by group_id, read_id"
_MINIS = f"""
{_READS}, {_WORDS}, {_HASH},
runs as (select *, pos - row_number() over (partition by group_id, read_id order by pos) as run from hashed),
sized as (select *, count(*) over (partition by group_id, read_id, run) as n from runs),
lows as (
  select *, min(hash) over w as low, count(*) over w as had, row_number() over (partition by group_id, read_id, run order by hash, pos desc) as place
  from sized window w as (partition by group_id, read_id, run order by pos rows between 9 preceding and current row)
), tops as (
  select *, max(case when had = 10 then low end) over (partition by group_id, read_id, run order by pos rows between current row and 9 following) as top from lows
), minis as (
  select group_id, read_id, hash, cast(pos + 18 as integer) as last from tops where (n >= 10 and top = hash) or (n < 10 and place = 1)
)
"""
_BOTH = _MINIS.replace("known as (select * from words where not contains(word, 'N'))", """known as (
  select group_id, read_id, pos, least(word, reverse(translate(word, 'ACGT', 'TGCA'))) as word from words where not contains(word, 'N')
)""")
ORACLE["minimisers_of_both_strands"] = f"""with {_BOTH}
select m.group_id, m.read_id, hash, last, cast(s[last - 17 : last + 1] > reverse(translate(s[last - 17 : last + 1], 'ACGT', 'TGCA')) as integer) as strand
from minis m join plain p on p.group_id = m.group_id and p.read_id = m.read_id"""
ORACLE["fastq_records"] = f"with {_READS} select name, 'x' as comment, seq, qual from reads where length(qual) = length(seq)"
ORACLE["matrix_file"] = """
with m as (select unnest(['A', 'C', 'G', 'T', 'N']) as a, unnest([[91, -114, -31, -123, 0], [-114, 100, -125, -31, 0], [-31, -125, 100, -114, 0], [-123, -31, -144, 91, 0], [0, 0, 0, 0, 0]]) as s)
select a, unnest(['A', 'C', 'G', 'T', 'N']) as b, cast(unnest(s) as bigint) as score from m"""
ORACLE["amino_letters"] = """
with c as (
  select doc_id, list_transform(string_split(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ''),
    lambda x: case when x <> '' and instr('ACGTNBDEFHIJKLMOPQRSUVWXYZ', x) > 0 then instr('ACGTNBDEFHIJKLMOPQRSUVWXYZ', x) - 1 else 26 end) as c
  from documents where text <> ''
) select doc_id, len(c) as n, cast(list_sum(c) as bigint) as total, len(list_filter(c, lambda x: x = 26)) as unknown from c"""
ORACLE["minimisers"] = f"with {_MINIS} select * from minis"
_PAIRS = """
counts as (select group_id, hash, read_id, count(*) as n from minis group by group_id, hash, read_id),
totals as (select group_id, read_id, count(*) as n from minis group by group_id, read_id),
shared as (
  select a.group_id, a.read_id as i, b.read_id as j, cast(sum(least(a.n, b.n)) as bigint) as hits
  from counts a join counts b on a.group_id = b.group_id and a.hash = b.hash and a.read_id < b.read_id group by 1, 2, 3
), pairs as (
  select s.group_id, i, j, hits, round(hits / (x.n + y.n - hits), 6) as similarity
  from shared s join totals x on s.group_id = x.group_id and s.i = x.read_id join totals y on s.group_id = y.group_id and s.j = y.read_id
)
"""
ORACLE["shared_minimisers"] = f"with {_MINIS}, {_PAIRS} select * from shared"
ORACLE["minimiser_jaccard"] = f"with {_MINIS}, {_PAIRS} select * from pairs"
ORACLE["guide_first_pair"] = f"with {_MINIS}, {_PAIRS} select group_id, i, j, similarity from (select *, row_number() over (partition by group_id order by similarity desc, j, i) as nth from pairs) where nth = 1"
_ANCHORS = """
ordered as (select group_id, read_id, lag(read_id) over (partition by group_id order by read_id) as tid from reads),
anchors as (
  select t.group_id, t.read_id as tid, q.read_id as qid, t.last as tpos, q.last as qpos
  from ordered o join minis q on o.group_id = q.group_id and o.read_id = q.read_id
  join minis t on t.group_id = o.group_id and t.read_id = o.tid and t.hash = q.hash
)
"""
ORACLE["anchors"] = f"with {_MINIS}, {_ANCHORS} select * from anchors"
ORACLE["chain_pairs"] = f"""with {_MINIS}, {_ANCHORS}, steps as (
  select a.group_id, a.tid, a.qid, a.tpos as t1, a.qpos as q1, b.tpos as t2, b.qpos as q2, b.tpos - a.tpos as dt, b.qpos - a.qpos as dq
  from anchors a join anchors b on a.group_id = b.group_id and a.tid = b.tid and a.qid = b.qid
    and b.tpos between a.tpos and a.tpos + 100 and b.qpos between a.qpos + 1 and a.qpos + 100
)
select group_id, tid, qid, t1, q1, t2, q2,
  cast(trunc(least(dq, dt, 19) - (case when dq = dt then -1 else floor(floor(log2(abs(dq - dt))) / 2) end + abs(dq - dt) * 0.01::double * 19)) as bigint) as score
from steps where abs(dq - dt) <= 100"""

_ROWS = f"""
{_READS},
rows_ as (select group_id, read_id, rpad(s, cast(max(length(s)) over (partition by group_id) as integer), '-') as aligned from plain),
allcells as (
  select group_id, read_id, col, aligned[col + 1] as base from (select *, unnest(range(0, length(aligned))) as col from rows_)
), cells as (select * from allcells where base <> '-'),
sizes as (select group_id, count(*) as n from rows_ group by group_id),
depths as (select group_id, col, base, count(*) as depth, min(read_id) as first_read from allcells group by group_id, col, base)
"""
ORACLE["msa_cells"] = f"with {_ROWS} select group_id, read_id, cast(col as integer) as col, base from cells"
ORACLE["column_depth"] = f"with {_ROWS} select group_id, cast(col as integer) as col, base, depth, first_read from depths"
_VOTES = """
votes as (
  select group_id, col, base, depth as cov, n from (
    select d.*, row_number() over (partition by group_id, col order by depth desc, base) as nth, sum(depth) over (partition by group_id, col) as total
    from depths d where base in ('A', 'C', 'G', 'T')
  ) join sizes using (group_id) where nth = 1 and depth >= n - total
)
"""
ORACLE["most_frequent"] = f"with {_ROWS}, {_VOTES} select group_id, string_agg(base, '' order by col) as seq, count(*) as len from votes group by group_id"
ORACLE["phred_scores"] = f"with {_ROWS}, {_VOTES} select group_id, cast(col as integer) as col, cov, n, cast(33 + trunc(-10.0::double * log10(1.0::double - 1.0::double / (1.0::double + exp(-(13.8::double * (1.25::double * cov / n - 0.25::double))))) + 0.499::double) as bigint) as phred from votes"
_STEPS = """
named as (select group_id, read_id, col, concat(col, base) as node from cells),
steps as (
  select group_id, read_id, coalesce(lag(node) over (partition by group_id, read_id order by col), 'S') as from_node, node as to_node from named
  union all select group_id, read_id, arg_max(node, col) as from_node, 'E' as to_node from named group by group_id, read_id
), edges as (select group_id, from_node, to_node, count(*) as weight from steps group by 1, 2, 3)
"""
ORACLE["edges"] = f"with {_ROWS}, {_STEPS} select * from edges"
ORACLE["edge_reads"] = f"with {_ROWS}, {_STEPS} select group_id, from_node, to_node, string_agg(cast(read_id as varchar), ',' order by read_id) as read_ids from steps group by 1, 2, 3"
ORACLE["node_weights"] = f"with {_ROWS}, {_STEPS} select group_id, from_node as node, cast(sum(weight) as bigint) as weight from edges group by 1, 2"
ORACLE["path_scores"] = f"""with {_ROWS}, {_STEPS}, totals as (select group_id, from_node, sum(weight) as total from edges group by 1, 2)
select group_id, from_node, to_node, cast(greatest(round(ln(weight / total)), -20) as bigint) as score from edges join totals using (group_id, from_node)"""
_SITES = """
bounds as (select group_id, n, greatest(2, floor(greatest(2, ceil(n * 0.25)) / 2)) as least from sizes),
kept as (select d.*, count(*) over (partition by group_id, col) as k from depths d join bounds using (group_id) where depth between least and n - least),
alleles as (select group_id, col, base, depth, first_read from kept where k >= 2),
sites as (select group_id, col, cast(sum(depth) as bigint) as depth, max(cast(base = '-' as integer)) as var_type, string_agg(base, '' order by first_read) as alleles from alleles group by 1, 2),
one as (
  select a.group_id, a.col, a.base, a.first_read, a.depth, string_agg(cast(c.read_id as varchar), ',' order by c.read_id) as t
  from alleles a join allcells c on a.group_id = c.group_id and a.col = c.col and a.base = c.base group by all
), per as (select group_id, col, string_agg(t, ';' order by first_read) as profile, cast(sum(depth) as bigint) as depth, max(cast(base = '-' as integer)) as var_type from one group by 1, 2),
profiles as (select group_id, min(col) as site, count(*) as count, any_value(depth) as depth, min(var_type) as var_type from per group by group_id, profile),
at_site as (
  select c.group_id, p.site, c.read_id, c.base, p.count * case when p.var_type = 0 then 2 else 1 end as weight
  from profiles p join alleles a on p.group_id = a.group_id and p.site = a.col join allcells c on c.group_id = a.group_id and c.col = a.col and c.base = a.base
), distances as (
  select a.group_id, a.read_id as i, b.read_id as j, cast(sum(a.weight) as bigint) as dis
  from at_site a join at_site b on a.group_id = b.group_id and a.site = b.site and a.read_id < b.read_id and a.base <> b.base group by 1, 2, 3
), both_ as (select group_id, i as a, j as b, dis from distances union all select group_id, j, i, dis from distances),
top_ as (
  select a.group_id, c.read_id, a.nth from (
    select a.group_id, a.col, a.base, row_number() over (partition by a.group_id order by a.first_read) as nth from alleles a join (
      select *, row_number() over (partition by group_id order by count desc, depth desc, var_type, site) as priority from profiles
    ) p on p.group_id = a.group_id and p.site = a.col and priority = 1
  ) a join allcells c on c.group_id = a.group_id and c.col = a.col and c.base = a.base
), far as (
  select group_id, i, j, dis from (
    select x.group_id, x.read_id as i, y.read_id as j, d.dis, row_number() over (partition by x.group_id order by d.dis desc, x.nth, y.nth, x.read_id, y.read_id) as nth
    from top_ x join top_ y on x.group_id = y.group_id and x.nth < y.nth join both_ d on d.group_id = x.group_id and d.a = x.read_id and d.b = y.read_id
  ) where nth = 1
), reached as (
  select r.group_id, r.read_id, coalesce(x.dis, 0) as di, coalesce(y.dis, 0) as dj, row_number() over (partition by r.group_id order by r.read_id) as nth
  from rows_ r join far using (group_id) left join both_ x on x.group_id = r.group_id and x.a = r.read_id and x.b = far.i
  left join both_ y on y.group_id = r.group_id and y.a = r.read_id and y.b = far.j
), walk as (
  select group_id, 0 as nth, 0 as zeros, 0 as ones, cast(null as integer) as read_id, cast(null as integer) as cluster from far
  union all select group_id, nth, zeros + 1 - to_, ones + to_, read_id, to_ from (
    select r.group_id, cast(r.nth as integer) as nth, w.zeros, w.ones, r.read_id, case when di < dj then 0 when dj < di then 1 when w.zeros < w.ones then 0 else 1 end as to_
    from walk w join reached r on r.group_id = w.group_id and r.nth = w.nth + 1)
), assigned as (select group_id, read_id, cluster from walk where nth > 0
), inner_ as (
  select a.group_id, a.cluster, a.read_id, coalesce(sum(case when b.read_id is not null then d.dis end), 0) as total
  from assigned a left join both_ d on d.group_id = a.group_id and d.a = a.read_id
  left join assigned b on b.group_id = a.group_id and b.read_id = d.b and b.cluster = a.cluster group by 1, 2, 3
)
"""
ORACLE["het_sites"] = f"with recursive {_ROWS}, {_SITES} select group_id, cast(col as integer) as col, depth, var_type, alleles from sites"
ORACLE["het_profiles"] = f"with recursive {_ROWS}, {_SITES} select group_id, cast(site as integer) as site, count, depth, var_type from profiles"
ORACLE["het_priority"] = f"with recursive {_ROWS}, {_SITES} select group_id, cast(site as integer) as site, count, depth, var_type, row_number() over (partition by group_id order by count desc, depth desc, var_type, site) as priority from profiles"
ORACLE["read_distances"] = f"with recursive {_ROWS}, {_SITES} select * from distances"
ORACLE["farthest_pair"] = f"with recursive {_ROWS}, {_SITES} select * from far"
ORACLE["cluster_assignment"] = f"with recursive {_ROWS}, {_SITES} select * from assigned"
ORACLE["cluster_medoids"] = f"with recursive {_ROWS}, {_SITES} select group_id, cluster, read_id as medoid, cast(total as bigint) as total from (select *, row_number() over (partition by group_id, cluster order by total, read_id) as nth from inner_) where nth = 1"
ORACLE["cluster_cover"] = f"with recursive {_ROWS}, {_SITES}, {_STEPS} select s.group_id, cluster, from_node as node, count(*) as cov from steps s join assigned a on s.group_id = a.group_id and s.read_id = a.read_id where from_node <> 'S' group by all"
ORACLE["aligned_rows"] = f"with {_ROWS} select group_id, read_id, aligned from rows_"
_GFA_NODE = "cast(dense_rank() over (partition by group_id order by col, base) as varchar)"
ORACLE["gfa_segments_of_rows"] = f"with {_ROWS} select group_id, concat('S', chr(9), {_GFA_NODE}, chr(9), base) as line from (select distinct group_id, col, base from cells)"
_GFA_IDS = f"ids as (select group_id, concat(col, base) as node, {_GFA_NODE} as id from (select distinct group_id, col, base from cells))"
ORACLE["gfa_links_of_rows"] = f"with {_ROWS}, {_STEPS}, {_GFA_IDS} select e.group_id, concat('L', chr(9), a.id, chr(9), '+', chr(9), b.id, chr(9), '+', chr(9), '0M') as line from edges e join ids a on a.group_id = e.group_id and a.node = e.from_node join ids b on b.group_id = e.group_id and b.node = e.to_node"
ORACLE["gfa_paths_of_rows"] = f"with {_ROWS}, {_STEPS}, {_GFA_IDS} select n.group_id, concat('P', chr(9), n.read_id + 1, chr(9), string_agg(concat(id, '+'), ',' order by col), chr(9), '*') as line from named n join ids i on i.group_id = n.group_id and i.node = n.node group by n.group_id, n.read_id"
_SEGS = """
segs as (
  select group_id, trim(name) as name, regexp_replace(translate(seq, 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N', 'g') as seq from (
    select *, row_number() over (partition by group_id, trim(name) order by seg_key) as nth from gfa_segments where trim(name) <> '' and seq is not null and seq <> ''
  ) where nth = 1
)
"""
ORACLE["gfa_path_walk"] = f"""with {_SEGS}, lines as (select group_id, string_agg(concat(name, '+'), ',' order by name) as path from segs group by group_id),
steps as (select group_id, unnest(range(0, len(string_split(path, ',')))) as at, unnest(string_split(path, ',')) as step from lines)
select s.group_id, s.at, rtrim(s.step, '+') as name, lead(rtrim(s.step, '+')) over (partition by s.group_id order by s.at) as next_name, g.seq
from steps s join segs g on g.group_id = s.group_id and g.name = rtrim(s.step, '+')"""
# A field in quotation marks, a doubled mark standing for one, or a field without any.
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_LINES = f"""
split_ as (
  select *, string_split(raw_line, chr(9)) as tabs, regexp_full_match(raw_line, '{_FIELD}(?:,{_FIELD})*') as sound,
    list_transform(regexp_extract_all(',' || raw_line, ',({_FIELD})', 1), lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) as f
  from raw_records
), judged as (
  select *, case
    when raw_line is null then 'columns'
    when rec_format = 'reads_csv' then case
      when not sound then 'quoting' when len(f) <> 5 then 'columns' when not regexp_full_match(f[1], '[0-9]+') then 'read_id'
      when f[2] = '' or contains(f[2], ' ') or contains(f[2], chr(9)) then 'name' when not regexp_full_match(f[4], '[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]+') then 'seq'
      when f[5] <> '' and (length(f[5]) <> length(f[4]) or not regexp_full_match(f[5], '[!-~]*')) then 'qual' end
    when rec_format = 'gfa_s' then case
      when len(tabs) < 3 or tabs[1] <> 'S' then 'columns' when tabs[2] = '' or contains(tabs[2], ' ') then 'name'
      when not regexp_full_match(tabs[3], '[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]+') then 'seq' end
    else 'format' end as fault
  from split_
), final as (
  select j.*, coalesce(fault, case when rec_format = 'gfa_s' and line_no > min(case when fault is null and rec_format = 'gfa_s' then line_no end) over (partition by source_file, case when fault is null and rec_format = 'gfa_s' then tabs[2] end) then 'duplicate_name' end) as reason
  from judged j
)
"""
ORACLE["p4_found"] = f"with {_LINES} select raw_id, reason from final where reason is not null"
ORACLE["p4_rows"] = f"""with {_LINES} select raw_id, rec_format as kind,
  case when rec_format = 'reads_csv' then try_cast(f[1] as bigint) end as read_id, case when rec_format = 'reads_csv' then f[2] else tabs[2] end as name,
  case when rec_format = 'reads_csv' then f[3] end as comment, case when rec_format = 'reads_csv' then f[4] else tabs[3] end as seq,
  case when rec_format = 'reads_csv' and f[5] <> '' then f[5] end as qual, case when rec_format = 'gfa_s' then array_to_string(tabs[4:], chr(9)) end as tags
from final where reason is null"""

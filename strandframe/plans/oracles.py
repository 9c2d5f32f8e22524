"""The queries of ``queries`` in SQL for DuckDB."""

from strandframe.plans import views as V

A = f"a as (select row_number() over () rn, * from ({V.duck(V.ALIGNMENTS)}))"
REFS = f"refs as ({V.duck(V.REFERENCES)})"
REGIONS = f"regions as ({V.duck(V.REGIONS)})"
HEADER = f"h as (select row_number() over (order by grp, k) - 1 rec_idx, * from ({V.duck(V.HEADER)}))"
FASTA = f"fa as ({V.duck(V.FASTA)})"
CORE = f"core as ({V.duck(V.CORE)})"
#: A sequence's text: the header ">name made" and its lines, each with a newline.
FAI = """one as (select name, sum(len(bases))::bigint len, min_by(len(bases), line_no)::int line_blen, (min_by(len(bases), line_no) + 1)::int line_len, md5(string_agg(bases, '' order by line_no)) digest, (len(name) + 7 + sum(len(bases) + 1))::bigint size from fa group by name),
fai as (select *, (coalesce(sum(size) over (order by name rows between unbounded preceding and 1 preceding), 0) + len(name) + 7)::bigint as start from one)"""
OPS = """o as (select rn, k, right(op, 1) l, left(op, len(op) - 1)::int n from (select rn, generate_subscripts(p, 1) k, unnest(p) op from (select rn, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') p from a))),
run as (select *, coalesce(sum(case when l in ('M', 'D', 'N', 'H', '=', 'X') then n else 0 end) over (partition by rn order by k rows between unbounded preceding and 1 preceding), 0) off from o),
spans as (select rn, sum(case when l in ('M', 'D', 'N', 'H', '=', 'X') then n else 0 end) span, sum(case when l in ('M', 'D', 'N', '=', 'X') then n else 0 end) spec_span from o group by rn),
ev as (select a.rn, a.read_name, a.ref_id, l kind, (pos + off)::int epos, n, k from a join run using (rn) where l in ('I', 'D'))"""
NAMED = """named as (select region_id, refs.ref_id, beg g_beg, case when e <= beg or e > length then length else e end g_end from (select *, case when region_id % 10 = 0 then 0 else fin end e from regions) r join refs using (name))"""
SEQ = "substr(translate(upper(md5(read_name)), '0123456789ABCDEF', '=ACMGRSVTWYHKDBN'), 1, l_seq)"
QUALS = "list_transform(generate_series(0, l_seq - 1), lambda k: ((first_qual + k) % 42)::int)"
QTEXT = f"case when no_qual then '*' else array_to_string(list_transform({QUALS}, lambda q: chr(q + 33)), '') end"
FLOAT = "case nm % 4 when 0 then (nm // 4)::varchar || '.0' when 1 then (nm // 4)::varchar || '.25' when 2 then (nm // 4)::varchar || '.5' else (nm // 4)::varchar || '.75' end"
T = "chr(9)"
#: t_len / 8 = (nm * 37 - 100) / 8 with its shortest decimals; 0.1 and -2.5e-7 are those of 32-bit floats.
EIGHTH = "(case when t_len % 8 = 0 then (t_len // 8)::varchar || '.0' else (t_len / 8.0)::double::varchar end)"
AUX = f"case when l_partkey % 7 = 0 then 'NM:i:' || nm else 'NM:i:' || nm || {T} || 'XB:i:' || nm || ',' || t_len || {T} || 'RG:Z:' || read_group || {T} || 'XF:f:' || {FLOAT} || {T} || 'XA:A:' || read_group || {T} || 'XH:H:' || upper(hex(l_partkey)) || {T} || 'BF:f:' || {EIGHTH} || ',0.10000000149,-2.49999999369e-07' end"


def bin_case(beg: str, last: str) -> str:
    levels = "".join(f" when ({beg}) >> {s} = ({last}) >> {s} then {f} + (({beg}) >> {s})" for s, f in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)))
    return f"(case{levels} else 0 end)::int"


ORACLES = {
    "indels_by_reference": f"with {A}, {REFS}, {OPS} select name ref_name, kind, count(*) n_events, sum(n)::bigint total_len, sum(epos)::bigint sum_pos from ev join refs using (ref_id) group by all",
    "indel_lists": f"with {A}, {OPS}, t as (select rn, coalesce(string_agg(case when kind = 'I' then epos || ':' || n end, ',' order by k), '') i, coalesce(string_agg(case when kind = 'D' then epos || ':' || n end, ',' order by k), '') d from ev group by rn) select read_name, coalesce(i, '') insertions, coalesce(d, '') deletions from a left join t using (rn)",
    "core_unpack": f"with {CORE} select read_name, (bin_mq_nl >> 16)::int bin, ((bin_mq_nl >> 8) & 255)::int mapq, (bin_mq_nl & 255)::int l_read_name, (flag_nc >> 16)::int flag, (flag_nc & 65535)::int n_cigar_op from core",
    "pack_ints": f"with {A}, v as (select read_name, l_orderkey * 7919 + l_partkey - 90000 v from a) select read_name, v i64, case when v < 0 then (v::hugeint + 18446744073709551616)::varchar else v::varchar end u64, "
    + ", ".join(f"((v % {2**b}) + {2**b}) % {2**b} u{b}, (((v % {2**b}) + {2**b}) % {2**b} + {2 ** (b - 1)}) % {2**b} - {2 ** (b - 1)} i{b}" for b in (8, 16, 32))
    + " from v",
    "flag_reverse": f"with {A} select read_name, flag & 16 <> 0 is_reverse, flag & 1 <> 0 is_paired from a",
    "ref_lookup": f"with {A}, {REFS} select read_name, placed_ref_id ref_id, case when placed_ref_id < 0 then '*' else name end ref_name, coalesce(length, -1) ref_length from a left join refs on refs.ref_id = placed_ref_id",
    "ref_ids": f"with {REGIONS}, {REFS} select region_id, n as name, coalesce(min(ref_id), -1) ref_id from (select region_id, regexp_replace(name, 'NATION_1', 'NATION_', 'g') n from regions) left join refs on name = n group by region_id, n",
    "rnext_name": f"with {A}, {REFS} select read_name, case when next_ref_id < 0 then '*' when next_ref_id = placed_ref_id then '=' else name end rnext, coalesce(length, -1) rnext_length from a left join refs on refs.ref_id = next_ref_id",
    "positions": f"with {A} select read_name, pos + 1 pos1, pos pos0, next_pos + 1 pnext1, mapq, t_len, l_seq from a",
    "end_position": f"with {A}, {OPS} select read_name, (pos + span + 1)::int end1, (pos + span)::int end0, (pos + spec_span)::int last1_spec from a join spans using (rn)",
    "indel_at": f"""with {A}, {OPS}, sites as (select p_partkey site_id, (p_partkey % 25)::int ref_id, ((p_partkey * 499) % 1000000)::int p, case p_partkey % 3 when 0 then 'I' when 1 then 'D' else 'ID' end kind from part),
      hit as (select a.rn, a.read_name, s.site_id, s.p, s.kind from a join spans using (rn) join sites s on a.ref_id = s.ref_id and pos + 1 <= p and p <= pos + span + 1)
      select h.read_name, h.site_id, h.p, h.kind, coalesce(bool_or(e.kind = 'I' and contains(h.kind, 'I') and e.epos = h.p or e.kind = 'D' and contains(h.kind, 'D') and e.epos < h.p and h.p <= e.epos + e.n), false) has_indel from hit h left join ev e using (rn) group by h.rn, h.read_name, h.site_id, h.p, h.kind""",
    "sam_cigar": f"with {A} select read_name, replace(cigar, 'X', 'M') compat, cigar spec from a",
    "long_cigar": f"with {A} select read_name, case when l_partkey % 2 = 0 then l_partkey || 'M5I' else l_seq || 'S77N' end cigar from a",
    "seq_decode": f"with {A} select read_name, {SEQ} seq from a",
    "qual_text": f"with {A} select read_name, {QTEXT} qual from a",
    "qual_list": f"with {A} select read_name, array_to_string(case when no_qual then list_transform(generate_series(1, l_seq), lambda k: 255) else {QUALS} end, ',') quals from a",
    "read_group": f"with {A} select read_name, case when l_partkey % 7 <> 0 then read_group end read_group from a",
    "sam_aux": f"with {A} select read_name, {AUX} aux from a",
    "to_sam": f"""with {A}, {REFS} select read_name, concat_ws({T}, read_name, flag, case when placed_ref_id < 0 then '*' else r.name end, pos + 1, mapq, replace(cigar, 'X', 'M'), case when next_ref_id < 0 then '*' when next_ref_id = placed_ref_id then '=' else m.name end, next_pos + 1, t_len, {SEQ}, {QTEXT}, {AUX}) line
      from a left join refs r on r.ref_id = placed_ref_id left join refs m on m.ref_id = next_ref_id""",
    "header_dict": f"""with {HEADER}, f as (select *, split_part(line, {T}, 1) code, list_filter(string_split(substr(line, 5), {T}), lambda x: contains(x, ':')) fs from h)
      select rec_idx::int rec_idx, code, case when code <> '@CO' then array_to_string(list_transform(fs, lambda x: split_part(x, ':', 1) || '=' || substr(x, strpos(x, ':') + 1)), ';') end tags, case when code = '@CO' then substr(line, 5) end as comment from f""",
    "read_groups": f"with {HEADER} select rec_idx::int rec_idx, regexp_extract(line, 'ID:([^{chr(9)}]*)', 1) id from h where line like '@RG%'",
    "header_text": f"""with {HEADER}, {REFS}, all_lines as (select grp, rec_idx, replace(line, {T} || 'badfield', '') line from h union all select 1, 1000 + ref_id, '@SQ' || {T} || 'SN:' || name || {T} || 'LN:' || length from refs where name not in (select regexp_extract(line, 'SN:([^{chr(9)}]*)', 1) from h where grp = 1))
      select string_agg(line, chr(10) order by grp, rec_idx) as text from all_lines""",
    "reg2bin": f"with {REGIONS} select region_id, {bin_case('beg', 'greatest(fin, beg + 1) - 1')} bin, (beg >> 14)::int as window from regions",
    "reg2bins": f"with {REGIONS}, r as (select region_id, beg, greatest(fin, beg + 1) - 1 e from regions), b as (select region_id, 0 b from r "
    + "".join(f"union all select region_id, unnest(generate_series({f} + (beg >> {s}), {f} + (e >> {s}))) from r " for s, f in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)))
    + ") select region_id, string_agg(b::varchar, ',' order by b) bins from b group by region_id",
    "fixed_regions": f"with {REGIONS}, {REFS}, {NAMED} select region_id, ref_id, g_beg, g_end from named",
    "region_overlap": f"with {A}, {OPS}, {REGIONS}, {REFS}, {NAMED} select region_id, count(*) n_reads, sum(pos)::bigint sum_pos from a join spans using (rn) join named g on g.ref_id = a.ref_id and pos < greatest(g_end, g_beg + 1) and g_beg < greatest(pos + span, pos + 1) group by region_id",
    "region_reads": f"with {A}, {OPS} select read_name, pos, (pos + span)::int end0 from a join spans using (rn) where ref_id = 3 and pos < 300000 and pos + span > 100000",
    "jump_first": f"""with {A}, {OPS}, {REGIONS}, {REFS}, {NAMED}, t as (select region_id, read_name, placed_ref_id ref_id, pos, row_number() over (partition by region_id order by placed_ref_id, pos, read_name) k
      from named g join (select * from a join spans using (rn)) s on s.placed_ref_id = g.ref_id and pos + span > g_beg or s.placed_ref_id > g.ref_id) select region_id, read_name, ref_id, pos from t where k = 1""",
    "sort_regions": f"with {REGIONS}, {REFS} select name, beg, fin, region_id, row_number() over (order by ref_id, beg, fin, region_id) - 1 as position from regions join refs using (name)",
    "fai_build": f"with {FASTA} select name, sum(len(bases))::bigint len, min_by(len(bases), line_no)::int line_blen, (min_by(len(bases), line_no) + 1)::int line_len from fa group by name",
    "fasta_size": f"with {A}, {FASTA}, s as (select name, sum(len(bases)) len from fa group by name) select name, coalesce(len, 255000000)::bigint as size from (select distinct 'doc' || l_partkey as name from a) left join s using (name)",
    "fasta_slice": f"""with {FASTA}, s as (select name, string_agg(bases, '' order by line_no) b from fa group by name),
      q as (select distinct l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000 site_id, first_value(l_partkey) over w lp, l_orderkey, first_value(l_suppkey) over w ls from lineitem window w as (partition by l_orderkey, l_linenumber, l_partkey % 100000 order by l_partkey, l_suppkey)),
      p as (select site_id, 'doc' || (lp % 1200) as name, (l_orderkey % 150)::int pos, (1 + ls % 40)::int n from q)
      select site_id, case when b is null then repeat('N', n) else lower(rpad(substr(b, (case when pos > len(b) then greatest(len(b) - 1, 0) else pos end)::int + 1, n), n, 'N')) end bases from p left join s using (name)""",
    "fai_offset": "with q as (select distinct l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000 site_id, l_orderkey % 150 p from lineitem) select site_id, 7 + (p // 60) * 61 + p % 60 as offset from q",
    "voffset_split": f"with {CORE} select read_name, bin_mq_nl >> 16 coffset, (bin_mq_nl & 65535)::int uoffset, bin_mq_nl voffset from core",
    "linear_index": f"""with {A}, {OPS}, w as (select placed_ref_id ref_id, pos, unnest(generate_series(pos >> 14, (greatest(pos + spec_span, pos + 1) - 1)::int >> 14)) w from a join spans using (rn) where placed_ref_id >= 0)
      select ref_id, w::int as window, min(pos) first_pos from w group by all""",
    "bai_stats": f"with {A}, {REFS} select r.ref_id, count(*) filter (flag & 4 = 0) n_mapped, count(*) filter (flag & 4 <> 0) n_unmapped from refs r left join a on placed_ref_id = r.ref_id group by all union all select -1, 0, count(*) from a where placed_ref_id < 0",
    "bam_roundtrip": f"""with {A}, {OPS}, {REFS} select read_name, flag, placed_ref_id ref_id, name ref_name, pos, mapq, {bin_case('pos', 'greatest(pos + spec_span, pos + 1)::int - 1')} bin, cigar, next_ref_id, next_pos, t_len, l_seq, {SEQ} seq, case when not no_qual then array_to_string({QUALS}, ',') end quals, {AUX} aux
      from a join spans using (rn) left join refs on refs.ref_id = placed_ref_id""",
    "bam_region_scan": f"with {A}, {OPS} select read_name, 'NATION_3' ref_name, pos from a join spans using (rn) where placed_ref_id = 3 and pos < 300000 and pos + greatest(spec_span, 1) > 100000",
    "bgzf_roundtrip": f"with {A} select read_name from a",
    "fasta_source": f"with {FASTA}, {FAI} select (row_number() over (order by name) - 1)::int fai_idx, name, len, start as offset, line_blen, line_len from fai",
    "fai_source": f"with {FASTA}, {FAI} select (row_number() over (order by name) - 1)::int fai_idx, name, len, start as offset, digest from fai",
    "idxstats": f"with {A} select placed_ref_id ref_id, count(*) filter (flag & 4 = 0) n_mapped, count(*) filter (flag & 4 <> 0) n_unmapped from a group by all",
    "file_references": f"with {REFS} select ref_id, name, length from refs",
    "file_header": "",
    "file_order": f"with {A} select read_name, placed_ref_id ref_id, row_number() over (partition by placed_ref_id order by pos, read_name)::int place from a where placed_ref_id >= 0",
}
ORACLES["file_header"] = ORACLES["header_dict"]

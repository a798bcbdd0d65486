"""Reference answers as DuckDB SQL over the driver tables, composed from shared common table expressions."""

from __future__ import annotations

from flowloom.schema import MODEL_FIELDS, RECORD_FIELDS, STAT_FIELDS
from flowloom.operators.dashboards import _SECONDS
from flowloom.sources.fixtures import GEO_RANGES, NESTED_RANGES, _address_value

PACKETS = """
e as (select event_id, user_id, value, (epoch_us(ts) - 1704067200000000) // 200 as t0, user_id % 40 as k,
        case when user_id % 3 = 0 then 17 else 6 end as proto from events),
x as (select *, unnest(range(0, 1 + (event_id % 6)))::bigint as i from e),
p as (select *, event_id*8 + i as num,
        1704067200000000 + t0 + i*(case when event_id % 13 = 0 then 0
             when event_id % 11 = 0 and i = 2 then -3000 else 40000*(1 + event_id % 7) end) as ts_us from x),
packets as (select num, ts_us,
  case when i%2=1 then '10.1.0.'||(k+1) else '10.0.'||(k%4)||'.'||(k+1) end as srcip,
  (case when i%2=0 then 1024+k when proto=17 then 53 else 443 end)::int as srcport,
  case when i%2=1 then '10.0.'||(k%4)||'.'||(k+1) else '10.1.0.'||(k+1) end as dstip,
  (case when i%2=1 then 1024+k when proto=17 then 53 else 443 end)::int as dstport,
  proto::int as proto, 20 as iphlen, (case when proto=17 then 8+floor(value)::int else 20 end) as prhlen,
  ((case when proto=6 then 40 else 28 end) + floor(value)::int)::int as len,
  (case when event_id%5=0 then 10 else 0 end)::int as dscp,
  (case when proto=17 then 0 when i=0 and event_id%17=0 then 4 when i=0 then 2 when i=1 then 18
       when i=2 then 16 when i=3 then 24 when i=4 and event_id%3=0 then 4 else 17 end)::int as flags
  from p)"""


def _segments(window: str) -> str:
    """Accepted packets with their flow.  States: 0 start, 1 syn, 2 syn-ack, 3 established, 4 fin, 5 closed."""
    return f"""
k as (select *, {window} as win, (case when dstip<srcip then dstip||':'||dstport||'|'||srcip||':'||srcport
        else srcip||':'||srcport||'|'||dstip||':'||dstport end) || '/' || proto || '@' || ({window}) as fk from packets),
n as (select *, row_number() over (partition by fk order by num) rn from k),
s0 as (select fk, rn, num, ts_us, true as acc, true as opened, srcip as fsrc, 'f' as dir, ts_us as last_us, 1 as seg,
   case when proto=17 then 0 when flags&4=4 then 5 when flags&1=1 then 4 when flags&2=2 then 1 else 0 end as c,
   case when proto=17 then 0 when flags&4=4 then 5 else 0 end as s, false as done, proto from n where rn=1),
rec as (
 select * from s0
 union all
 select fk, rn, num, ts_us, acc, opened, fsrc, dir, last_us, seg, c, s,
        acc and not opened and proto=6 and c=5 and s=5 as done, proto from (
  select y.fk, y.rn, y.num, y.ts_us, y.acc, y.opened, y.fsrc, y.dir, y.last_us, y.seg, y.proto,
   case when not y.acc or y.proto=17 then y.pc when y.flags&4=4 then 5 when y.flags&1=1 and y.dir='f' then 4
     when y.pc=0 and y.flags&2=2 and y.dir='f' then 1 when y.pc=1 and y.flags&18=18 and y.dir='b' then 2
     when y.pc=2 and y.flags&16=16 and y.dir='f' then 3 when y.pc=4 and y.flags&16=16 and y.dir='b' then 5 else y.pc end as c,
   case when not y.acc or y.proto=17 then y.ps when y.flags&4=4 then 5 when y.flags&1=1 and y.dir='b' then 4
     when y.ps=0 and y.flags&2=2 and y.dir='b' then 1 when y.ps=1 and y.flags&18=18 and y.dir='f' then 2
     when y.ps=2 and y.flags&16=16 and y.dir='b' then 3 when y.ps=4 and y.flags&16=16 and y.dir='f' then 5 else y.ps end as s
  from (select n.*, z.opened, (z.opened or n.ts_us>=r.last_us) as acc, case when z.opened then n.srcip else r.fsrc end as fsrc,
      case when z.opened or n.srcip=r.fsrc then 'f' else 'b' end as dir,
      case when z.opened then n.ts_us else greatest(n.ts_us,r.last_us) end as last_us,
      r.seg + z.opened::int as seg, case when z.opened then 0 else r.c end as pc, case when z.opened then 0 else r.s end as ps
    from rec r join n on n.fk=r.fk and n.rn=r.rn+1,
         lateral (select (r.done or n.ts_us-r.last_us>600000000) as opened) z) y)
),
a0 as (select n.*, r.seg, r.dir, r.done, r.opened,
         min(n.num) over (partition by r.fk, r.seg) as flow_start,
         coalesce(lag(r.c) over (partition by r.fk, r.seg order by r.num), 0) = 3 as ready,
         n.ts_us - lag(n.ts_us) over (partition by r.fk, r.seg order by r.num) as gap,
         max(r.seg) over (partition by r.fk) as segs
       from rec r join n on n.fk=r.fk and n.num=r.num where r.acc),
a1 as (select *, sum(case when gap>1000000 then 1 else 0 end) over (partition by fk, seg order by num) as sub from a0),
a2 as (select *, ts_us - lag(ts_us) over (partition by fk, seg, sub, dir order by num) as iat from a1),
a3 as (select *, max(case when iat=0 then num end) over (partition by fk, seg, dir) as zero_at from a2)"""


def _dev(sq: str, total: str, n: str) -> str:
    return (f"(case when {n}>1 then cast(floor(sqrt(cast(({sq} - ({total}*{total})//{n})//({n}-1) as double)))"
            " as bigint) else 0 end)")


def _flows(window: str = "0") -> str:
    parts = []
    for d in "fb":
        mine = f"filter (where dir='{d}')"
        parts.append(f"""
  count(*) {mine} as {d}n, coalesce(sum(len::hugeint) {mine},0) as {d}v, coalesce(sum(len::hugeint*len) {mine},0) as {d}q,
  coalesce(min(len) {mine},0) as min_{d}pktl, coalesce(max(len) {mine},0) as max_{d}pktl,
  count(iat) {mine} as {d}in, coalesce(sum(iat::hugeint) {mine},0) as {d}is,
  coalesce(sum(iat::hugeint*iat) {mine},0) as {d}iq, coalesce(max(iat) {mine},0) as max_{d}iat,
  coalesce(min(iat) filter (where dir='{d}' and iat>0 and num>coalesce(zero_at,-1)),0) as min_{d}iat,
  coalesce(sum(iphlen+prhlen) {mine},0) as total_{d}hlen,
  count(*) filter (where dir='{d}' and proto=6 and flags&8=8) as {d}psh_cnt,
  count(*) filter (where dir='{d}' and proto=6 and flags&32=32) as {d}urg_cnt""")
    finals = []
    for d, empty in (("f", "0"), ("b", "-1")):
        finals.append(f"""
  {d}n as total_{d}packets, {d}v as total_{d}volume, min_{d}pktl, case when {d}n>0 then {d}v//{d}n else {empty} end as mean_{d}pktl,
  max_{d}pktl, {_dev(f'{d}q', f'{d}v', f'{d}n')} as std_{d}pktl, min_{d}iat,
  case when {d}in>0 then {d}is//{d}in else 0 end as mean_{d}iat, max_{d}iat,
  {_dev(f'{d}iq', f'{d}is', f'{d}in')} as std_{d}iat, {d}n//subs as sflow_{d}packets, {d}v//subs as sflow_{d}bytes,
  total_{d}hlen, {d}psh_cnt, {d}urg_cnt""")
    casts = ", ".join(f"cast({f} as bigint) as {f}" for f in STAT_FIELDS)
    return f"""{_segments(window)},
sub0 as (select fk, seg, sub, (max(ts_us)-min(ts_us))::hugeint as span from a3 group by 1,2,3),
sub1 as (select *, max(case when span=0 then sub end) over (partition by fk, seg) as zero_sub from sub0),
subs as (select fk, seg, count(*) as subs, sum(span) as as_, sum(span*span) as aq, max(span) as max_active,
   coalesce(min(span) filter (where span>0 and sub>coalesce(zero_sub,-1)),0) as min_active from sub1 group by 1,2),
g0 as (select fk, seg, min(win) as win, min(flow_start) as flow_start, max(segs) as segs, min_by(srcip,num) as srcip, min_by(srcport,num) as srcport,
  min_by(dstip,num) as dstip, min_by(dstport,num) as dstport, min(proto) as proto, min(ts_us) as start_us, max(ts_us) as last_us,
  bool_or(done) as closed, bool_or(ready and len>iphlen+prhlen) as tcp_valid, min_by(dscp,num) as dscp0,
  coalesce(min_by(dscp,num) filter (where dir='b' and iat is null and dscp<>0),0) as dscp1,
  count(*) filter (where gap>1000000) as idn, coalesce(sum(gap::hugeint) filter (where gap>1000000),0) as ids,
  coalesce(sum(gap::hugeint*gap) filter (where gap>1000000),0) as idq,
  coalesce(max(gap) filter (where gap>1000000),0) as max_idle, coalesce(min(gap) filter (where gap>1000000),0) as min_idle,
  {",".join(parts)}
  from a3 group by fk, seg),
g1 as (select g0.*, subs, as_, aq, max_active, min_active from g0 join subs using (fk, seg)),
g2 as (select win, srcip, srcport, dstip, dstport, proto, {",".join(finals)},
  last_us-start_us as duration, min_active, as_//subs as mean_active, max_active, {_dev('aq', 'as_', 'subs')} as std_active,
  min_idle, case when idn>0 then ids//idn else 0 end as mean_idle, max_idle, {_dev('idq', 'ids', 'idn')} as std_idle,
  (case when dscp0<>0 then dscp0 else dscp1 end)::int as dscp, flow_start, start_us, last_us, subs as bursts,
  case when closed then 'closed' when seg<segs then 'timed_out' else 'open' end as status,
  case when proto=17 then bn>0 else tcp_valid end as is_valid from g1),
flows as (select win, srcip, srcport, dstip, dstport, proto, {casts}, dscp, flow_start, start_us, last_us, bursts,
  status, is_valid from g2)"""


def _ip(column: str) -> str:
    parts = [f"split_part({column},'.',{i})::bigint" for i in range(1, 5)]
    return f"({parts[0]}*16777216+{parts[1]}*65536+{parts[2]}*256+{parts[3]})"


GEO = "ranges(ip_from, ip_to, lat, lon) as (values " + ", ".join(
    f"({_address_value(a)}::bigint,{_address_value(b)}::bigint,{lat}::double,{lon}::double)"
    for a, b, lat, lon in GEO_RANGES) + ")"

SCORED = f"""{GEO},
scored as (select flows.*, coalesce(rs.lat,48.0) as src_lat, coalesce(rs.lon,22.0) as src_lon,
   coalesce(rd.lat,48.0) as dst_lat, coalesce(rd.lon,22.0) as dst_lon,
   case when (proto=6 and total_bpackets=0) or furg_cnt>0 or total_fvolume>5000 then 1.0::double else 0.0::double end as predict
   from flows left join ranges rs on {_ip('srcip')} between rs.ip_from and rs.ip_to
   left join ranges rd on {_ip('dstip')} between rd.ip_from and rd.ip_to)"""

_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _cell(lat: str, lon: str) -> str:
    x = f"least(floor(({lon}+180)/360*32)::int,31)"
    y = f"least(floor(({lat}+90)/180*32)::int,31)"
    def b(v, i):
        return f"(({v}>>{i})&1)"
    high = f"({b(x,4)}*16+{b(y,4)}*8+{b(x,3)}*4+{b(y,3)}*2+{b(x,2)})"
    low = f"({b(y,2)}*16+{b(x,1)}*8+{b(y,1)}*4+{b(x,0)}*2+{b(y,0)})"
    return f"substr('{_ALPHABET}',{high}+1,1)||substr('{_ALPHABET}',{low}+1,1)"


def with_flows(select: str, window: str = "0") -> str:
    return f"with recursive {PACKETS},{_flows(window)} {select}"


def with_scored(select: str) -> str:
    return f"with recursive {PACKETS},{_flows()},{SCORED} {select}"


def with_packets(select: str) -> str:
    return f"with {PACKETS} {select}"


_FLOW_COLUMNS = ", ".join([*RECORD_FIELDS, "flow_start", "start_us", "last_us", "bursts", "status",
                           "is_valid::int as is_valid"])
_PACKET_COLUMNS = "num, ts_us, srcip, srcport, dstip, dstport, proto, iphlen, prhlen, len, dscp, flags"
_DECODED = _PACKET_COLUMNS.replace(
    "ts_us", "cast(trunc((ts_us/1000000.0::double)*1000000) as bigint) as ts_us")


def _hour(seconds: int) -> str:
    return f"(start_us // {seconds * 1000000}) * {seconds}"


def _map(lat: str, lon: str, measure: str, where: str) -> str:
    return with_scored(f"select {_cell(lat, lon)} as cell, {measure}, round(avg({lat}),6) as lat, "
                       f"round(avg({lon}),6) as lon from scored {where} group by 1")


def _top(column: str) -> str:
    return with_scored(f"select {column}, count(*) as flows from scored group by 1 order by 2 desc, 1 limit 10")


def _long(table: str, key: str, features: list[str]) -> str:
    cells = ", ".join(f"({i}, {f}::double)" for i, f in enumerate(features))
    return f"cells as (select {key} as row_key, u.i, u.v from {table}, lateral (values {cells}) u(i, v))"


_MATRIX = """
pairs as (select a.i, b.i as j, case when a.i=b.i then 1.0 else coalesce(case when isnan(corr(a.v,b.v)) then 0 else corr(a.v,b.v) end,0) end as corr
  from cells a join cells b using (row_key) group by a.i, b.i),
spread as (select i, var_samp(v) as variance from cells group by i),
related as (select i, sum(abs(corr)) as corr_sum from pairs group by i),
weights as (select i as idx, variance/corr_sum as weight, corr_sum from related join spread using (i))"""

_FLOW_CELLS = _long("flows", "flow_start", MODEL_FIELDS)
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# lineitem has no single key and is large: pairs come from one pass instead of a self-join
_LINE_PAIRS = "pairs as (" + " union all ".join(
    f"select {i} as i, {j} as j, " + ("max(1.0::double)" if i == j else f"corr({a},{b})") + " as corr from lineitem"
    for i, a in enumerate(LINE_FEATURES) for j, b in enumerate(LINE_FEATURES)) + ")"
_LINE_WEIGHTS = (_LINE_PAIRS + ", spread as (" + " union all ".join(
    f"select {i} as i, var_samp({a}) as variance from lineitem" for i, a in enumerate(LINE_FEATURES)) + """),
related as (select i, sum(abs(corr)) as corr_sum from pairs group by i),
weights as (select i as idx, variance/corr_sum as weight, corr_sum from related join spread using (i))""")

_NAME_OF = "case idx " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(MODEL_FIELDS)) + " end"
_PREDICTIONS = "pr as (select quality::double as label, (1-toxic)::double as prediction from labels)"
_COUNTS = _PREDICTIONS + """, l as (select unnest([0.0::double,1.0::double]) as label),
 m as (select l.label, count(*) filter (where pr.label=l.label) as actual, count(*) filter (where prediction=l.label) as predicted,
  count(*) filter (where pr.label=l.label and prediction=l.label) as hit, count(*) as total from l, pr group by 1),
 cm as (select label, actual, predicted, hit/nullif(predicted,0)::double as precision, hit/nullif(actual,0)::double as recall,
  (predicted-hit)/nullif(total-actual,0)::double as fpr, 2*hit/nullif(predicted+actual,0)::double as f1 from m where actual+predicted>0)"""

_VARIED = """varied as (select num, ts_us, srcip, srcport, dstip, dstport, len, iphlen, dscp, flags + (case when num%7=0 then 64 when num%11=0 then 128 else 0 end) as flags8,
  case when num%19=0 then 1 else proto end as proto8, 32+num%96 as ttl, case when num%5=0 then 1 else 0 end as df,
  case when num%23=0 then 1 else 0 end as mf, case when num%23=0 then num%100 else 0 end as fo, num%9 as it, num%4 as ic,
  cast(trunc((ts_us/1000000.0::double)*1000000) as bigint) as t from packets)"""


def _traffic(source: str) -> str:
    tcp, udp, icmp = "proto8=6", "proto8=17", "proto8=1"
    def flag(bit):
        return f"count(*) filter (where {tcp} and flags8&{bit}={bit})"
    return f"""select window_start, srcip, dstip, count(*) filter (where {tcp}) as tcp_packets,
 count(*) filter (where {udp}) as udp_packets, count(*) filter (where {icmp}) as icmp_packets, count(*) as ip_packets,
 count(distinct case when not {icmp} then srcport end) as src_ports, count(distinct case when not {icmp} then dstport end) as dst_ports,
 {flag(1)} as fin_flags, {flag(2)} as syn_flags, {flag(8)} as psh_flags, {flag(16)} as ack_flags, {flag(32)} as urg_flags,
 {flag(4)} as rst_flags, {flag(64)} as ece_flags, {flag(128)} as cwr_flags, count(distinct dscp*4) as tos_values,
 round(avg(ttl),6) as mean_ttl, round(avg(iphlen),6) as mean_header_len, round(avg(len),6) as mean_packet_len,
 cast(sum(df) as bigint) as dont_fragment, cast(sum(mf) as bigint) as more_fragments, round(avg(fo),6) as mean_fragment_offset,
 round(avg(case when {tcp} then 5 end),6) as mean_data_offset,
 count(distinct case when {icmp} then it end) as icmp_types, count(distinct case when {icmp} then ic end) as icmp_codes
 from {source} group by 1,2,3"""


_ANCHORED = """rn as (select num, t, row_number() over (order by num) as rn from varied),
 later as (select num, t, rn, max(t) over (order by num rows between unbounded preceding and 1 preceding) as before from rn),
 cand as materialized (select num, t, row_number() over (order by num) as cn from later where before is null or t>before),
 nxt as materialized (select a.cn, b.cn as ncn from cand a asof left join cand b on a.t+2000000 < b.t),
 ch as (select cn from cand where cn=1 union all select ncn from ch join nxt using (cn) where ncn is not null),
 st as (select num as snum, t as window_start from ch join cand using (cn)),
 placed as (select varied.*, st.window_start from varied asof join st on varied.num >= st.snum)"""

_REGR = """s as (select (start_us//86400000000)*86400 as bucket, sum(total_fpackets)::bigint as fpackets, sum(total_bpackets)::bigint as bpackets from scored group by 1),
 f as (select case when count(*)>1 then regr_slope(fpackets,bucket) end as fm, case when count(*)>1 then regr_slope(bpackets,bucket) end as bm, avg(fpackets) as fy, avg(bpackets) as b_y, avg(bucket) as mx from s)"""


def _hexed(value: str, width: int) -> str:
    return f"lpad(to_hex(({value})::bigint), {width * 2}, '0')"


def _hex_address(ip: str) -> str:
    return " || ".join(_hexed(f"split_part({ip}, '.', {i})", 1) for i in range(1, 5))


_FRAME = " || ".join([
    "'" + "00" * 12 + "0800'", _hexed("64 + iphlen // 4", 1), _hexed("dscp * 4", 1), _hexed("len", 2), "'00000000'", "'40'",
    _hexed("proto", 1), "'0000'", _hex_address("srcip"), _hex_address("dstip"), _hexed("srcport", 2), _hexed("dstport", 2),
    f"case when proto = 6 then '{'00' * 8}' || {_hexed('prhlen * 4', 1)} || {_hexed('flags', 1)} || '{'00' * 6}' "
    f"else {_hexed('prhlen', 2)} || '0000' end"])

_NESTED = "nested(ip_from, ip_to, lat) as (values " + ", ".join(
    f"({_address_value(a)}::bigint,{_address_value(b)}::bigint,{lat}::double)" for a, b, lat, _ in NESTED_RANGES) + ")"


def _narrowest(ip: str) -> str:
    return (f"coalesce((select lat from nested where {_ip(ip)} between ip_from and ip_to "
            "order by ip_to - ip_from, ip_from desc limit 1), 48.0)")


def _listed(panel: str, column: str) -> str:
    return (f"select '{panel}' as panel, {column}::varchar as term, null::bigint as bucket, n::double as value from "
            f"(select {column}, count(*) as n from scored group by 1 order by 2 desc, 1 limit 10)")


def _located(panel: str, lat: str, lon: str) -> str:
    return (f"select '{panel}', {_cell(lat, lon)}, null, count(*), null, round(avg({lat}),6), round(avg({lon}),6) "
            "from scored where predict=1 group by 2")


_OVERVIEW = f"""select panel, term, bucket, value, null::double as second, null::double as lat, null::double as lon
    from ({_listed("dst_ip", "dstip")} union all {_listed("dst_port", "dstport")})
  union all {_located("destinations", "dst_lat", "dst_lon")} union all {_located("sources", "src_lat", "src_lon")}
  union all select 'threats', null, null, sum(predict), null, null, null from scored
  union all select 'packet_series', null, {_hour(3600)} as b, round(avg(total_fpackets),6), round(avg(total_bpackets),6), null, null
    from scored group by {_hour(3600)}"""


def _auto(span: str, where: str) -> str:
    step = "case " + " ".join(f"when hi - lo <= 50*{n} then {n}" for n in _SECONDS[:-1]) + f" else {_SECONDS[-1]} end"
    rows = f"(select *, start_us // 1000000 as sec from scored, (select min(start_us) as least from scored) where {where})"
    return f"""select '{span}' as span, step::bigint as step, sec - sec % step as bucket, count(*) filter (where predict=1) as attacks,
      count(*) filter (where predict=0) as normal, sum(total_bvolume)::bigint as rx_bytes, sum(total_fvolume)::bigint as tx_bytes
      from {rows} r, (select {step} as step from (select min(sec) as lo, max(sec) as hi from {rows})) t group by 1, 2, 3"""


# the last packet comes 605 s after the others and the watermark stays 600 s behind it; what has been silent for longer
# than the timeout by then has ended
_AFTER_WATERMARK = """select * replace (case when status='open'
    and last_us//1000 + 600001 < (select max(ts_us)//1000 from packets) + 5000 then 'timed_out' else status end as status) from flows"""
_STORED = "start_us >= epoch_us(timestamp '2024-01-01 00:00:00') and start_us < epoch_us(timestamp '2024-01-01 02:00:00')"
_TESTED = "('0x' || substr(md5(concat_ws('|', srcip, srcport, dstip, dstport, flow_start)), 1, 8))::bigint % 10 >= 7"


def oracle_sql() -> dict[str, str]:
    flows = f"select {_FLOW_COLUMNS} from flows"
    q = {
        "packets_canonical": with_packets("""select num, case when dstip<srcip then dstip else srcip end as ip_a,
            case when dstip<srcip then dstport else srcport end as port_a, case when dstip<srcip then srcip else dstip end as ip_b,
            case when dstip<srcip then srcport else dstport end as port_b, proto, (dstip<srcip)::int as side from packets"""),
        "packet_flags": with_packets("""select flags, (flags&1=1)::int as fin, (flags&2=2)::int as syn, (flags&4=4)::int as rst,
            (flags&8=8)::int as psh, (flags&16=16)::int as ack, (flags&32=32)::int as urg, count(*) as packets from packets where proto=6 group by 1"""),
        "decode_frames": with_packets(f"select {_DECODED} from packets"),
        "decode_encapsulated": with_packets(f"select {_DECODED} from packets"),
        "short_frames": with_packets("""select num, 'short_ip_header' as reason from packets where num%10=3"""),
        "segment_packets": f"with recursive {PACKETS},{_segments('0')} select num, flow_start, dir, gap, iat, sub::bigint as burst_no, done::int as closes from a3",
        "flows_udp": with_flows(flows + " where proto=17"),
        "flows_udp_hot": with_flows(flows + " where proto=17"),
        "flows_all": with_flows(flows),
        "flows_hot_keys": with_flows(flows),
        "flows_clock_jump": with_flows(flows).replace("select num, ts_us,", "select num, ts_us + case when num % 1688 = 800 then 3600000000 else 0 end as ts_us,", 1),
        "flows_many_keys": with_flows(flows).replace("1024+k", "1024+user_id%40000"),
        "flows_urgent": with_flows(flows).replace("end)::int as flags", "end + case when proto=6 and num%9=0 then 32 else 0 end)::int as flags", 1),
        "decode_unwanted": with_packets("select * from packets where num % 10 not in (3, 5, 7, 9)"),
        "wire_accepted": with_flows(f"select flow_start, {', '.join(RECORD_FIELDS)} from flows where flow_start % 17 not in (3, 7, 11, 13)"),
        "wire_rejects": with_flows(f""", m as (select flow_start, proto, concat_ws(',', {', '.join(RECORD_FIELDS)}) as line from flows)
            select flow_start, proto, case flow_start % 17 when 3 then '"' || substr(line, 1, 39) || '"' when 7 then '"x,9' || line || ',live,9"'
                when 11 then line || ',live' else '"' || line || ',"' end as raw,
              case flow_start % 17 when 3 then 'fields' when 7 then 'fields' when 11 then 'no text in quotes' else 'no class' end as reason
            from m where flow_start % 17 in (3, 7, 11, 13)"""),
        "scored_replayed": with_scored("select flow_start, srcip, dstip, predict, start_us//1000 + 86400000 as timestamp_ms from scored"),
        "dash_stored_dst_ip": with_scored(f"select dstip, count(*) as flows from scored where {_STORED} group by 1 order by flows desc, dstip limit 10"),
        "dash_stored_threats": with_scored(f"select sum(predict) as threats from scored where {_STORED}"),
        "offline_metrics": with_flows(f"select 1.0::double as accuracy, 1.0::double as precision, 1.0::double as recall, 1.0::double as f_measure, 0.0::double as test_error, count(*) as \"rows\" from flows where {_TESTED}"),
        "dt_described_rules": with_flows("""select proto, (dscp=0)::int as no_dscp, count(*) as flows,
            case when proto=6 and dscp=0 then 1.0::double else 0.0::double end as predicted, 5::int as nodes, 2::int as depth, '0,1' as indices
            from flows group by 1, 2, 4"""),
        "dt_rules_agree": with_flows(f"select case when total_bpackets>0 then 0.0::double else 1.0::double end as label, count(*) as flows, 0::bigint as mismatches from flows where {_TESTED} group by 1"),
        "stream_score_model": with_flows("""select case when proto=6 and dscp=0 then 1.0::double else 0.0::double end as predict, count(*) as flows, sum(duration)::bigint as duration,
            (select count(*) from flows where flow_start % 17 in (3, 7, 11, 13)) as rejected from flows where flow_start % 17 not in (3, 7, 11, 13) group by 1"""),
        "flow_valid": with_flows(flows + " where is_valid"),
        "flow_open": with_flows(flows + " where status='open'"),
        "flow_expire_idle": with_flows("""select flow_start, srcip, dstip, last_us from flows, (select max(ts_us) as now from packets) t
            where status='open' and now-last_us>600000000"""),
        "flow_status_counts": with_flows("select status, is_valid::int as is_valid, count(*) as flows from flows group by 1,2"),
        "flow_windowed_2s": with_flows("select win as capture_window, " + _FLOW_COLUMNS + " from flows", "ts_us//2000000"),
        "traffic_windows_aligned": with_packets(f", {_VARIED}, placed as (select *, t - t%2000000 as window_start from varied) {_traffic('placed')}"),
        "traffic_windows_anchored": f"with recursive {PACKETS}, {_VARIED}, {_ANCHORED} {_traffic('placed')}",
        "wire_encode": with_flows("""select flow_start, '"'||concat_ws(',',""" + ",".join(RECORD_FIELDS) + """,'live')||'"' as value from flows"""),
        "wire_roundtrip": with_flows("select " + ", ".join(RECORD_FIELDS) + ", 'live' as class from flows"),
        "flows_written": with_flows("select " + ", ".join(RECORD_FIELDS) + ", 'live' as class from flows"),
        "relay_lines": with_flows("""select '"'||concat_ws(',',""" + ",".join(RECORD_FIELDS) + """,'live')||'"' as value from flows"""),
        "relay_growing": with_flows("""select '"'||concat_ws(',',""" + ",".join(RECORD_FIELDS) + """,'live')||'"' as value from flows"""),
        "labels_binary": "select doc_id, case when quality::varchar='0' then 0.0::double else 1.0::double end as label from labels",
        "split_key": with_flows(f", {_FLOW_CELLS} select srcip, srcport, dstip, dstport, flow_start, i as idx, v as value from cells join flows on row_key=flow_start"),
        "named_features": with_flows("select flow_start, unnest([" + ",".join(f"'{f}'" for f in RECORD_FIELDS[:44]) + "]) as name, unnest(["
                                     + ",".join(f"{f}::varchar" for f in RECORD_FIELDS[:44]) + "]) as value from flows"),
        "reduce_features": with_flows("select srcip, srcport, dstip, dstport, dscp, proto, duration from flows"),
        "drop_features": with_flows("select " + ", ".join(f for f in RECORD_FIELDS if f not in (MODEL_FIELDS[0], MODEL_FIELDS[3])) + " from flows"),
        "class_appended": with_flows("select flow_start, 'live' as class from flows"),
        "to_float": with_flows("select flow_start, " + ", ".join(f"{f}::double as {f}" for f in MODEL_FIELDS) + " from flows"),
        "to_text": with_flows("select flow_start, " + ", ".join(f"{f}::varchar as {f}" for f in MODEL_FIELDS) + " from flows"),
        "labelled_points": with_flows(f", {_FLOW_CELLS} select flow_start, case when total_bpackets>0 then 0.0::double else 1.0::double end as label, i as idx, v as value from cells join flows on row_key=flow_start"),
        "corr_pairs": with_flows(f", {_FLOW_CELLS}, {_MATRIX} select i, j, round(corr,6)+0.0 as corr from pairs"),
        "feature_variance": with_flows(f", {_FLOW_CELLS}, {_MATRIX} select i, (case when variance>0 then floor(log10(variance)) else 0 end)::int as variance_power, round(variance/pow(10.0::double, case when variance>0 then floor(log10(variance)) else 0 end),5) as variance_digits from spread"),
        "feature_weights": with_flows(f", {_FLOW_CELLS}, {_MATRIX} select idx, {_NAME_OF} as name, (case when weight>0 then floor(log10(weight)) else 0 end)::int as weight_power, round(weight/pow(10.0::double, case when weight>0 then floor(log10(weight)) else 0 end),5) as weight_digits from weights"),
        "feature_weights_corr_sum": with_flows(f", {_FLOW_CELLS}, {_MATRIX} select idx, {_NAME_OF} as name, round(corr_sum,6) as weight from weights"),
        "feature_topk": with_flows(f", {_FLOW_CELLS}, {_MATRIX} select idx, {_NAME_OF} as name from weights order by weight desc, idx desc limit 6"),
        "corr_pairs_lineitem": f"with {_LINE_PAIRS} select i, j, round(corr,6)+0.0 as corr from pairs",
        "feature_topk_lineitem": f"with {_LINE_WEIGHTS} select idx, (case when weight>0 then floor(log10(weight)) else 0 end)::int as weight_power, round(weight/pow(10.0::double, case when weight>0 then floor(log10(weight)) else 0 end),5) as weight_digits from weights order by weight desc, idx desc limit 3",
        "geo_enrich": with_scored("select flow_start, srcip, dstip, src_lat, src_lon, dst_lat, dst_lon from scored"),
        "geo_nested": with_flows(f", {_NESTED} select flow_start, srcip, dstip, {_narrowest('srcip')} as src_lat, {_narrowest('dstip')} as dst_lat from flows"),
        "capture_frames": with_packets("""select (num % 3)::int as part, row_number() over (partition by num % 3 order by num) as record, ts_us,
            (case when proto = 6 then 54 else 42 end)::int as length, md5(unhex(FRAME)) as digest from packets""".replace("FRAME", _FRAME)),
        "scored_manifest": with_scored("select srcip, srcport, dstip, dstport, duration, predict, (date '2024-01-01' + ((duration % 86400000000 * 2) // 86400000000)::int)::varchar as day from scored"),
        "dash_composed": with_scored(_OVERVIEW),
        "dash_auto_series": with_scored(_auto("all", "true") + " union all " + _auto("short", "start_us < least + 900000000")),
        "stream_model_switch": with_flows("""select (flow_start % 2 + 1)::int as model_version, case when (proto=6 and dscp=0) = (flow_start % 2 = 0) then 1.0::double else 0.0::double end as predict,
            count(*) as flows, sum(duration)::bigint as duration from flows group by 1, 2"""),
        "scored_flows": with_scored("select flow_start, srcip, dstip, total_fvolume, dst_lat, dst_lon, predict, start_us//1000 as timestamp_ms from scored"),
        "scored_written": with_scored("select flow_start, srcip, dstip, predict, start_us//1000 as timestamp_ms from scored"),
        "confusion_matrix": f"with {_PREDICTIONS} select label, count(*) filter (where prediction=0) as predicted_0, count(*) filter (where prediction=1) as predicted_1 from pr group by 1",
        "overall_metrics": f"""with {_PREDICTIONS}, a as (select avg((label=prediction)::int::double) as acc, count(*) as n from pr)
            select round(acc,6) as accuracy, round(acc,6) as precision, round(acc,6) as recall, round(acc,6) as f_measure, round(1-acc,6) as test_error, n as "rows" from a""",
        "class_metrics": f"with {_COUNTS} select label, actual, predicted, round(precision,6) as precision, round(recall,6) as recall, round(fpr,6) as false_positive_rate, round(f1,6) as f1 from cm",
        "weighted_metrics": f"""with {_COUNTS} select round(sum(coalesce(precision,0)*actual)/sum(actual),6) as weighted_precision, round(sum(coalesce(recall,0)*actual)/sum(actual),6) as weighted_recall,
            round(sum(coalesce(f1,0)*actual)/sum(actual),6) as weighted_f1, round(sum(coalesce(fpr,0)*actual)/sum(actual),6) as weighted_false_positive_rate from cm""",
        "test_error": f"with {_PREDICTIONS} select round(avg((label<>prediction)::int::double),6) as test_error from pr",
        "dash_analyzed_flows": with_scored("select count(*) as flows from scored"),
        "dash_attack_vs_normal": with_scored(f"select {_hour(3600)} as bucket, count(*) filter (where predict=1) as attacks, count(*) filter (where predict=0) as normal from scored group by 1"),
        "dash_destination_map": _map("dst_lat", "dst_lon", "count(*) as flows", "where predict=1"),
        "dash_dst_ip": _top("dstip"),
        "dash_dst_port": _top("dstport"),
        "dash_packet_series": with_scored(f"select {_hour(3600)} as bucket, round(avg(total_fpackets),6) as avg_fpackets, round(avg(total_bpackets),6) as avg_bpackets from scored group by 1"),
        "dash_packet_trend": with_scored(f", {_REGR} select bucket, fpackets, bpackets, round(coalesce(fy+fm*(bucket-mx),fy),6) as fpackets_trend, round(coalesce(b_y+bm*(bucket-mx),b_y),6) as bpackets_trend from s, f"),
        "dash_received_bytes": _map("dst_lat", "dst_lon", "sum(total_bvolume)::bigint as received_bytes", ""),
        "dash_sources": _map("src_lat", "src_lon", "count(*) as flows", "where predict=1"),
        "dash_threats": with_scored("select sum(predict) as threats from scored"),
        "dash_traffic_series": with_scored(f"select {_hour(3600)} as bucket, sum(total_bvolume)::bigint as rx_bytes, sum(total_fvolume)::bigint as tx_bytes from scored group by 1"),
        "dash_filter_attacks": with_scored("select flow_start, srcip, dstip from scored where predict=1"),
        "blocklist": with_scored("select distinct srcip, dstip from scored where predict<>0"),
        "stream_score": with_scored("select srcip, srcport, dstip, dstport, duration, total_fvolume, predict, dst_lat, dst_lon from scored"),
        "stream_flows": with_flows(f"select {_FLOW_COLUMNS} from ({_AFTER_WATERMARK}) flows"),
        "stream_flows_ended": with_flows(f"select {_FLOW_COLUMNS} from ({_AFTER_WATERMARK}) flows where status <> 'open'"),
        "stream_late_rows": with_packets("""select num, ts_us, len, (num % 50 = 7 and ts_us < first + (last - first)//2)::int as late
            from packets, (select min(ts_us) as first, max(ts_us) as last from packets)"""),
        "stream_windowed_counts": with_scored(""", w as (select max(start_us)//1000 - 600000 as last, min(start_us) + (max(start_us) - min(start_us))//2 as middle from scored)
            select (start_us//60000000)*60 as bucket, count(*) filter (where predict=1) as attacks, count(*) filter (where predict=0) as normal,
            sum(total_fpackets)::bigint as fpackets, sum(total_bpackets)::bigint as bpackets, sum(total_bvolume)::bigint as rx_bytes, sum(total_fvolume)::bigint as tx_bytes
            from scored, w where not (flow_start % 50 = 7 and start_us < middle) and (start_us//60000000)*60000 + 60000 <= last group by 1"""),
    }
    return q

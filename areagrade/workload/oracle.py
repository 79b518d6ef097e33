"""For each query, a plain SQL statement over the same tables (DuckDB dialect).

Written from the meaning of the operators, not from their plans: no
pre-aggregation, totals by subquery, ranks by window.
"""

from __future__ import annotations

from areagrade.schemas import (
    CASUALTY_COLUMNS,
    FACTOR_COLUMNS,
    RATE_COLUMNS,
    RATED_NAMES,
    SCORECARD_NAMES,
    SUMMARY_NAMES,
    VEHICLE_COLUMNS,
)

AREA = "lpad(cast({} as varchar), 5, '0')"

INC = f"""
inc as (
  select {AREA.format('s_nationkey')} as area, l_returnflag = 'R' as injured,
         l_returnflag = 'R' and l_discount >= 0.09 as killed,
         case when l_linestatus = 'F' then 'p' when l_linenumber <= 3 then 'c' else 'm' end as grp,
         p_type, p_brand, o_orderpriority, l_returnflag, nullif(l_linestatus, 'O') as status
  from lineitem
  join supplier on l_suppkey = s_suppkey
  join part on l_partkey = p_partkey
  join orders on l_orderkey = o_orderkey
)"""

INC_SUMS = """
inc_sums as (
  select area, count(*) as incidents,
         cast(sum((p_type is not null)::int + (p_brand is not null)::int) as bigint) as vehicles,
         count(*) filter (injured) as persons_injured,
         count(*) filter (killed) as persons_killed,
         count(*) filter (injured and grp = 'p') as pedestrians_injured,
         count(*) filter (killed and grp = 'p') as pedestrians_killed,
         count(*) filter (injured and grp = 'c') as cyclists_injured,
         count(*) filter (killed and grp = 'c') as cyclists_killed,
         count(*) filter (injured and grp = 'm') as motorists_injured,
         count(*) filter (killed and grp = 'm') as motorists_killed
  from inc group by area
)"""

TYPES = """
types as (
  select area, category, count(*) as n
  from (select area, p_type as category from inc union all select area, p_brand from inc)
  where trim(category) <> '' group by area, category
)"""

FACTORS = """
factors as (
  select area, category, count(*) as n
  from (select area, o_orderpriority as category from inc union all select area, l_returnflag from inc
        union all select area, status from inc)
  where trim(category) <> '' group by area, category
)"""

REQ = f"""
req as (
  select {AREA.format('c_nationkey')} as area, event_type as category, props as descriptor, c_mktsegment as city
  from events join customer on user_id = c_custkey
)"""

EXP = f"""
expo as (
  select {AREA.format('c_nationkey')} as area,
         cast(floor(sum(cast(o_totalprice as decimal(18, 2))) / count(*)) as bigint) * 731 as exposure
  from orders join customer on o_custkey = c_custkey group by 1
)"""

PERSONS = ("persons_injured", "persons_killed")
CASUALTIES = {
    "persons_injured": ("pedestrians_injured", "cyclists_injured", "motorists_injured"),
    "persons_killed": ("pedestrians_killed", "cyclists_killed", "motorists_killed"),
}


def _with(*parts: str) -> str:
    return "with " + ",".join(parts)


def _pct(part: str, total: str) -> str:
    return f"case when {total} = 0 then 0.0 else cast({part} as double) / {total} * 100 end"


def _count_label(part: str, total: str) -> str:
    return f"{part} || ': ' || cast(round({_pct(part, total)}, 0) as varchar) || '%'"


def _tier(found: str, three_only: bool = False) -> str:
    five = "" if three_only else f"when {found} >= 5 then 5 "
    return f"case {five}when {found} >= 3 then 3 when {found} >= 1 then 1 else 0 end"


def _slots(name: str, source: str, total_table: str, total: str, kind: str, size: int, where: str = "true") -> str:
    """A CTE with one label column per slot, one row for every area of ``total_table``."""
    label = f"category || ': ' || n || ': ' || cast(round({_pct('n', total)}, 2) as varchar) || '%'"
    columns = ", ".join(
        f"coalesce(max(case when r = {i} and r <= tier then label end), '') as {kind}_{i}" for i in range(1, size + 1)
    )
    return f"""
{name} as (
  select t.area, {columns}
  from {total_table} t left join (
    select area, r, {_tier('found', size == 3)} as tier, label from (
      select f.area, row_number() over (partition by f.area order by n desc, category) as r,
             count(*) over (partition by f.area) as found, {label} as label
      from {source} f join {total_table} using (area) where {where})
  ) x on x.area = t.area
  group by t.area
)"""


CASUALTY_PCTS = ", ".join(
    f"{_pct(part, total)} as {part}_pct, {_count_label(part, total)} as {part}_label"
    for total, parts in CASUALTIES.items()
    for part in parts
)
CASUALTY_LABELS = ", ".join(
    f"{_count_label(part, total)} as {part}_label" for total, parts in CASUALTIES.items() for part in parts
)
NOT_IGNORED = "category not in ('UNKNOWN', 'Unspecified')"

INCIDENT_STATS = [
    INC,
    INC_SUMS,
    TYPES,
    FACTORS,
    _slots("top_factors", "factors", "inc_sums", "vehicles", "factor", 5, NOT_IGNORED),
    _slots("top_types", "types", "inc_sums", "vehicles", "vehicle", 5, NOT_IGNORED),
    f"""
inc_stats as (
  select area, incidents, vehicles, persons_injured as injured, persons_killed as killed, {CASUALTY_LABELS},
         {", ".join(f"factor_{i}" for i in range(1, 6))}, {", ".join(f"vehicle_{i}" for i in range(1, 6))}
  from inc_sums join top_factors using (area) join top_types using (area)
)""",
]

REQUEST_STATS = [
    REQ,
    "req_sums as (select area, count(*) as requests from req group by area)",
    "complaints as (select area, category, count(*) as n from req where trim(category) <> '' group by all)",
    "descriptors as (select area, descriptor as category, count(*) as n from req"
    " where trim(descriptor) <> '' group by all)",
    _slots("top_complaints", "complaints", "req_sums", "requests", "complaint", 3),
    _slots("top_descriptors", "descriptors", "req_sums", "requests", "descriptor", 5),
    """
cities as (
  select area, city from (
    select area, city, row_number() over (partition by area order by count(*) desc, city) as r
    from req group by area, city) where r = 1
)""",
    f"""
req_stats as (
  select area, requests, {", ".join(f"complaint_{i}" for i in range(1, 4))},
         {", ".join(f"descriptor_{i}" for i in range(1, 6))}, city
  from req_sums join top_complaints using (area) join top_descriptors using (area) join cities using (area)
)""",
]

RATE_SQL = """
round(cast(incidents as double) / exposure * 1000000, 2) as incident_rate,
round(cast(injured as double) / incidents * 1000, 2) as injury_rate,
round(cast(killed as double) / incidents * 1000, 2) as death_rate,
round(cast(vehicles as double) / incidents, 2) as vehicles_per_incident"""

RATES = [
    INC,
    INC_SUMS,
    REQ,
    EXP,
    f"""
rates as (
  select *, {RATE_SQL} from (
    select area, exposure, incidents, vehicles, persons_injured as injured, persons_killed as killed, requests
    from expo join inc_sums using (area) join (select area, count(*) as requests from req group by area) using (area))
)""",
]


def _bounds(source: str) -> str:
    lines = []
    for metric in RATE_COLUMNS:
        mean, dev = f"round(avg({metric}), 4)", f"round(stddev_samp({metric}), 4)"
        lines.append(
            f"select '{metric}' as metric, {mean} as mean, {dev} as stddev from {source}"
        )
    return "stats as (" + " union all ".join(lines) + ")"


def _cutoffs() -> str:
    columns = []
    for short, metric in (("a", "incident_rate"), ("i", "injury_rate"), ("d", "death_rate")):
        columns.append(f"max(case when metric = '{metric}' then round(mean + stddev, 4) end) as {short}_hi")
        columns.append(f"max(case when metric = '{metric}' then round(mean - stddev, 4) end) as {short}_lo")
    return f"cut as (select {', '.join(columns)} from stats)"


RATING = """
case
  when incident_rate is null or injury_rate is null or death_rate is null
    or a_hi is null or i_hi is null or d_hi is null then null
  when incident_rate > a_hi then
    case when injury_rate < i_lo and death_rate < d_lo then 'Ok' else 'Hazardous' end
  when incident_rate < a_lo then
    case when injury_rate > i_hi and death_rate > d_hi then 'Ok' else 'Safe' end
  when injury_rate > i_hi and death_rate > d_hi then 'Hazardous'
  when injury_rate < i_lo and death_rate < d_lo then 'Safe'
  else 'Ok' end"""

CARD = [
    *INCIDENT_STATS,
    *REQUEST_STATS,
    EXP,
    f"""
card as (
  select {", ".join(SCORECARD_NAMES)} from (
    select *, {RATE_SQL} from expo join inc_stats using (area) join req_stats using (area))
)""",
    _bounds("card"),
    _cutoffs(),
]
REST = [name for name in SCORECARD_NAMES if name not in ("city", "area")]

SEGMENTS = """
seg_lines as (
  select cast(l_orderkey as varchar) as segment_id, l_linenumber, l_partkey, l_suppkey,
         cast(l_quantity as int) as k1, l_linenumber as k2, cast(round(l_discount * 100, 0) as int) as k3,
         l_linenumber + cast(l_quantity as int) + l_partkey as cells
  from lineitem
),
seg_sums as (select segment_id, cast(sum(cells) as bigint) as volume, count(*) as samples from seg_lines group by 1),
seg_first as (
  select * from (
    select *, row_number() over (
      partition by segment_id order by l_linenumber, l_partkey, l_suppkey,
      'NATION ' || k1, 'NATION ' || k2, 'NATION ' || k3) as r from seg_lines) where r = 1
)"""

ORDINAL = (
    "{0} || case when {0} % 100 in (11, 12, 13) then 'th' when {0} % 10 = 1 then 'st'"
    " when {0} % 10 = 2 then 'nd' when {0} % 10 = 3 then 'rd' else 'th' end"
)


def _street(number: str) -> str:
    return f"'NATION ' || {ORDINAL.format(number)} || ' ST'"


GAZ = f"gaz as (select n_nationkey as k, {AREA.format('n_regionkey')} as area from nation)"

VOLUME = [
    SEGMENTS,
    GAZ,
    """
located as (
  select row_number() over () as id, f.area as f, t.area as t, w.area as w, volume, samples
  from seg_first join seg_sums using (segment_id)
  join gaz w on w.k = k1 join gaz f on f.k = k2 join gaz t on t.k = k3
),
spread as (
  select area,
         case when count(*) = 3 then max(volume) else count(*) * (max(volume) // 3) end as volume,
         case when count(*) = 3 then max(samples) else count(*) * (max(samples) // 3) end as samples
  from (select id, f as area, volume, samples from located union all select id, t, volume, samples from located
        union all select id, w, volume, samples from located)
  group by id, area
)""",
]

THREE_WAYS = """
rec as (
  select row_number() over () as id, l_orderkey, c_nationkey as a, s_nationkey as b, cast(l_quantity as int) as c,
         cast(floor(l_quantity * 10) as bigint) as volume, cast(l_linenumber as bigint) as samples
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join supplier on l_suppkey = s_suppkey
),
long as (select id, l_orderkey, unnest([a, b, c]) as area, volume, samples from rec)"""

CELLS = """
case when p_type = 'PROMO' then replace(p_name, ' ', ',')
     when p_type = 'LARGE' then replace(p_name, ' ', ',') || ',extra'
     when p_type = 'SMALL' then replace(p_name, ' ', ',') || ',a,b,c,d'
     else p_name end"""


def _extreme(metric: str, direction: str) -> str:
    return f"{_with(*RATES)} select * from rates order by {metric} {direction} nulls last, area limit 10"


SUMMARY = (
    "summary as ("
    + " union all ".join(
        f"select '{name}' as statistic, "
        + ", ".join(f"round(cast({function}({metric}) as double), 6) as {metric}" for metric in RATE_COLUMNS)
        + " from rates"
        for name, function in {
            "count": "count",
            "mean": "avg",
            "stddev": "stddev_samp",
            "min": "min",
            "max": "max",
        }.items()
    )
    + ")"
)

DELIMITED = """
select c_custkey as custkey, c_name || ', "' || c_mktsegment || '"' as name, c_nationkey as nationkey,
       c_acctbal as balance
from customer where not c_acctbal < 0"""

INC_MEASURES = f"{_with(INC, INC_SUMS)} select * from inc_sums"


def _inc_slots(kind: str, source: str) -> str:
    steps = _with(INC, INC_SUMS, TYPES, FACTORS, _slots("top", source, "inc_sums", "vehicles", kind, 5))
    return f"{steps} select area, vehicles, top.* exclude (area) from top join inc_sums using (area)"


def _tier_case(rows: str) -> str:
    steps = _with(
        f"recs as ({rows})",
        "sums as (select area, count(*) as records from recs group by area)",
        "freq as (select area, category, count(*) as n from recs group by area, category)",
        _slots("top", "freq", "sums", "records", "status", 5),
    )
    return f"{steps} select area, records, top.* exclude (area) from top join sums using (area)"


ORACLE: dict[str, str] = {
    "flagship_scorecard": f"{_with(*CARD)} select city, area, {RATING} as rating, {', '.join(REST)} from card, cut",
    "scorecard_report": f"""{_with(*CARD)} select city as "City", area as "Zip_Code", {RATING} as "Safety_classifier",
      {", ".join(f'{name} as "{RATED_NAMES[name]}"' for name in REST)} from card, cut""",
    "named_scorecard": f"""{_with(*CARD)} select
      {", ".join(f'{name} as "{report_name}"' for name, report_name in SCORECARD_NAMES.items())} from card""",
    "incident_stats": f"{_with(*INCIDENT_STATS)} select * from inc_stats",
    "incident_totals": f"""{_with(INC, INC_SUMS, TYPES, FACTORS)}
      select 'vehicle' as kind, category, cast(sum(n) as bigint) as n from types group by category
      union all select 'factor', category, cast(sum(n) as bigint) from factors group by category
      union all select 'metric', 'incidents', cast(sum(incidents) as bigint) from inc_sums
      union all select 'metric', 'vehicles', cast(sum(vehicles) as bigint) from inc_sums
      {" ".join(
          f"union all select 'metric', '{name.removeprefix('persons_')}', cast(sum({name}) as bigint) from inc_sums"
          for name in [*PERSONS, *CASUALTIES['persons_injured'], *CASUALTIES['persons_killed']])}""",
    "request_stats": f"{_with(*REQUEST_STATS)} select * from req_stats",
    "request_totals": f"""{_with(REQ)}
      select 'complaint' as kind, category, count(*) as n from req group by category
      union all select 'descriptor', descriptor, count(*) from req group by descriptor
      union all select 'metric', 'requests', count(*) from req""",
    "incident_measures": INC_MEASURES,
    "slot_occupancy": f"""{_with(INC)} select area,
      count(o_orderpriority) + count(l_returnflag) + count(status) as factors,
      count(p_type) + count(p_brand) as vehicles from inc group by area""",
    "casualty_shares": f"""{_with(INC, INC_SUMS)}
      select area, {", ".join([*PERSONS, *CASUALTIES["persons_injured"], *CASUALTIES["persons_killed"]])},
      {CASUALTY_PCTS} from inc_sums""",
    "type_frequency": f"{_with(INC, TYPES)} select area, 'vehicle' as kind, category, n from types",
    "factor_frequency": f"{_with(INC, FACTORS)} select area, 'factor' as kind, category, n from factors",
    "category_totals": f"""{_with(INC, TYPES, FACTORS)}
      select 'vehicle' as kind, category, cast(sum(n) as bigint) as n from types group by category
      union all select 'factor', category, cast(sum(n) as bigint) from factors group by category""",
    "category_totals_two_level": f"""{_with(INC, FACTORS)} select area, category, n from factors
      union all select null, category, cast(sum(n) as bigint) from factors group by category""",
    "top_types_tiered": _inc_slots("vehicle", "types"),
    "top_factors_tiered": _inc_slots("factor", "factors"),
    "top_types_long": f"""{_with(INC, TYPES)} select area, cast(r as int) as rank, category, n from (
        select *, row_number() over (partition by area order by n desc, category) as r,
               count(*) over (partition by area) as found from types where category <> 'PROMO')
      where r <= {_tier('found')}""",
    "tier_one_only": _tier_case(
        f"select {AREA.format('s_nationkey')} as area, l_linestatus as category"
        " from lineitem join supplier on l_suppkey = s_suppkey"
    ),
    "tier_three": _tier_case(
        f"select {AREA.format('c_nationkey')} as area, o_orderstatus as category"
        " from orders join customer on o_custkey = c_custkey"
    ),
    "modal_city": f"""{_with(REQ)} select area, city from (
        select area, city, row_number() over (partition by area order by count(*) desc, city) as r
        from req group by area, city) where r = 1""",
    "annual_exposure": f"{_with(EXP)} select * from expo",
    "split_cells": """
      with o as (select *, cast(floor(o_totalprice) as bigint) as volume,
                 cast(left(o_orderpriority, 1) as bigint) as samples from orders)
      select cast(o_custkey as varchar) as area, volume // 2 as volume, samples // 2 as samples
      from o where o_orderstatus in ('F', 'O')
      union all select cast(o_orderkey as varchar), volume // 2, samples // 2 from o where o_orderstatus in ('F', 'O')
      union all select cast(o_custkey as varchar), volume, samples from o
      where o_orderstatus not in ('F', 'O') and o_orderpriority <> '1-URGENT'""",
    "segment_rollup": f"""{_with(SEGMENTS)} select segment_id, {_street('k1')} as roadway,
      {_street('k2')} as from_street, {_street('k3')} as to_street, volume, samples
      from seg_first join seg_sums using (segment_id)""",
    "first_line_rollup": """
      select l_orderkey, l_returnflag, l_linestatus, volume, samples from (
        select *, row_number() over (partition by l_orderkey
                 order by l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) as r,
               cast(sum(cast(l_quantity as bigint)) over (partition by l_orderkey) as bigint) as volume,
               count(*) over (partition by l_orderkey) as samples
        from lineitem) where r = 1""",
    "wide_numeric_sum": f"{_with(SEGMENTS)} select segment_id, cast(cells as bigint) as volume from seg_lines",
    "street_ordinals": f"""select p_partkey,
        case when p_size = 1 then 'AVE OF THE AMERICAS' else 'WEST ' || {ORDINAL.format('p_size')} || ' ST' end as west,
        'E ' || {ORDINAL.format('(p_size + 90)')} || ' ST & ' || {ORDINAL.format('p_size')} || ' AVE' as east
      from part""",
    "three_way_apportion": f"""{_with(THREE_WAYS)}
      select max(l_orderkey) as l_orderkey, area,
             case when count(*) = 3 then max(volume) else count(*) * (max(volume) // 3) end as volume,
             case when count(*) = 3 then max(samples) else count(*) * (max(samples) // 3) end as samples
      from long group by id, area""",
    "three_way_apportion_exact": f"""{_with(THREE_WAYS)}
      select max(l_orderkey) as l_orderkey, area, max(volume) * count(*) / 3 as volume from long group by id, area""",
    "location_lookup": f"""{_with(SEGMENTS, GAZ)} select segment_id, 'NATION ' || k1 || ' ST' as roadway,
        'NATION ' || k2 || ' ST' as from_street, 'NATION ' || k3 || ' ST' as to_street,
        w.area as roadway_area, f.area as from_area, t.area as to_area
      from seg_lines join gaz w on w.k = k1 join gaz f on f.k = k2 join gaz t on t.k = k3""",
    "area_volume": f"{_with(*VOLUME)} select * from spread",
    "street_exposure": f"""{_with(*VOLUME)}
      select area, cast(sum(volume) // nullif(sum(samples), 0) as bigint) * 731 as exposure from spread group by area""",
    "date_window": """select o_orderkey, o_orderdate, o_orderstatus from orders
      where o_orderdate between timestamp '1996-01-01 00:00:00' and timestamp '1997-12-31 23:59:00'
        and trim(o_orderstatus) <> ''""",
    "parse_or_drop": """select l_orderkey, l_linenumber,
        l_shipdate + to_hours(cast(l_quantity as int)) + to_minutes(l_linenumber) as moment
      from lineitem where l_quantity < 24""",
    "prepared_incidents": f"""select {AREA.format('l_suppkey')} as area,
        {", ".join(f"cast((l_linenumber + {i}) % 3 as integer) as {name}" for i, name in enumerate(CASUALTY_COLUMNS))},
        {", ".join(f"l_returnflag || '{i}' as {name}" for i, name in enumerate(FACTOR_COLUMNS))},
        {", ".join(f"l_linestatus || '{i}' as {name}" for i, name in enumerate(VEHICLE_COLUMNS))}
      from lineitem where l_quantity < 24 and l_suppkey % 10 <> 0
        and l_shipdate + to_hours(cast(l_quantity as int)) + to_minutes(l_linenumber)
            between timestamp '1996-01-01' and timestamp '1998-12-31 23:59:00'""",
    "prepared_requests": f"""select {AREA.format('user_id')} as area, upper(event_type) || ' STREET' as category,
        props as descriptor, 'City ' || (user_id % 5) as city
      from events where event_id % 7 <> 6 and event_id % 3 = 0 and event_id % 13 <> 0 and event_id % 11 <> 0
        and case event_id % 7 when 2 then date_trunc('minute', ts) when 3 then date_trunc('day', ts)
              when 4 then date_trunc('millisecond', ts) else date_trunc('second', ts) end
            between timestamp '2024-01-05' and timestamp '2024-01-20 12:00:00'""",
    "keyword_filter": """select p_partkey, upper(p_name) as upper_name,
        upper(left(p_name, 1)) || lower(substring(p_name, 2)) as plain_name
      from part where p_name like '%r%' and p_name not like '%red%'""",
    "key_normalise": f"""select c_custkey,
        case when c_custkey < 100000 then {AREA.format('c_custkey')} else cast(c_custkey as varchar) end as area,
        cast(c_custkey as varchar) as number,
        cast(cast(substring(case when c_custkey < 100000 then {AREA.format('c_custkey')}
                                 else cast(c_custkey as varchar) end, 2, 9) as bigint) as varchar) as name_number
      from customer""",
    "fallback_projection": f"""select p_partkey, {CELLS} as text, cast(p_size as varchar) as number,
        'end' as last, p_brand as brand from part""",
    "merged_cells": f"""select p_partkey, cast(p_partkey as varchar) as partkey, p_type as type, {CELLS} as name,
        p_brand as brand, cast(p_size as varchar) as size, 'end' as last from part""",
    "case_kind": """select 'vehicle' as kind, p_type as category, count(*) as n from part
      where p_type <> 'PROMO' group by p_type
      union all select 'factor', p_brand, count(*) from part group by p_brand""",
    "delimited_lines": DELIMITED,
    "delimited_rejects": """select c_custkey || ',' || c_name || ', "' || c_mktsegment || '",' || c_nationkey || ',' ||
        cast(cast(c_acctbal as decimal(18, 2)) as varchar) as line
      from customer where c_acctbal < 0""",
    "csv_sink_roundtrip": DELIMITED,
    "json_sink_roundtrip": INC_MEASURES,
    "text_reexport": "select event_id || '|' || user_id || '|' || event_type || '|' || props as line from events",
    "rates": f"{_with(*RATES)} select * from rates",
    "metric_summary": f"{_with(*RATES, SUMMARY)} select * from summary",
    "summary_report": f"""{_with(*RATES, SUMMARY)} select statistic as summary,
      {", ".join(f'{metric} as "{SUMMARY_NAMES[metric]}"' for metric in RATE_COLUMNS)} from summary""",
    "sigma_bounds": f"""{_with(*RATES, _bounds('rates'))}
      select metric, cast(k as int) as k, mean, stddev, round(mean - k * stddev, 4) as lower,
             round(mean + k * stddev, 4) as upper
      from stats, (values (1), (2), (3)) as bands(k)""",
    "sampled_scan": f"""select * from lineitem
      where cast('0x' || substr(md5('7|' || l_orderkey || '|' || l_linenumber), 1, 8) as bigint) < {int(0.05 * 2**32)}""",
    "rating_unknown": f"""{_with(*RATES, """known as (select * replace (
        case when area like '%1' then null else incident_rate end as incident_rate) from rates)""", _bounds('known'), _cutoffs())}
      select area, {RATING} as rating, {", ".join(RATE_COLUMNS)} from known, cut""",
    "rating": f"""{_with(*RATES, _bounds('rates'), _cutoffs())}
      select area, {RATING} as rating, {", ".join(RATE_COLUMNS)} from rates, cut""",
    **{f"top_k_{metric}": _extreme(metric, "desc") for metric in RATE_COLUMNS},
    **{f"bottom_k_{metric}": _extreme(metric, "asc") for metric in RATE_COLUMNS},
}

_LINE_END = "c_nationkey || ',' || cast(cast(c_acctbal as decimal(18, 2)) as varchar)"
# Those that are made of others.
ORACLE |= {
    "stored_profiles": ORACLE["incident_stats"],
    "staged_records": f"select * from ({DELIMITED}) where nationkey % 5 > 0",
    "staged_rejects": f"""select line as record, 'parse' as reason from ({ORACLE["delimited_rejects"]})
      union all select 'custkey,name,nationkey,balance', 'parse' from nation
      union all select c_custkey || ',"' || c_name || ', ""' || c_mktsegment || '""' || '",' || {_LINE_END}, 'nation'
      from customer where not c_acctbal < 0 and c_nationkey % 5 = 0""",
    "file_widths": """select cast(c_custkey as varchar) as key, c_name as name, cast(c_nationkey as varchar) as nation from customer
      union all select cast(s_suppkey as varchar), s_name, cast(s_nationkey as varchar) from supplier""",
    "multiline_records": """select c_custkey as custkey, c_name || ',' || chr(10) || '"' || c_mktsegment || '"' || chr(10) || 'end' as name,
        c_nationkey as nationkey, c_acctbal as balance from customer""",
    "ordered_totals": f"""select *, row_number() over (order by n desc, kind, category) as place
      from ({ORACLE["category_totals"]})""",
    "published_reports": f"""select *, 'types' as report from ({ORACLE["type_frequency"]})
      union all select *, 'factors' from ({ORACLE["factor_frequency"]})""",
}

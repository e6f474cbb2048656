"""The same questions in SQL, written apart from the library, to check it."""

from __future__ import annotations

import re

ORDER = "race_date, race_id, line_no, part_id, price_cents, ship_date"

# Named subqueries; a query pulls in those it names, in this order.
PARTS = {
    "results": """
        select cast(year(o_orderdate) as bigint) as season, l_orderkey as race_id,
               cast(o_orderdate as date) as race_date, cn.n_name as circuit_id,
               l_suppkey as driver_id, s_name as driver, s_nationkey as constructor_id,
               tn.n_name as constructor_name, l_linenumber as line_no, l_partkey as part_id,
               cast(round(l_extendedprice * 100) as bigint) as price_cents,
               cast(l_shipdate as date) as ship_date,
               case when l_tax <> 0 then l_partkey % 20 + 1 end as grid,
               case when l_returnflag <> 'R' then l_linenumber end as finish,
               l_linestatus as status, cast(l_quantity as bigint) as points,
               concat_ws('|', l_orderkey, l_suppkey, l_linenumber, l_partkey,
                         cast(round(l_extendedprice * 100) as bigint),
                         cast(l_shipdate as date)) as row_key
        from lineitem
        join orders on l_orderkey = o_orderkey
        join supplier on l_suppkey = s_suppkey
        join nation tn on s_nationkey = tn.n_nationkey
        join customer on o_custkey = c_custkey
        join nation cn on c_nationkey = cn.n_nationkey""",
    "recaptured": """
        select season, race_id // 4 as round, circuit_id as race_name, circuit_id,
               case when race_id % 13 <> 0 then
                   cast(race_date + case when (race_id // 4) % 5 = 0 then 1 else 0 end as date) end as race_date,
               case when (race_id + line_no) % 11 <> 0 then cast(driver_id as varchar) end as driver_id,
               'Supplier ' || driver_id as driver,
               cast(constructor_id as varchar) as constructor_id, constructor_name,
               cast(grid as bigint) as grid, cast(finish as bigint) as finish, status,
               points + 0.5::double as points
        from results where (race_id // 4) % 5 <> 0 or line_no % 2 = 0""",
    "issued": """
        select cast(cast(ts as date) + ahead as date) as day, cast(ts as date) as issued,
               value + ahead as temperature, event_type as description,
               event_type = 'error' as is_wet, (event_id % 101) / 100.0::double as rain_chance
        from events, (values (0), (1)) d(ahead)
        qualify row_number() over (partition by cast(ts as date), ahead order by event_id desc) = 1""",
    "races": """
        select cast(year(o_orderdate) as bigint) as season, o_orderkey as race_id,
               cast(o_orderdate as date) as race_date, n_name as circuit_id
        from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey""",
    "hist": """
        select *, case when finish = 1 then 1 else 0 end as win
        from results where season between 1998 and 2000""",
    "active": "select s_suppkey as driver_id from supplier where s_acctbal > 0",
    "past": "select * from hist where driver_id in (select driver_id from active)",
    "stats": """
        select driver_id, avg(finish) as avg_finish_circuit,
               cast(min(finish) as bigint) as best_finish_circuit,
               cast(sum(points) as bigint) as total_points_circuit,
               cast(sum(win) as bigint) as wins_circuit, count(*) as races_at_circuit,
               cast(sum(win) as double) / count(*) as win_rate_circuit
        from hist where circuit_id = 'NATION_7' group by driver_id""",
    "driver_table": """
        select season, driver_id, driver, cast(constructor_id as bigint) as constructor_id,
               cast(sum(points) as bigint) as points,
               count(*) filter (where finish = 1) as wins
        from results where season = 2001 group by all""",
    "team_table": """
        select season, cast(constructor_id as bigint) as constructor_id, constructor_name,
               cast(sum(points) as bigint) as constructor_points,
               count(*) filter (where finish = 1) as constructor_wins
        from results where season = 2001 group by all""",
    "qualifying": """
        select season, circuit_id, race_date, driver_id, cast(min(line_no) as bigint) as position
        from results where status = 'F' group by all""",
    "race_quali": """
        select race_date, driver_id, position from qualifying
        where season = 2001 and circuit_id = 'NATION_7'
          and race_date = (select min(race_date) from qualifying
                           where season = 2001 and circuit_id = 'NATION_7')""",
    "hist_quali": """
        select race_date, driver_id, min(position) as qualifying_position
        from qualifying group by all""",
    "features": """
        select n_name as circuit_id,
               case when n_nationkey % 2 = 0 then 'Permanent' else 'Street' end as circuit_type,
               3 + n_nationkey / 10.0::double as circuit_length
        from nation where n_nationkey < 20""",
    "driver_totals": f"""
        select *, cast(coalesce(sum(points) over d, 0) as bigint) as points_before,
               cast(coalesce(sum(win) over d, 0) as bigint) as wins_before
        from hist window d as (partition by driver_id order by {ORDER}
                               rows between unbounded preceding and 1 preceding)""",
    "team_totals_faithful": f"""
        select *, cast(coalesce(sum(points) over d, 0) as bigint) as team_points_before,
               cast(coalesce(sum(win) over d, 0) as bigint) as team_wins_before
        from hist window d as (partition by constructor_id order by driver_id, {ORDER}
                               rows between unbounded preceding and 1 preceding)""",
    "team_totals_asof": """
        select *, cast(coalesce(sum(points) over d, 0) as bigint) as team_points_before,
               cast(coalesce(sum(win) over d, 0) as bigint) as team_wins_before
        from hist window d as (partition by constructor_id order by race_date
            range between unbounded preceding and interval 1 day preceding)""",
    "form": f"""
        select *, avg(points) over d as avg_points_last5, avg(finish) over d as avg_finish_last5,
               cast(sum(win) over d as bigint) as wins_last5
        from hist window d as (partition by driver_id order by {ORDER}
                               rows between 5 preceding and 1 preceding)""",
    "rolled": f"""
        select *, avg(points) over d as r1, avg(finish) over d as r2, sum(win) over d as r3
        from hist window d as (partition by driver_id order by {ORDER}
                               rows between 4 preceding and current row)""",
    "form_faithful": f"""
        select *, lag(r1) over o as avg_points_last5, lag(r2) over o as avg_finish_last5,
               cast(lag(r3) over o as bigint) as wins_last5
        from rolled window o as (order by driver_id, {ORDER})""",
    "stats_asof": """
        select row_key, avg(finish) over d as avg_finish_circuit,
               cast(min(finish) over d as bigint) as best_finish_circuit,
               cast(sum(points) over d as bigint) as total_points_circuit,
               cast(sum(win) over d as bigint) as wins_circuit,
               avg(win) over d as win_rate_circuit
        from hist window d as (partition by driver_id, circuit_id order by race_date
            range between unbounded preceding and interval 1 day preceding)""",
    "weather": """
        select cast(ts as date) as forecast_date,
               cast(sum(cast(value as decimal(18,2))) as double) / count(*) / 2 as temperature,
               cast(count(*) filter (where event_type = 'error') as double) / count(*)
                   as rain_chance
        from events group by 1""",
    "calendar": """
        select 2001 as season, lower(n_name) as race_name, 'city' as city, 'country' as country,
               cast(date '2024-01-01' + n_nationkey as date) as race_date
        from nation""",
    "race_weather": """
        select c.*, coalesce(temperature, 25.0) as temperature,
               case when temperature is null then 'Unknown' else 'events' end as description,
               case when rain_chance > 0.2 then 1 else 0 end as is_wet,
               coalesce(rain_chance, 0.0) as rain_chance
        from calendar c left join weather
          on forecast_date = race_date
         and forecast_date between date '2024-01-05' and date '2024-01-19'""",
    "forecasts": """
        select 2001 as season, a.race_name, cast(race_date as varchar) as race_date,
               case when race_date is null then 'unknown race'
                    when race_date not between date '2024-01-05' and date '2024-01-08'
                         then 'out of reach'
                    when temperature is null then 'no forecast' else 'ok' end as status,
               temperature as track_temperature, cast(rain_chance > 0.2 as bigint) as is_wet,
               case when temperature is null then null when rain_chance > 0.2 then 'Wet'
                    when temperature < 20 then 'Cool' when temperature < 30 then 'Moderate'
                    else 'Hot' end as track_condition, rain_chance
        from (select lower(n_name) as race_name from nation
              union all select lower(r_name) from region) a
        left join calendar c on c.race_name = a.race_name
        left join weather on forecast_date = race_date
          and forecast_date between date '2024-01-05' and date '2024-01-08'""",
    "train": """
        select h.row_key, h.driver_id, h.win as label,
               cast(qualifying_position as double) as qualifying_position,
               wins_before as wins, points_before as points,
               team_points_before as constructor_points, team_wins_before as constructor_wins,
               avg_finish_circuit, best_finish_circuit, total_points_circuit, wins_circuit,
               win_rate_circuit, avg_points_last5, avg_finish_last5, wins_last5,
               case coalesce(circuit_type, 'Unknown') when 'Permanent' then 0
                    when 'Street' then 1 else 2 end as circuit_type_code,
               coalesce(circuit_length, 5.0) as circuit_length,
               cast(25.0 as double) as temperature, 0 as is_wet, cast(0 as double) as rain_chance
        from past h
        join driver_totals using (row_key)
        join team_totals_faithful using (row_key)
        join form_faithful using (row_key)
        left join hist_quali q on q.race_date = h.race_date and q.driver_id = h.driver_id
        left join stats s on s.driver_id = h.driver_id
        left join features f on f.circuit_id = h.circuit_id""",
    "train_corrected": """
        select h.row_key, h.driver_id, h.win as label,
               cast(qualifying_position as double) as qualifying_position,
               wins_before as wins, points_before as points,
               team_points_before as constructor_points, team_wins_before as constructor_wins,
               avg_finish_circuit, best_finish_circuit, total_points_circuit, wins_circuit,
               win_rate_circuit, avg_points_last5, avg_finish_last5, wins_last5,
               case coalesce(circuit_type, 'Unknown') when 'Permanent' then 0
                    when 'Street' then 1 else 2 end as circuit_type_code,
               coalesce(circuit_length, 5.0) as circuit_length,
               cast(25.0 as double) as temperature, 0 as is_wet, cast(0 as double) as rain_chance
        from past h
        join driver_totals using (row_key)
        join team_totals_asof using (row_key)
        join form using (row_key)
        join stats_asof using (row_key)
        left join hist_quali q on q.race_date = h.race_date and q.driver_id = h.driver_id
        left join features f on f.circuit_id = h.circuit_id""",
    "latest": f"""
        select driver_id, avg_points_last5, avg_finish_last5, wins_last5
        from (select *, row_number() over (partition by driver_id
                     order by race_id desc, line_no desc, part_id desc, price_cents desc,
                              ship_date desc) as rn
              from FORM_TABLE where driver_id in (select driver_id from active)
                and race_date = (select max(race_date) from past))
        where rn = 1""",
    "ready": """
        select row_key, label, coalesce(qualifying_position, 0) as qualifying_position,
               coalesce(wins, 0) as wins, coalesce(points, 0) as points,
               coalesce(constructor_points, 0) as constructor_points,
               coalesce(constructor_wins, 0) as constructor_wins,
               coalesce(avg_finish_circuit, 0) as avg_finish_circuit,
               coalesce(best_finish_circuit, 0) as best_finish_circuit,
               coalesce(total_points_circuit, 0) as total_points_circuit,
               coalesce(wins_circuit, 0) as wins_circuit,
               ln(1 + coalesce(win_rate_circuit, 0)) * 0.75 as win_rate_circuit,
               coalesce(avg_points_last5, 0) * 2.0 as avg_points_last5,
               coalesce(avg_finish_last5, 0) as avg_finish_last5,
               coalesce(wins_last5, 0) * 1.5 as wins_last5,
               circuit_type_code, circuit_length, temperature, is_wet, rain_chance
        from train""",
    "long": """
        unpivot (select row_key, COLUMNS_AS_DOUBLE from ready)
        on FEATURE_LIST into name feature value value""",
    "scales": """
        select feature, quantile_cont(value, 0.5) as center,
               case when quantile_cont(value, 0.75) = quantile_cont(value, 0.25) then 1.0
                    else quantile_cont(value, 0.75) - quantile_cont(value, 0.25) end as scale
        from long group by feature""",
    "labelled": """
        select cast(vec_id as varchar) as row_key, cast(embedding as double[]) as vec,
               case when label = (select label from embeddings group by label
                                  order by count(*), label limit 1) then 1 else 0 end as label
        from embeddings""",
}

FEATURES = [
    "qualifying_position",
    "wins",
    "points",
    "constructor_points",
    "constructor_wins",
    "avg_finish_circuit",
    "best_finish_circuit",
    "total_points_circuit",
    "wins_circuit",
    "win_rate_circuit",
    "avg_points_last5",
    "avg_finish_last5",
    "wins_last5",
    "circuit_type_code",
    "circuit_length",
    "temperature",
    "is_wet",
    "rain_chance",
]
PARTS["long"] = (
    PARTS["long"]
    .replace("COLUMNS_AS_DOUBLE", ", ".join(f"cast({c} as double) as {c}" for c in FEATURES))
    .replace("FEATURE_LIST", ", ".join(FEATURES))
)
PARTS["latest_faithful"] = PARTS["latest"].replace("FORM_TABLE", "form_faithful")
PARTS["latest"] = PARTS["latest"].replace("FORM_TABLE", "form")

HASH15 = "cast('0x' || substr(md5('42|' || {key}), 1, 15) as bigint)"
HASH8 = "cast('0x' || substr(md5('42|' || {key}), 1, 8) as bigint)"

BODIES = {
    "flatten_results": """
        select season, race_id as round, circuit_id as race_name, circuit_id,
               cast(race_date as varchar) as race_date, cast(driver_id as varchar) as driver_id,
               'Supplier ' || driver_id as driver,
               cast(constructor_id as varchar) as constructor_id, constructor_name,
               cast(grid as bigint) as grid, cast(finish as bigint) as finish, status,
               points + 0.5::double as points
        from results""",
    "flatten_schedule": """
        select season, race_id as round, 'Race ' || race_id as race_name, circuit_id,
               cast(race_date as varchar) as race_date
        from races""",
    "flatten_qualifying": """
        select cast(year(o_orderdate) as bigint) as season, l_orderkey as round,
               cast(l_suppkey as varchar) as driver_id, cast(l_linenumber as bigint) as position
        from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'F'""",
    "flatten_drivers": """
        select cast(2001 as bigint) as season, cast(s_suppkey as varchar) as driver_id,
               'Supplier ' || s_suppkey as driver
        from supplier""",
    "flatten_entries": """
        select distinct season, circuit_id, cast(driver_id as varchar) as driver_id
        from results""",
    "flatten_driver_standings": """
        select cast(2001 as bigint) as season, cast(s_suppkey as varchar) as driver_id,
               'Supplier ' || s_suppkey as driver,
               cast(s_nationkey as varchar) as constructor_id, s_acctbal as points,
               s_suppkey % 7 as wins
        from supplier where s_acctbal >= 0""",
    "flatten_team_standings": """
        select cast(2001 as bigint) as season, cast(s_suppkey as varchar) as constructor_id,
               n_name as constructor_name, s_acctbal as constructor_points,
               s_suppkey % 7 as constructor_wins
        from supplier join nation on s_nationkey = n_nationkey where s_acctbal >= 0""",
    "flatten_weather": """
        select cast(event_id as varchar) as city, 'XX' as country,
               cast(cast(ts as date) + ahead as varchar) as forecast_date,
               value + ahead as temperature, event_type as description,
               event_type = 'error' as is_wet, (event_id % 101) / 100.0::double as rain_chance
        from events, (values (0), (1)) d(ahead)""",
    "newest_forecasts": """
        with days as (
            select cast(ts as date) + ahead as day, cast(ts as date) as issued, event_id, ahead, value, event_type
            from events, (values (0), (1)) d(ahead)),
        ranked as (
            select *, row_number() over (partition by day order by issued desc, event_id desc) as rn from days)
        select 'city' as city, 'XX' as country, cast(cast(day as date) as varchar) as forecast_date,
               value + ahead as temperature, event_type as description,
               event_type = 'error' as is_wet, (event_id % 101) / 100.0::double as rain_chance
        from ranked where rn = 1""",
    "recaptured_results": """
        select season, round, race_name, circuit_id, cast(race_date as varchar) as race_date,
               driver_id, driver, constructor_id, constructor_name, grid, finish, status, points
        from recaptured where driver_id is not null and race_date is not null""",
    "rejected_results": """
        select season, round, race_name, driver, finish, points,
               concat_ws(', ', case when race_date is null then 'no race_date' end,
                         case when driver_id is null then 'no driver_id' end) as reasons
        from recaptured where driver_id is null or race_date is null""",
    "captures_replaced": """
        select distinct season, race_id // 4 as round, 'capture 1' as capture
        from results where (race_id // 4) % 5 = 0""",
    "forecasts_as_of": """
        select 'city' as city, 'XX' as country, cast(day as varchar) as forecast_date,
               temperature, description, is_wet, rain_chance
        from issued where issued <= date '2024-01-05'
        qualify row_number() over (partition by day order by issued desc) = 1""",
    "forecast_as_of_join": """
        with asked as (
            select c.season, c.race_name, c.race_date, cast(c.race_date - cast(length(race_name) % 3 as integer) as date) as as_of
            from calendar c)
        select a.season, race_name, 'city' as city, 'XX' as country, cast(race_date as varchar) as race_date,
               cast(as_of as varchar) as as_of, cast(issued as varchar) as issued,
               temperature, description, is_wet, rain_chance
        from asked a left join issued i on i.day = a.race_date and i.issued <= a.as_of
        qualify row_number() over (partition by race_name order by issued desc nulls last) = 1""",
    "stats_without_unknown_drivers": """
        select driver_id, avg(finish) as avg_finish_circuit,
               cast(min(finish) as bigint) as best_finish_circuit,
               cast(sum(points) as bigint) as total_points_circuit,
               cast(sum(win) as bigint) as wins_circuit, count(*) as races_at_circuit,
               cast(sum(win) as double) / count(*) as win_rate_circuit, avg(grid) as avg_grid
        from hist where circuit_id = 'NATION_7' and line_no <> 3 group by driver_id""",
    "json_props": "select event_id, cast(props::json->>'k' as bigint) as k from events",
    "quarantine_props": """
        select event_id,
               case when event_id % 7 <> 0 then cast(props::json->>'k' as bigint) end as k,
               case when event_id % 7 = 0 then left(props, length(props) - 1) end as unreadable
        from events""",
    "driver_name_concat": """
        select c_custkey, c_mktsegment || ' ' || c_name as driver,
               lower(c_mktsegment || ' ' || c_name) as driver_lower
        from customer""",
    "safe_int_cast": """
        select o_orderkey, cast(split_part(o_orderpriority, '-', 1) as bigint) as from_digits,
               try_cast(nullif(regexp_extract(split_part(o_orderpriority, '-', 2), '^[0-9]+$'), '')
                        as bigint) as from_word,
               cast(null as bigint) as from_negative, cast(null as bigint) as from_spaced,
               cast(null as bigint) as from_empty
        from orders""",
    "date_parse_diff": """
        select o_orderkey, strftime(o_orderdate, '%Y-%-m-%-d') as day_text,
               cast(cast(o_orderdate as date) as varchar) as day,
               datediff('day', date '2001-02-01', cast(o_orderdate as date)) as days_ahead,
               strftime(o_orderdate, '%Y-%m-%d') as day_padded
        from orders""",
    "season_window": "select row_key, season, points from hist",
    "circuit_filter": """
        select row_key, circuit_id, points from hist where circuit_id = 'NATION_7'""",
    "completed_races": """
        select season, race_id, cast(race_date as varchar) as race_date, circuit_id
        from races where season = 2001 and race_date <= date '2001-02-01'""",
    "last_n_races": """
        select season, race_id, cast(race_date as varchar) as race_date, circuit_id
        from races where season = 2001 and race_date <= date '2001-02-01'
        order by races.race_date desc, race_id desc limit 5""",
    "recent_results": """
        select row_key as race_name, driver_id, cast(constructor_id as bigint) as constructor_id,
               points, cast(finish as bigint) as finish
        from results where race_id in (
            select race_id from races where season = 2001 and race_date <= date '2001-02-01'
            order by race_date desc, race_id desc limit 5)""",
    "win_flag": """
        select row_key, cast(finish as bigint) as finish,
               cast(case when finish = 1 then 1 else 0 end as bigint) as win from results""",
    "winner_per_season": """
        select season, driver, constructor_name from (
            select *, row_number() over (partition by season order by race_date, race_id,
                finish nulls last, line_no, part_id, price_cents, ship_date, driver_id) as rn
            from hist where circuit_id = 'NATION_7') where rn = 1""",
    "winner_per_circuit": """
        select season, circuit_id, driver, constructor_name from (
            select *, row_number() over (partition by season, circuit_id order by race_date,
                race_id, finish nulls last, line_no, part_id, price_cents, ship_date,
                driver_id) as rn
            from results) where rn = 1""",
    "alias_lookup_default": """
        select c_custkey, case when n_nationkey < 20 then n_name else lower(n_name) end
               as circuit_id
        from customer join nation on c_nationkey = n_nationkey""",
    "circuit_feature_lookup": """
        select row_key, circuit_id, coalesce(circuit_type, 'Unknown') as circuit_type,
               coalesce(circuit_length, 5.0) as circuit_length,
               cast(case circuit_type when 'Permanent' then 0 when 'Street' then 1 else 2 end
                    as bigint) as circuit_type_code
        from results left join features using (circuit_id)""",
    "driver_totals_before": """
        select row_key, driver_id, points_before, wins_before from driver_totals""",
    "team_totals_before_faithful": """
        select row_key, cast(constructor_id as bigint) as constructor_id, team_points_before,
               team_wins_before
        from team_totals_faithful""",
    "team_totals_before_asof": """
        select row_key, cast(constructor_id as bigint) as constructor_id, team_points_before,
               team_wins_before
        from team_totals_asof""",
    "form_last5": """
        select row_key, driver_id, avg_points_last5, avg_finish_last5, wins_last5 from form""",
    "form_last5_faithful": """
        select row_key, driver_id, avg_points_last5, avg_finish_last5, wins_last5
        from form_faithful""",
    "driver_history": """
        select row_key, points_before, wins_before, avg_points_last5, avg_finish_last5, wins_last5
        from driver_totals join form using (row_key)""",
    "kept_driver_history": """
        select t.row_key, points_before, wins_before, avg_points_last5, avg_finish_last5, wins_last5
        from driver_totals t join form using (row_key) where t.season = 2000""",
    "kept_team_totals": """
        select row_key, team_points_before, team_wins_before from team_totals_asof where season = 2000""",
    "circuit_stats": "select * from stats",
    "circuit_stats_fallback": """
        select driver_id, avg(finish) as avg_finish_circuit,
               cast(min(finish) as bigint) as best_finish_circuit,
               cast(sum(points) as bigint) as total_points_circuit,
               cast(sum(win) as bigint) as wins_circuit, count(*) as races_at_circuit,
               cast(sum(win) as double) / count(*) as win_rate_circuit
        from past group by driver_id""",
    "circuit_stats_asof": "select * from stats_asof",
    "avg_grid": "select driver_id, avg(grid) as avg_grid from past group by driver_id",
    "driver_standings": "select * from driver_table",
    "recent_performance": "select * from driver_table",
    "team_standings": "select * from team_table",
    "standings_all_seasons": """
        select season, driver_id, cast(sum(points) as bigint) as points,
               count(*) filter (where finish = 1) as wins
        from results group by all""",
    "last_race_day": "select cast(max(race_date) as varchar) as last_day from results",
    "active_driver_semi": "select row_key, driver_id from past",
    "entry_list_semi": """
        select * from driver_table where driver_id in (
            select driver_id from results where season = 2001 and circuit_id = 'NATION_7')""",
    "entry_list_semi_empty": "select * from driver_table",
    "standings_circuit_left": """
        select d.*, avg_finish_circuit, best_finish_circuit, total_points_circuit, wins_circuit,
               win_rate_circuit
        from driver_table d left join stats using (driver_id)""",
    "standings_team_left": """
        select d.*, constructor_name, constructor_points, constructor_wins
        from driver_table d left join team_table t using (constructor_id)""",
    "race_qualifying": """
        select cast(race_date as varchar) as race_date, driver_id, position from race_quali""",
    "qualifying_left": """
        select d.*, cast(position as double) as qualifying_position
        from driver_table d left join race_quali using (driver_id)""",
    "qualifying_fallback": """
        select d.*, qualifying_position from driver_table d
        left join (select driver_id, avg(grid) as qualifying_position from past group by 1)
        using (driver_id)""",
    "history_qualifying_left": """
        select row_key, cast(grid as bigint) as grid, qualifying_position
        from past left join hist_quali using (race_date, driver_id)""",
    "history_qualifying_fallback": """
        select row_key, cast(grid as bigint) as grid, cast(grid as bigint) as qualifying_position
        from past""",
    "latest_snapshot": "select * from latest",
    "history_circuit_left": """
        select row_key, avg_finish_circuit, best_finish_circuit, total_points_circuit,
               wins_circuit, win_rate_circuit
        from past left join stats using (driver_id)""",
    "union_seasons": """
        select season, race_id, cast(race_date as varchar) as race_date, circuit_id
        from races where season between 1998 and 2000""",
    "weather_default_join": """
        select cast(season as bigint) as season, race_name, city, country,
               cast(race_date as varchar) as race_date, temperature, description,
               cast(is_wet as bigint) as is_wet, rain_chance
        from race_weather""",
    "track_condition": """
        select event_id, value as track_temperature,
               case when event_type = 'error' then 1 else 0 end::bigint as is_wet,
               case when event_type = 'error' then 'Wet' when value < 20 then 'Cool'
                    when value < 30 then 'Moderate' else 'Hot' end as track_condition
        from events""",
    "forecast_horizon": """
        select event_id, cast(cast(ts as date) as varchar) as day from events
        where cast(ts as date) between date '2024-01-05' and date '2024-01-19'""",
    "upcoming_races": """
        select cast(season as bigint) as season, race_name, city, country,
               cast(race_date as varchar) as race_date
        from calendar where race_date between date '2024-01-05' and date '2024-01-08'""",
    "race_day_forecast": "select * replace (cast(season as bigint) as season) from forecasts",
    "upcoming_forecasts": """
        select * replace (cast(season as bigint) as season) from forecasts
        where race_date between '2024-01-05' and '2024-01-08'""",
    "season_so_far": """
        select cast(driver_id as varchar) as driver_number, cast(finish as double) as position,
               cast(points as double) as points, race_id as round, circuit_id as track_name
        from results where season = 2001 and race_date <= date '2001-02-01'""",
    "train_matrix": """
        select * replace (cast(label as bigint) as label,
            cast(circuit_type_code as bigint) as circuit_type_code,
            cast(is_wet as bigint) as is_wet)
        from train""",
    "train_matrix_corrected": """
        select * replace (cast(label as bigint) as label,
            cast(circuit_type_code as bigint) as circuit_type_code,
            cast(is_wet as bigint) as is_wet)
        from train_corrected""",
    "score_matrix": """
        select driver_id, driver, constructor_name,
               cast(position as double) as qualifying_position, wins, points,
               constructor_points, constructor_wins, avg_finish_circuit, best_finish_circuit,
               total_points_circuit, wins_circuit, win_rate_circuit, avg_points_last5,
               avg_finish_last5, wins_last5, cast(1 as bigint) as circuit_type_code,
               cast(3.7 as double) as circuit_length, temperature,
               cast(is_wet as bigint) as is_wet, rain_chance
        from (select * from driver_table where driver_id in (
                select driver_id from results where season = 2001 and circuit_id = 'NATION_7'))
        left join stats using (driver_id)
        left join (select constructor_id, constructor_name, constructor_points, constructor_wins
                   from team_table) using (constructor_id)
        left join race_quali using (driver_id)
        left join latest_faithful using (driver_id)
        cross join (select temperature, is_wet, rain_chance from race_weather
                    where race_name = 'nation_7')""",
    "fill_and_clean": """
        select event_id, case when event_id % 5 = 4 then value else 0.0 end as value,
               case when event_id % 5 = 0 then 1 else 0 end::bigint as value_is_missing
        from events""",
    "log_and_weight": """
        select row_key, round(win_rate_circuit, 9) as win_rate_circuit,
               round(avg_points_last5, 9)::double as avg_points_last5,
               round(wins_last5, 9)::double as wins_last5
        from ready""",
    "robust_parameters": """
        select feature, round(center, 9) as center, round(scale, 9) as scale from scales""",
    "robust_scale": """
        select row_key, cast(max(label) as bigint) as label, """
    + ", ".join(
        f"round(max(case when feature = '{c}' then (value - center) / scale end), 9) as {c}"
        for c in FEATURES
    )
    + """
        from long join scales using (feature) join (select row_key, label from ready)
             using (row_key)
        group by row_key""",
    "hash_split_rows": f"""
        select row_key, cast(case when finish = 1 then 1 else 0 end as bigint) as win,
               case when row_number() over (order by {HASH15.format(key='row_key')}, row_key)
                         <= ceil(0.2 * count(*) over ()) then 1 else 0 end::bigint as is_test
        from results""",
    "vector_neighbours": """
        select id, rank, neighbour, distance from (
            select a.vec_id as id, b.vec_id as neighbour,
                   round(list_distance(a.embedding::double[], b.embedding::double[]), 6)
                       as distance,
                   row_number() over (partition by a.vec_id order by
                       list_distance(a.embedding::double[], b.embedding::double[]), b.vec_id)
                       as rank
            from embeddings a join embeddings b on a.vec_id <> b.vec_id)
        where rank <= 5""",
    "smote_balance": f"""
        with base as (select row_key, vec from labelled where label = 1),
        sizes as (select count(*) filter (where label = 1) as few,
                         count(*) filter (where label = 0) as many from labelled),
        quotas as (
            select row_key, vec, (many - few) // few
                   + case when row_number() over (order by {HASH15.format(key='row_key')},
                                                           row_key) <= (many - few) % few
                          then 1 else 0 end as quota
            from base, sizes),
        draws as (
            select row_key, vec, draw,
                   {HASH8.format(key="row_key || '|' || draw || '|neighbour'")} % 5 + 1 as rank,
                   {HASH8.format(key="row_key || '|' || draw || '|step'")} / 4294967296.0::double
                       as step
            from quotas, unnest(range(1, quota + 1)) as t(draw)),
        near as (
            select a.row_key, b.vec as other,
                   row_number() over (partition by a.row_key
                       order by list_distance(a.vec, b.vec), b.row_key) as rank
            from base a join base b on a.row_key <> b.row_key),
        made as (
            select row_key, label, 0 as synthetic, vec from labelled
            union all
            select d.row_key || '+' || draw, 1, 1,
                   [vec[i] + (other[i] - vec[i]) * step for i in range(1, len(vec) + 1)]
            from draws d join near n on n.row_key = d.row_key and n.rank = d.rank)
        select row_key, cast(label as bigint) as label, cast(synthetic as bigint) as synthetic,
               cast(pos as bigint) as pos, round(vec[pos + 1], 6) as value
        from made, unnest(range(0, len(vec))) as t(pos)""",
    "smote_counts": """
        select label, greatest(n, most) as n, greatest(n, most) - n as synthetic_n
        from (select cast(label as bigint) as label, count(*) as n, max(count(*)) over () as most
              from train group by label)""",
    "accuracy": """
        select avg(case when quality = toxic then 1.0 else 0.0 end) as accuracy from labels""",
    "class_report": """
        with per as (
            select c as class, count(*) filter (where quality = c and toxic = c) as hits,
                   count(*) filter (where quality = c) as support,
                   count(*) filter (where toxic = c) as given
            from labels, (select quality as c from labels union select toxic from labels)
            group by c),
        scored as (
            select class, support, hits,
                   case when given = 0 then 0.0 else hits::double / given end as precision,
                   case when support = 0 then 0.0 else hits::double / support end as recall
            from per),
        full_rows as (
            select class, support, hits, precision, recall,
                   case when precision + recall = 0 then 0.0
                        else 2 * precision * recall / (precision + recall) end as f_score
            from scored)
        select cast(class as varchar) as class, precision, recall, f_score, support from full_rows
        union all
        select 'accuracy', sum(hits)::double / sum(support), sum(hits)::double / sum(support),
               sum(hits)::double / sum(support), cast(sum(support) as bigint) from full_rows
        union all
        select 'macro avg', avg(precision), avg(recall), avg(f_score),
               cast(sum(support) as bigint) from full_rows
        union all
        select 'weighted avg', sum(precision * support) / sum(support),
               sum(recall * support) / sum(support), sum(f_score * support) / sum(support),
               cast(sum(support) as bigint) from full_rows""",
    "ranked_field": """
        select d.driver, t.constructor_name
        from driver_table d left join team_table t using (constructor_id)
        where driver_id in (
            select driver_id from results where season = 2001 and circuit_id = 'NATION_7')""",
    "prediction_checks": """
        select name, cast(1 as bigint) as holds from (values
            ('probabilities_in_range'), ('descending'), ('importances_named'), ('importances_sum_to_one'),
            ('better_than_majority'), ('same_trees_whatever_the_partitions')) c(name)""",
    "sink_ranking": """
        select driver_id, coalesce(win_rate_circuit, 0) * 100 as win_probability from stats""",
    "sink_season_page": """
        select 'driver' as kind, driver as name, points, wins from driver_table
        union all
        select 'team', constructor_name, constructor_points, constructor_wins from team_table""",
    "sink_season_tables": """
        select 'current_season' as kind, circuit_id as name, cast(points as double) as points
        from results where season = 2001 and race_date <= date '2001-02-01'
        union all select 'driver_standings', driver, cast(points as double) from driver_table
        union all select 'constructor_standings', constructor_name, cast(constructor_points as double) from team_table
        union all select 'upcoming_races', race_name, null
        from calendar where race_date between date '2024-01-05' and date '2024-01-08'""",
    "rank_desc": """
        select driver_id, coalesce(win_rate_circuit, 0) * 100 as win_probability from stats
        order by win_probability desc, driver_id""",
}


def _needed(text: str) -> list[str]:
    """Parts named in ``text``, with what those name, in order of definition."""
    found: set[str] = set()

    def visit(sql: str) -> None:
        for name in PARTS:
            if name not in found and re.search(rf"\b(from|join|,) +{name}\b", sql):
                found.add(name)
                visit(PARTS[name])

    visit(text)
    return [name for name in _sorted_parts() if name in found]


def _sorted_parts() -> list[str]:
    """A part after all it names."""
    done: list[str] = []

    def place(name: str) -> None:
        for other in PARTS:
            if other != name and other not in done and re.search(
                rf"\b(from|join|,) +{other}\b", PARTS[name]
            ):
                place(other)
        if name not in done:
            done.append(name)

    for name in PARTS:
        place(name)
    return done


def oracle(name: str) -> str:
    body = BODIES[name].strip()
    parts = [f"{part} as ({PARTS[part].strip()})" for part in _needed(body)]
    if body.startswith("with "):
        return "with " + ", ".join([*parts, body.removeprefix("with ")])
    return ("with " + ", ".join(parts) + " " if parts else "") + body


BODIES["sink_report"] = BODIES["class_report"]

ORACLES = {name: oracle(name) for name in BODIES}

"""Views that put the given tables into the shape of tracks, screen logs, questionnaires and participants.

Each is one SQL text for both engines; only the number inside a JSON text is read differently.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

K_SPARK = "cast(get_json_object(props, '$.k') as int)"
K_DUCK = "cast(json_extract_string(props, '$.k') as int)"

VIEWS = {
    "v_gps": "select user_id, event_id, ts as tracked_at, cast(ts as date) as date, cast(32.0 as double) + floor(value / 40) * cast(0.02 as double) as lat, cast(34.7 as double) + (K % 4) * cast(0.0002 as double) as lon, value as accuracy, case when event_type in ('error', 'signup') then 'phone' else 'logger' end as source from events",
    "v_screen": "select user_id, event_id, ts, cast(ts as date) as date, case when event_type in ('view', 'signup') then 'SCREEN ON' when event_type in ('click', 'purchase') then 'SCREEN OFF' else 'OTHER' end as action from events",
    "v_points": "select user_id, event_id, ts, cast(ts as date) as date, value / 20 as speed, case event_type when 'view' then 'Staying' when 'click' then 'AT' when 'purchase' then 'PT' when 'signup' then 'Walking' else 'Missing' end as travel_mode, case when K % 5 = 0 then 'No use' else 'app' end as app, case when K % 10 = 1 then 'Start' when K % 10 = 2 then 'End' end as start_end, case when K % 3 = 0 then '~Home' else 'Other' end as place from events",
    "v_stress": "select user_id, event_id, ts, floor(K / 25) * cast(0.5 as double) as score, case when value between 20 and 100 then 1 else 0 end as flag from events",
    "v_ema_long": "select user_id, event_id, ts, cast(ts as date) as date, case when K % 2 = 0 then 'S4' else 'S5' end as scale, event_type as variable, case when K >= 97 then 'x' when K >= 95 then concat('r', cast(1 + K % 4 as varchar(4))) when K % 2 = 0 then cast(1 + K % 4 as varchar(4)) else cast(1 + K % 5 as varchar(4)) end as response_raw from events",
    "v_ema_wide": "select user_id, event_id, ts as response_time, 1 + (K + 0) % 5 as q1, 1 + (K + 1) % 5 as q2, 1 + (K + 2) % 5 as q3, 1 + (K + 3) % 5 as q4, 1 + (K + 4) % 5 as q5, 1 + (2 * K) % 5 as q6, 1 + (3 * K) % 5 as happy from events where event_type = 'signup'",
    "v_demo": "select c_custkey as user_id, concat('P_', lpad(cast(c_custkey as varchar(8)), 4, '0')) as raw_id, case when c_custkey % 2 = 0 then 'F' when c_custkey % 11 = 0 then 'n/a' else 'M' end as gender_raw, case when c_nationkey % 2 = 0 then 'Yes' else 'No' end as centre_raw, c_mktsegment as class_name, case when c_custkey % 50 = 0 then cast(999.0 as double) else cast(c_acctbal as double) end as balance from customer",
    "v_daily": "select user_id, cast(ts as date) as date, count(*) as n_events, round(sum(value), 4) as total_value, count(distinct event_type) as n_types, case when user_id % 2 = 0 then 'studyA' else 'studyB' end as source, avg(cast(K as double)) as outcome from events group by user_id, cast(ts as date)",
    "v_ids": "select user_id, case cast(user_id % 7 as int) when 0 then raw_id when 1 then concat('study-', cast(user_id as varchar(8)), 'P') when 2 then concat('  Pilot_0', cast(user_id as varchar(8))) when 3 then concat('p', cast(user_id as varchar(8)), 'p') when 4 then 'p_00' when 5 then concat('x-', class_name) end as raw from v_demo",
}



class Views:
    """The views and tables of one folder as DataFrames, each made when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            sql = VIEWS[f"v_{name}"].replace("K", K_SPARK)
            head, _, source = sql.rpartition(" from ")
            base = source.split()[0]
            df = getattr(self, base[2:]) if base.startswith("v_") else self.table(base)
            self._made[name] = self.spark.sql(f"{head} from {{source}}{source[len(base):]}", source=df)
        return self._made[name]

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")


def oracle(sql: str) -> str:
    """The SQL with the views that it names put in front, for DuckDB."""
    used: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if v in text and v not in used:
                add(VIEWS[v])
                used.append(v)

    add(sql)
    ctes = [f"{v} AS ({VIEWS[v].replace('K', K_DUCK)})" for v in used]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest, kind = (body[15:], "RECURSIVE ") if body[5:15].upper() == "RECURSIVE " else (body[5:], "")
        return f"WITH {kind}{', '.join([*ctes, rest])}"
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body

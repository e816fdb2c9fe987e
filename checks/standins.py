"""Inputs of the checked queries, made from the given tables, each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.fixed_values import EVENT_COUNT_COLUMNS, STATE_CODES, WEATHER_COLUMNS
from panelgrid.operators.grid import region_date_grid
from panelgrid.operators.series import Series
from panelgrid.session import materialize

# Nations 0..19 stand for these states; the others keep their own name.
REGION_CODES = ["CA", "TX", "FL", "NY", "IL", "GA", "WA", "AZ", "NC", "CO",
                "PA", "OH", "MI", "MA", "OR", "TN", "IN", "MO", "MD", "WI"]
_NAME_OF = {code: name for name, code in STATE_CODES.items()}
STATE_NAMES = [_NAME_OF[c] for c in REGION_CODES]
EVENT_TYPES = ["Thunderstorm Wind", "Flash Flood", "Winter Storm", "Hail", "Tornado",
               "Lightning", "Blizzard", "Heavy Snow"]
WANTED_REGIONS = [*REGION_CODES, "NATION_20", "NATION_21", "NATION_22"]
START, END = "1995-02-01", "2001-07-15"
GRID_START, GRID_END = "1995-01-01", "2001-08-01"
SERIES = Series(chunk_rows=512)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REGION_OF_NATION = (
    f"CASE WHEN n_nationkey < 20 THEN element_at({_array(REGION_CODES)}, n_nationkey + 1) "
    "ELSE n_name END"
)
CTE: dict[str, tuple[str, tuple[str, ...]]] = {}

CTE["places"] = (
    f"""select n_nationkey, n_name,
        case when n_nationkey < 20 then ({_list(REGION_CODES)})[n_nationkey + 1]
             else n_name end as region_id
    from nation""",
    (),
)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", F.expr(REGION_OF_NATION).alias("region_id")
    )


# -- raw events -------------------------------------------------------------------------

def _storm_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dressed as raw storm event rows, blemishes included."""
    rows = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    )
    tenths = "cast(floor(o_totalprice / 10) as bigint)"
    prepared = rows.selectExpr(
        "*",
        "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400) AS t",
        f"concat(cast({tenths} div 100 as string), '.', "
        f"lpad(cast({tenths} % 100 as string), 2, '0')) AS amount",
    )
    return prepared.selectExpr(
        "o_orderkey AS EVENT_ID",
        f"""CASE WHEN o_orderkey % 97 = 0 THEN NULL
                 WHEN n_nationkey >= 20 THEN lower(n_name)
                 WHEN o_orderkey % 2 = 0 THEN initcap(element_at({_array(STATE_NAMES)}, n_nationkey + 1))
                 ELSE element_at({_array(STATE_NAMES)}, n_nationkey + 1) END AS STATE""",
        f"get({_array(EVENT_TYPES)}, cast(o_orderkey % 9 as int)) AS EVENT_TYPE",
        """CASE WHEN o_orderkey % 53 = 2 THEN 'unknown'
                WHEN o_orderkey % 50 = 1 THEN date_format(t, 'yyyy-MM-dd HH:mm:ss')
                ELSE upper(date_format(t, 'dd-MMM-yy HH:mm:ss')) END AS BEGIN_DATE_TIME""",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 180 - 89.5D END AS BEGIN_LAT",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 360 - 179.75D END AS BEGIN_LON",
        """CASE WHEN o_orderkey % 60 = 1 THEN concat(amount, 'M')
                WHEN o_orderkey % 6 = 0 THEN concat(amount, 'K')
                WHEN o_orderkey % 6 = 1 THEN concat(' ', amount, 'k')
                WHEN o_orderkey % 6 = 2 THEN '0.00K'
                WHEN o_orderkey % 6 = 3 THEN NULL
                WHEN o_orderkey % 6 = 4 THEN amount
                ELSE 'K' END AS DAMAGE_PROPERTY""",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 3 END AS DEATHS_DIRECT",
        "o_orderkey % 5 AS INJURIES_DIRECT",
        "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 40) / 4.0D END AS MAGNITUDE",
    )


def storm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw event rows as a landed table, which is what parsers read."""
    return materialize(_storm_expressions(spark, sf_dir), "storm")


CTE["storm"] = (
    f"""select o_orderkey as event_id,
        case when o_orderkey % 97 = 0 then null else region_id end as region_id,
        o_orderkey % 9 as kind,
        case when o_orderkey % 53 = 2 then null
             else o_orderdate + to_seconds(o_orderkey % 86400) end as t,
        case when o_orderkey % 10 = 0 then null else o_orderkey % 180 - 89.5 end::double as lat,
        case when o_orderkey % 10 = 0 then null else o_orderkey % 360 - 179.75 end::double as lon,
        case when o_orderkey % 60 = 1 then amount * 1000000
             when o_orderkey % 6 in (0, 1) then amount * 1000
             when o_orderkey % 6 = 4 then amount else 0 end as damage_usd,
        case when o_orderkey % 7 = 0 then null else o_orderkey % 3 end as deaths,
        o_orderkey % 5 as injuries,
        case when o_orderkey % 3 = 0 then (o_orderkey % 40) / 4.0 end::double as magnitude
    from (select *, floor(o_totalprice / 10) / 100 as amount from orders)
    join customer on o_custkey = c_custkey
    join places on c_nationkey = n_nationkey""",
    ("places",),
)
CTE["kept_storm"] = (
    f"""select *, date_trunc('day', t) as day from storm
    where t is not null and region_id in ({str(WANTED_REGIONS)[1:-1]})
      and t >= timestamp '{START}' and t < timestamp '{END}' + interval 1 day""",
    ("storm",),
)
CTE["daily_events"] = (
    """select region_id, cast(day as timestamp) as timestamp,
        coalesce(sum(damage_usd), 0) / 1000 as failures,
        count(event_id) as event_count,
        count(*) filter (kind = 0) as wind_event_count,
        count(*) filter (kind = 1) as flood_event_count,
        count(*) filter (kind in (2, 6, 7)) as winter_event_count,
        count(*) filter (kind = 3) as hail_event_count,
        count(*) filter (kind = 4) as tornado_event_count,
        count(*) filter (kind = 5) as lightning_event_count,
        cast(coalesce(sum(deaths), 0) as bigint) as deaths,
        cast(coalesce(sum(injuries), 0) as bigint) as injuries,
        avg(magnitude) as avg_magnitude, avg(lat) as avg_latitude, avg(lon) as avg_longitude
    from kept_storm group by region_id, day""",
    ("kept_storm",),
)

# -- raw weather ------------------------------------------------------------------------


def station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items per supplier nation and ship day, as what a station saw that day."""
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey")
    )
    return rows.groupBy(
        F.expr("concat('USW', lpad(cast(s_nationkey as string), 8, '0'))").alias("station"),
        F.col("l_shipdate").alias("day"),
    ).agg(
        F.expr("cast(max(l_quantity) as int)").alias("q_max"),
        F.expr("cast(min(l_quantity) as int)").alias("q_min"),
        F.expr("cast(sum(l_linenumber) as int)").alias("l_sum"),
        F.expr("max(l_linenumber)").alias("l_max"),
        F.expr("cast(count(1) as int)").alias("n"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, day, element, value, quality): values as text, some missing or flagged."""
    return station_days(spark, sf_dir).selectExpr(
        "station", "day",
        """stack(7,
            'TMAX', cast(q_max * 10 as string), CASE WHEN q_max % 10 = 0 THEN 'X' ELSE ' ' END,
            'TMIN', CASE WHEN q_min % 7 = 0 THEN '-9999' ELSE cast(q_min * 10 - 100 as string) END, ' ',
            'PRCP', cast(l_sum as string), ' ',
            'SNOW', cast(n - 1 as string), ' ',
            'SNWD', CASE WHEN l_max >= 4 THEN cast(l_max * 7 as string) ELSE '-9999' END, ' ',
            'AWND', cast(l_max * 3 as string), ' ',
            'TOBS', '100', ' ') AS (element, value, quality)""",
    )


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width lines: station, month and element with 31 day slots."""
    seen = observations(spark, sf_dir).withColumn(
        "slot", F.expr("concat(lpad(value, 5, ' '), ' ', quality, 'S')")
    )
    months = seen.groupBy(
        "station", F.year("day").alias("y"), F.month("day").alias("m"), "element"
    ).agg(F.map_from_entries(F.collect_list(F.struct(F.dayofmonth("day"), "slot"))).alias("slots"))
    missing = F.lit("-9999   ")
    days = F.transform(
        F.sequence(F.lit(1), F.lit(31)), lambda d: F.coalesce(F.col("slots")[d], missing)
    )
    return months.select(
        F.concat(
            "station", F.col("y").cast("string"), F.lpad(F.col("m").cast("string"), 2, "0"),
            "element", F.array_join(days, ""),
        ).alias("value")
    )


CTE["station_days"] = (
    """select concat('USW', lpad(cast(s_nationkey as varchar), 8, '0')) as station,
        s_nationkey, l_shipdate as day, cast(max(l_quantity) as integer) as q_max,
        cast(min(l_quantity) as integer) as q_min, cast(sum(l_linenumber) as integer) as l_sum,
        max(l_linenumber) as l_max, cast(count(*) as integer) as n
    from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey, l_shipdate""",
    (),
)
CTE["wx_wide"] = (
    """select station, s_nationkey, day as timestamp,
        cast(case when q_max % 10 <> 0 then q_max * 10 end as double) as TMAX,
        cast(case when q_min % 7 <> 0 then q_min * 10 - 100 end as double) as TMIN,
        cast(l_sum as double) as PRCP, cast(n - 1 as double) as SNOW,
        cast(case when l_max >= 4 then l_max * 7 end as double) as SNWD,
        cast(l_max * 3 as double) as AWND
    from station_days""",
    ("station_days",),
)
CTE["wx_long"] = (
    """select station, s_nationkey, timestamp, element, raw from wx_wide
    unpivot (raw for element in (TMAX, TMIN, PRCP, SNOW, SNWD, AWND))""",
    ("wx_wide",),
)
CTE["wx_daily"] = (
    """select region_id, timestamp,
        coalesce((TMAX / 10 + TMIN / 10) / 2, TMAX / 10, TMIN / 10) as tavg_c,
        TMAX / 10 as tmax_c, TMIN / 10 as tmin_c, PRCP / 10 as prcp_mm, SNOW as snow_mm,
        SNWD as snwd_mm, AWND / 10 as awnd_ms
    from wx_wide join places on s_nationkey = n_nationkey""",
    ("wx_wide", "places"),
)


def station_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).selectExpr(
        "concat('USW', lpad(cast(n_nationkey as string), 8, '0')) AS station", "region_id"
    )


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position per region; nation 24 has none."""
    return places(spark, sf_dir).where("n_nationkey < 24").selectExpr(
        "region_id", "n_nationkey * 2.5D - 30 AS latitude", "n_nationkey * -3.25D AS longitude"
    )


CTE["coords"] = (
    """select region_id, cast(n_nationkey * 2.5 - 30 as double) as latitude,
        cast(n_nationkey * -3.25 as double) as longitude from places where n_nationkey < 24""",
    ("places",),
)

# -- the panel made from both raw feeds --------------------------------------------------


def _filled(column: str) -> str:
    upto = "partition by g.region_id order by g.timestamp rows between unbounded preceding and current row"
    onward = "partition by g.region_id order by g.timestamp rows between current row and unbounded following"
    return (f"coalesce(last_value(w.{column} ignore nulls) over ({upto}), "
            f"first_value(w.{column} ignore nulls) over ({onward})) as {column}")


CTE["real_grid"] = (
    f"""select region_id, unnest(generate_series(timestamp '{START}', timestamp '{END}',
        interval 1 day)) as timestamp from (select unnest({_list(WANTED_REGIONS)}) as region_id)""",
    (),
)
CTE["real_panel"] = (
    f"""select g.region_id, g.timestamp,
        {", ".join(_filled(c) for c in WEATHER_COLUMNS)},
        coalesce(e.failures, 0) as failures,
        {", ".join(f"coalesce(e.{c}, 0) as {c}" for c in EVENT_COUNT_COLUMNS)},
        coalesce(e.avg_magnitude, 0) as avg_magnitude, e.avg_latitude, e.avg_longitude,
        c.latitude, c.longitude
    from real_grid g
    left join wx_daily w on g.region_id = w.region_id and g.timestamp = w.timestamp
    left join daily_events e on g.region_id = e.region_id and g.timestamp = e.timestamp
    left join coords c on g.region_id = c.region_id""",
    ("real_grid", "wx_daily", "daily_events", "coords"),
)

# -- a small panel ----------------------------------------------------------------------


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer nation and day; whole numbers, so sums are exact."""
    rows = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .groupBy("c_nationkey", F.col("o_orderdate").alias("timestamp"))
        .agg(
            F.expr("cast(sum(cast(round(o_totalprice * 100) as bigint)) div 100000 as double)").alias("failures"),
            F.expr("count(1)").alias("event_count"),
            F.expr("cast(max(o_custkey % 50) as double)").alias("tmax_c"),
            F.expr("cast(min(o_custkey % 50) as double) / 2").alias("prcp_mm"),
        )
    )
    return rows.join(places(spark, sf_dir), F.expr("c_nationkey = n_nationkey")).select(
        "region_id", "timestamp", "failures", "event_count", "tmax_c", "prcp_mm"
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that have a customer."""
    return (
        table(spark, sf_dir, "customer")
        .join(places(spark, sf_dir), F.expr("c_nationkey = n_nationkey"))
        .select("region_id").distinct()
    )


def sales_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region on every day, null where it had no order."""
    grid = region_date_grid(regions(spark, sf_dir), SERIES, GRID_START, GRID_END)
    return grid.join(sales(spark, sf_dir), ["region_id", "timestamp"], "left")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with nulls at zero and positions attached."""
    filled = sales_grid(spark, sf_dir).fillna(0)
    return filled.join(coordinates(spark, sf_dir), "region_id", "left").fillna(
        0, ["latitude", "longitude"]
    )


CTE["sales"] = (
    """select region_id, o_orderdate as timestamp,
        cast(sum(cast(round(o_totalprice * 100) as bigint)) // 100000 as double) as failures,
        count(*) as event_count, cast(max(o_custkey % 50) as double) as tmax_c,
        cast(min(o_custkey % 50) as double) / 2 as prcp_mm
    from orders join customer on o_custkey = c_custkey join places on c_nationkey = n_nationkey
    group by region_id, o_orderdate""",
    ("places",),
)
CTE["regions"] = (
    "select distinct region_id from customer join places on c_nationkey = n_nationkey", ("places",)
)
CTE["grid"] = (
    f"""select region_id, unnest(generate_series(timestamp '{GRID_START}', timestamp '{GRID_END}',
        interval 1 day)) as timestamp from regions""",
    ("regions",),
)
CTE["sales_grid"] = (
    """select g.region_id, g.timestamp, failures, event_count, tmax_c, prcp_mm
    from grid g left join sales s on g.region_id = s.region_id and g.timestamp = s.timestamp""",
    ("grid", "sales"),
)
CTE["panel"] = (
    """select g.region_id, timestamp, coalesce(failures, 0) as failures,
        coalesce(event_count, 0) as event_count, coalesce(tmax_c, 0) as tmax_c,
        coalesce(prcp_mm, 0) as prcp_mm, coalesce(latitude, 0) as latitude,
        coalesce(longitude, 0) as longitude
    from sales_grid g left join coords c on g.region_id = c.region_id""",
    ("sales_grid", "coords"),
)
CTE["times"] = (
    """select timestamp, row_number() over (order by timestamp) - 1 as pos, count(*) over () as n
    from (select distinct timestamp from panel)""",
    ("panel",),
)
CTE["split_panel"] = (
    """select p.*, case when pos < cast(floor(n * (1 - 0.15::double - 0.15::double)) as bigint) then 'train'
        when pos < cast(floor(n * (1 - 0.15::double)) as bigint) then 'val' else 'test' end as split
    from panel p join times t on p.timestamp = t.timestamp""",
    ("panel", "times"),
)

# -- predictions and scores ---------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows with made-up model outputs; some temporal ones and positions missing."""
    return panel(spark, sf_dir).selectExpr(
        "region_id", "timestamp",
        "CASE WHEN day(timestamp) % 5 <> 0 THEN latitude END AS latitude",
        "CASE WHEN day(timestamp) % 5 <> 0 THEN longitude END AS longitude",
        """CASE WHEN timestamp < timestamp_ntz'1999-08-11' THEN 'train'
                WHEN timestamp < timestamp_ntz'2000-08-01' THEN 'val' ELSE 'test' END AS split""",
        "failures AS target",
        "failures * 0.75D + 3 AS rf_pred",
        "failures * 1.25D - 5 + day(timestamp) AS xgb_pred",
        "CASE WHEN day(timestamp) % 10 <> 0 THEN failures * 0.5D + event_count END AS lstm_pred",
    ).selectExpr(
        "*", "0.5D * rf_pred + 0.5D * xgb_pred AS tabular_ensemble"
    ).selectExpr(
        "*", "coalesce(0.25D * tabular_ensemble + 0.75D * lstm_pred, tabular_ensemble) AS hybrid_pred"
    )


CTE["preds"] = (
    """select *, coalesce(0.25 * tabular_ensemble + 0.75 * lstm_pred, tabular_ensemble) as hybrid_pred
    from (select *, 0.5 * rf_pred + 0.5 * xgb_pred as tabular_ensemble
    from (select region_id, timestamp,
        case when day(timestamp) % 5 <> 0 then latitude end as latitude,
        case when day(timestamp) % 5 <> 0 then longitude end as longitude,
        case when timestamp < timestamp '1999-08-11' then 'train'
             when timestamp < timestamp '2000-08-01' then 'val' else 'test' end as split,
        failures as target, failures * 0.75 + 3 as rf_pred,
        failures * 1.25 - 5 + day(timestamp) as xgb_pred,
        case when day(timestamp) % 10 <> 0 then failures * 0.5 + event_count end as lstm_pred
    from panel))""",
    ("panel",),
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and score per labelled document; scores tie."""
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
        .selectExpr("lang", "quality", "n_chars / (n_chars + 1000.0D) AS p")
    )


CTE["scores"] = (
    """select lang, quality, n_chars / (n_chars + 1000.0::double) as p
    from labels join documents on labels.doc_id = documents.doc_id""",
    (),
)


def sql(body: str, *needs: str) -> str:
    """``body`` behind the stand-ins it names, each after those it is made from."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in CTE[name][1]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        add(need)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][0]})" for n in ordered) + "\n" + body

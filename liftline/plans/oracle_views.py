"""The views of ``views.py`` as SQL text for the comparison engine."""

from __future__ import annotations

SOFIA = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Sofia')"


def iso(instant: str) -> str:
    return f"strftime({instant}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def day(date: str) -> str:
    return f"strftime({date}, '%Y-%m-%d')"


def number_text(value: str) -> str:
    return f"regexp_replace(CAST({value} AS VARCHAR), '\\.0$', '')"


def integer_text(value: str) -> str:
    return f"format('{{:,}}', CAST(round({value}) AS BIGINT))"


_SLUG = "'supplier-' || lpad(CAST({} AS VARCHAR), 9, '0')"

# name -> (views it needs, SELECT text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sites_x": (
        (),
        """SELECT s_suppkey + 1 AS id, lower(replace(s_name, '#', '-')) AS slug, s_name AS name,
  41.0::DOUBLE + CAST(s_suppkey % 50 AS DOUBLE) / 16 AS latitude,
  22.0::DOUBLE + CAST(s_suppkey % 90 AS DOUBLE) / 16 AS longitude FROM supplier""",
    ),
    "ev": (
        (),
        """SELECT event_id, ts, user_id, event_type, value, props,
  CAST(props->>'$.k' AS INT) AS k FROM events""",
    ),
    "runs": (
        ("ev",),
        f"""SELECT event_id AS run_id, user_id + 1 AS site_id,
  CAST({SOFIA} AS DATE) + CAST(k % 4 AS INT) AS forecast_date, ts AS generated_at,
  CASE event_type WHEN 'click' THEN 'mock' WHEN 'view' THEN 'manual' WHEN 'signup' THEN 'baseline'
    WHEN 'purchase' THEN 'real' ELSE 'missing' END AS data_status,
  'runs-' || event_type AS source, 'v' || CAST(k % 4 AS VARCHAR) AS version,
  CASE k % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence_level,
  'Scored from ' || event_type || ' input.' AS confidence_note,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(1500 + 15 * k AS DOUBLE) END AS cloudbase_msl_m,
  CASE WHEN event_type = 'error' THEN NULL ELSE least(value, CAST(100 AS DOUBLE)) END AS p100,
  CASE WHEN event_type = 'error' THEN NULL ELSE least(value, CAST(100 AS DOUBLE)) / 2 END AS p200,
  CASE WHEN event_type = 'error' THEN NULL ELSE least(value, CAST(100 AS DOUBLE)) / 5 END AS p300,
  CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS od_risk,
  k % 3 + 1 AS n_drivers, k FROM ev""",
    ),
    "preds": (
        ("runs",),
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY site_id, forecast_date
  ORDER BY generated_at DESC, run_id DESC) AS rn FROM runs) t WHERE rn = 1""",
    ),
    "reqs": (
        ("ev",),
        f"""SELECT event_id AS request_id, CAST(ts AS DATE) AS request_date, ts AS requested_at,
  {_SLUG.format('user_id')} || CASE WHEN k % 10 = 0 THEN ',' ELSE ', ' END
    || {_SLUG.format('k % 10')} AS site_slugs,
  {_SLUG.format('user_id')} AS slug, {_SLUG.format('k % 10')} AS slug2, user_id, k FROM ev""",
    ),
    "views_x": (
        ("ev",),
        f"""SELECT event_id AS view_id, CAST(ts AS DATE) AS view_date, k,
  'http://host/' || CASE k % 6
    WHEN 0 THEN '?site=' || {_SLUG.format('user_id')} || '&date=2024-01-15'
    WHEN 1 THEN '?site=unknown&date=2024-01-15'
    WHEN 2 THEN '?site=supplier-000000001&site=supplier-000000002'
    WHEN 3 THEN '?site=supplier-000000001&date=2024-02-30'
    WHEN 4 THEN '?date=2024-01-15&site=supplier-000000003&x=1' ELSE '' END AS url FROM ev""",
    ),
    "flights_x": (
        (),
        """SELECT o_orderkey AS flight_id, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT) AS flight_date,
  o_custkey % 15 + 1 AS site_id, o_totalprice / 1000 AS distance_km, o_custkey AS pilot_key,
  o_orderpriority AS priority, o_orderdate AS retrieved_at FROM orders""",
    ),
    "weather_x": (
        (),
        """SELECT l_suppkey + 1 AS site_id, DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT) AS valid_date,
  l_linenumber AS run_age,
  (DATE '2024-01-01' + CAST(l_orderkey % 30 AS INT))::TIMESTAMP - to_hours(6 * l_linenumber) AS model_run_time,
  l_quantity AS temp_c, l_quantity * (1 - l_discount) AS dew_point_c,
  l_extendedprice / 100 AS cape_j_per_kg, l_orderkey AS row_order, l_partkey AS row_part,
  l_tax AS tax, l_returnflag AS flag FROM lineitem""",
    ),
}


def with_views(names: tuple[str, ...], body: str, **extra: str) -> str:
    """``body`` behind the named views, what they need, and ``extra`` views in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS (\n{VIEWS[name][1]})" for name in ordered]
    parts += [f"{name} AS (\n{text})" for name, text in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body

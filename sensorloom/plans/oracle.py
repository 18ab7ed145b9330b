"""SQL statements that state each registered query independently of the operators."""

from __future__ import annotations

from sensorloom.plans.catalog import BLEND, KMEANS_STEPS, LINE_FEATURES, SERIES_COLUMNS, TEST_DAYS, TRANSLATED_COLUMNS
from sensorloom.sources.roles import ASSETS, SENSOR_COLUMNS, SENSORS, TRANSLATIONS

_LOOKUP = "CASE variable " + " ".join(f"WHEN '{s}' THEN '{d}'" for s, d in TRANSLATIONS.items()) + " END"

# Each entry may use the ones before it.
_PARTS = {
    "tel": """SELECT 'A' || lpad(CAST(user_id % 5 + 1 AS VARCHAR), 3, '0') AS asset, event_type AS variable,
        ts, value, event_id FROM events""",
    "hourly": """SELECT asset, variable, date_trunc('hour', ts) AS ts, avg(value) AS value
        FROM tel GROUP BY 1, 2, 3""",
    "grid": """SELECT s.asset, s.variable, g.ts FROM (SELECT DISTINCT asset, variable FROM hourly) s,
        (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly) g""",
    "dense": """SELECT grid.asset, grid.variable, grid.ts, h.value,
        row_number() OVER (PARTITION BY grid.asset, grid.variable ORDER BY grid.ts) AS rn
        FROM grid LEFT JOIN hourly h ON h.asset = grid.asset AND h.variable = grid.variable AND h.ts = grid.ts""",
    "around": """SELECT *, last_value(value IGNORE NULLS) OVER w AS pv,
        last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS pp,
        first_value(value IGNORE NULLS) OVER f AS nv,
        first_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS np
        FROM dense WINDOW
        w AS (PARTITION BY asset, variable ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY asset, variable ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "filled": """SELECT asset, variable, ts, CASE WHEN value IS NOT NULL THEN value
        WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (rn - pp) / (np - pp)
        ELSE pv END AS value FROM around""",
    "wave": """SELECT asset, variable, value - avg(value) OVER (PARTITION BY asset, variable) AS dev,
        row_number() OVER (PARTITION BY asset, variable ORDER BY ts) - 1 AS n,
        count(*) OVER (PARTITION BY asset, variable) AS size FROM filled WHERE value IS NOT NULL""",
    "spec": """SELECT asset, variable, k,
        sqrt(pow(sum(dev * cos(2 * pi() * ((k * n) % size) / size)), 2)
           + pow(sum(dev * sin(2 * pi() * ((k * n) % size) / size)), 2)) AS amp
        FROM wave, (SELECT unnest(range(0, 41)) AS k) GROUP BY asset, variable, k""",
    "whole": """SELECT asset, variable, size, (k + size // 2) % size - size // 2 AS k_shift,
        sqrt(pow(sum(dev * cos(2 * pi() * ((k * n) % size) / size)), 2)
           + pow(sum(dev * sin(2 * pi() * ((k * n) % size) / size)), 2)) AS amp
        FROM wave, (SELECT unnest(range(0, (SELECT max(size) FROM wave))) AS k)
        WHERE k < size GROUP BY asset, variable, size, k""",
    "padded": """SELECT asset, variable, k,
        sqrt(pow(sum(dev * cos(2 * pi() * ((k * n) % longest) / longest)), 2)
           + pow(sum(dev * sin(2 * pi() * ((k * n) % longest) / longest)), 2)) AS amp
        FROM (SELECT *, max(size) OVER (PARTITION BY asset) AS longest FROM wave),
        (SELECT unnest(range(0, (SELECT max(size) FROM wave))) AS k)
        WHERE k < longest GROUP BY asset, variable, k""",
    "energy": """SELECT *, k_shift / (size * 3600.0::DOUBLE) AS freq, sum(amp * amp) OVER (PARTITION BY asset, variable ORDER BY k_shift)
        / nullif(sum(amp * amp) OVER (PARTITION BY asset, variable), 0) AS cum_energy FROM whole""",
    "raw": "SELECT asset, ts, CAST(ts AS DATE) AS day, CAST(ts AS DATE) + 1 AS fcast_day, "
    + ", ".join(f"max(value) FILTER (WHERE variable = '{v}') AS {s}" for v, s in SENSORS.items())
    + " FROM hourly GROUP BY asset, ts",
    "fcast": """SELECT asset, CAST(ts AS DATE) + 1 AS fcast_day, CAST(extract('hour' FROM ts) * 3600 AS BIGINT) AS "range",
        ts + INTERVAL 1 DAY AS fcast_time,
        max(value) FILTER (WHERE variable = 'click') AS WNACWindSpeed_fcast,
        max(value) FILTER (WHERE variable = 'view') AS WNACAmbTemp_fcast
        FROM hourly WHERE variable IN ('click', 'view') GROUP BY asset, ts""",
    "truth": """SELECT f.*, r.WNACWindSpeed AS true_WNACWindSpeed, r.WTURPower AS true_WTURPower
        FROM fcast f LEFT JOIN raw r ON r.asset = f.asset AND r.ts = f.fcast_time""",
    "paired": """SELECT r.asset, r.fcast_day, t."range", r.ts, t.fcast_time, r.WTURPower, r.WNACWindSpeed,
        t.WNACWindSpeed_fcast, t.WNACAmbTemp_fcast, t.true_WTURPower
        FROM raw r JOIN truth t ON r.asset = t.asset AND r.fcast_day = t.fcast_day""",
    "picked": f"""SELECT fcast_day FROM (SELECT DISTINCT fcast_day FROM fcast)
        ORDER BY md5(CAST(fcast_day AS VARCHAR)), fcast_day LIMIT {TEST_DAYS}""",
    "blend": f"""SELECT asset, fcast_day, "range",
        arg_max({BLEND[0]} * WNACWindSpeed_fcast + {BLEND[1]} * coalesce(WNACWindSpeed, 0), ts) AS pred
        FROM paired WHERE WNACWindSpeed_fcast IS NOT NULL GROUP BY 1, 2, 3""",
    "fine": """SELECT d.asset, d.fcast_day, d."range", b.pred FROM
        (SELECT k.asset, k.fcast_day, g."range" FROM (SELECT DISTINCT asset, fcast_day FROM blend) k,
          (SELECT unnest(generate_series(min("range"), max("range"), 600)) AS "range" FROM blend) g) d
        LEFT JOIN blend b ON b.asset = d.asset AND b.fcast_day = d.fcast_day AND b."range" = d."range" """,
}


def _with(sql: str, *last: str) -> str:
    """Prefix the named parts and everything they build on."""
    needed: set[str] = set(last)
    for name in reversed(_PARTS):
        if name in needed:
            body = _PARTS[name].replace("\n", " ")
            words = set(body.replace("(", " ").replace(")", " ").replace(",", " ").split())
            needed |= {other for other in _PARTS if other in words and other != name}
    parts = ", ".join(f"{name} AS ({body})" for name, body in _PARTS.items() if name in needed)
    return f"WITH {parts} {sql}"


_LABEL = 'ts AS "timestamp"'


def _pivot(columns: list[str], name: str, value: str, how: str) -> str:
    return ", ".join(f"{how}({value}) FILTER (WHERE {name} = '{c}') AS \"{c}\"" for c in columns)


def _corr(a: str, b: str) -> str:
    return f"round(abs(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)), 6)"


def _ridge(source: str, x: list[str], y: str, alpha: str, by: str = "") -> str:
    """Ridge for three features by Cramer's rule over centred sums of products."""
    cols = [*x, y]
    names = ["x1", "x2", "x3", "y"]
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    sums = ", ".join(
        f"covar_samp({cols[i]}, {cols[j]}) * (count(*) - 1) AS c{names[i]}{names[j]}"
        for i in range(4)
        for j in range(i, 4)
        if i < 3
    )
    means = ", ".join(f"avg({c}) AS m{n}" for c, n in zip(cols, names))
    a, b, c = f"(cx1x1 + {alpha})", "cx1x2", "cx1x3"
    e, f, i = f"(cx2x2 + {alpha})", "cx2x3", f"(cx3x3 + {alpha})"
    det = f"({a} * ({e} * {i} - {f} * {f}) - {b} * ({b} * {i} - {f} * {c}) + {c} * ({b} * {f} - {e} * {c}))"
    w1 = f"(cx1y * ({e} * {i} - {f} * {f}) - {b} * (cx2y * {i} - {f} * cx3y) + {c} * (cx2y * {f} - {e} * cx3y)) / {det}"
    w2 = f"({a} * (cx2y * {i} - {f} * cx3y) - cx1y * ({b} * {i} - {f} * {c}) + {c} * ({b} * cx3y - cx2y * {c})) / {det}"
    w3 = f"({a} * ({e} * cx3y - cx2y * {f}) - {b} * ({b} * cx3y - cx2y * {c}) + cx1y * ({b} * {f} - {e} * {c})) / {det}"
    return (
        f"moments AS (SELECT {lead}count(*) AS n, {means}, {sums} FROM {source} WHERE {complete} {group}), "
        f"weights AS (SELECT *, {w1} AS w1, {w2} AS w2, {w3} AS w3 FROM moments"
        + (", (VALUES (0.01::DOUBLE), (1.0), (100.0)) AS a(alpha)" if alpha == "alpha" else "")
        + "), model AS (SELECT *, my - w1 * mx1 - w2 * mx2 - w3 * mx3 AS intercept FROM weights) "
    )


def _gram() -> str:
    cols = [*LINE_FEATURES, "price_k"]
    parts = [f"round(sum({c}), 2) AS s_{c}" for c in cols]
    parts += [f"round(sum({a} * {b}), 2) AS g_{a}_{b}" for i, a in enumerate(cols) for b in cols[i:]]
    lines = "SELECT *, l_extendedprice / 1000 AS price_k FROM lineitem"
    return f"SELECT count(*) AS n, {', '.join(parts)} FROM ({lines})"


def _split(test: bool) -> str:
    columns = """asset, fcast_day, "range", ts AS "timestamp", round(WTURPower, 6) AS WTURPower,
        round(WNACWindSpeed_fcast, 6) AS WNACWindSpeed_fcast, round(true_WTURPower, 6) AS true_WTURPower"""
    side = "IN" if test else "NOT IN"
    return _with(f"SELECT {columns} FROM paired WHERE fcast_day {side} (SELECT fcast_day FROM picked)", "paired", "picked")


def _outlier_flags() -> str:
    return """flags AS (SELECT t.*, coalesce(value > m + 3 * s OR value < m - 3 * s, FALSE) AS is_outlier
        FROM tel t JOIN (SELECT asset, variable, avg(value) AS m, stddev_samp(value) AS s FROM tel GROUP BY 1, 2) st
        ON st.asset = t.asset AND st.variable = t.variable)"""


def _after(parts: str, extra: str, sql: str) -> str:
    return f"{_with('', parts)}, {extra} {sql}"


def _kmeans(ks: list[int], steps: int) -> str:
    """Centres c (asset, k, label, inputs) and labels l of all rows after Lloyd steps, from starts drawn by distance."""
    xs = SENSOR_COLUMNS
    gap = lambda a, b: " + ".join(f"pow({a}.{x} - {b}.{x}, 2)" for x in xs)
    means = ", ".join(f"avg(p.{x}) AS {x}" for x in xs)
    columns = ", ".join(xs)
    parts = [
        "wide AS (SELECT asset, ts, " + ", ".join(f"max(value) FILTER (WHERE variable = '{v}') AS {s}" for v, s in SENSORS.items()) + " FROM filled GROUP BY 1, 2)",
        f"""p AS MATERIALIZED (SELECT *, -ln((CAST('0x' || substr(md5('|' || asset || '|' || CAST(ts AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296) AS e
          FROM wide WHERE {" AND ".join(f"{x} IS NOT NULL" for x in xs)})""",
        f"s0 AS MATERIALIZED (SELECT asset, 0 AS label, {columns} FROM p QUALIFY row_number() OVER (PARTITION BY asset ORDER BY e) = 1)",
    ]
    for j in range(1, max(ks)):
        parts.append(
            f"""s{j} AS MATERIALIZED (SELECT * FROM s{j - 1} UNION ALL SELECT asset, {j}, {columns} FROM (
              SELECT p.asset, p.ts, any_value(e) AS e, {", ".join(f"any_value(p.{x}) AS {x}" for x in xs)}, min({gap("p", "s")}) AS d
              FROM p JOIN s{j - 1} s ON s.asset = p.asset GROUP BY 1, 2)
              WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY asset ORDER BY e / d) = 1)"""
        )
    parts.append(f"c0 AS MATERIALIZED (SELECT s.asset, k, label, {columns} FROM s{max(ks) - 1} s, (SELECT unnest({ks}) AS k) WHERE label < k)")
    label = lambda step: f"SELECT p.asset, p.ts, c.k, arg_min(c.label, struct_pack(d := {gap('p', 'c')}, l := c.label)) AS label FROM p JOIN c{step} c ON c.asset = p.asset GROUP BY 1, 2, 3"
    for j in range(1, steps + 1):
        parts.append(
            f"""c{j} AS MATERIALIZED (SELECT c.asset, c.k, c.label, {", ".join(f"coalesce(m.{x}, c.{x}) AS {x}" for x in xs)} FROM c{j - 1} c
              LEFT JOIN (SELECT l.asset, l.k, l.label, {means} FROM ({label(j - 1)}) l JOIN p ON p.asset = l.asset AND p.ts = l.ts GROUP BY 1, 2, 3) m
              ON m.asset = c.asset AND m.k = c.k AND m.label = c.label)"""
        )
    parts.append(f"l AS MATERIALIZED ({label(steps)})")
    return ", ".join(parts)


def oracle_sql() -> dict[str, str]:
    scored = """count(y) AS n, round(avg(pow(y - p, 2)), 6) AS mse,
        round(1 - sum(pow(y - p, 2)) / nullif(var_pop(y) * count(y), 0), 6) AS r2"""
    known = """(SELECT asset, "range", true_WNACWindSpeed AS y, WNACWindSpeed_fcast AS p FROM truth
        WHERE true_WNACWindSpeed IS NOT NULL AND WNACWindSpeed_fcast IS NOT NULL)"""
    ma10 = """avg(value) OVER (PARTITION BY asset, variable ORDER BY ts, event_id
        ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
    sensors = ", ".join(f"round({s}, 6) AS {s}" for s in SENSOR_COLUMNS)
    present = " AND ".join(f"{s} IS NOT NULL" for s in SENSOR_COLUMNS)
    ridge_paired = _ridge("paired", ["WTURPower", '"range"', "WNACWindSpeed_fcast"], "true_WTURPower", "1.0", "asset")
    curve = """SELECT asset, fcast_day, "range", round(CASE WHEN pred IS NOT NULL THEN pred
              ELSE pv + (nv - pv) * ("range" - pp) / (np - pp) END, 6) AS pred_WTURPower FROM
            (SELECT *, last_value(pred IGNORE NULLS) OVER w AS pv, first_value(pred IGNORE NULLS) OVER f AS nv,
              last_value(CASE WHEN pred IS NOT NULL THEN "range" END IGNORE NULLS) OVER w AS pp,
              first_value(CASE WHEN pred IS NOT NULL THEN "range" END IGNORE NULLS) OVER f AS np FROM fine WINDOW
              w AS (PARTITION BY asset, fcast_day ORDER BY "range" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              f AS (PARTITION BY asset, fcast_day ORDER BY "range" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
    return {
        "etl_wide": _with(
            f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", {_pivot(TRANSLATED_COLUMNS, 'id', 'v', 'min')}
            FROM (SELECT ts, {_LOOKUP} || '_' || asset AS id, round(ma, 6) AS v
              FROM (SELECT *, {ma10} AS ma FROM tel) WHERE minute(ts) % 10 = 0)
            WHERE id IS NOT NULL GROUP BY 1""",
            "tel",
        ),
        "resample_wide": _with(
            f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", {_pivot(TRANSLATED_COLUMNS, 'id', 'v', 'min')}
            FROM (SELECT make_timestamp(CAST(ceil(epoch_us(ts) / 600000000) * 600000000 AS BIGINT)) AS ts,
              {_LOOKUP} || '_' || asset AS id, round(avg(value), 6) AS v FROM tel GROUP BY 1, 2)
            WHERE id IS NOT NULL GROUP BY 1""",
            "tel",
        ),
        "wide_csv_round_trip": _with(
            f"""SELECT date_trunc('second', ts) AS "timestamp", {_pivot(TRANSLATED_COLUMNS, 'id', 'v', 'min')}
            FROM (SELECT ts, {_LOOKUP} || '_' || asset AS id, round(ma, 6) AS v
              FROM (SELECT *, {ma10} AS ma FROM tel) WHERE minute(ts) % 10 = 0)
            WHERE id IS NOT NULL GROUP BY 1""",
            "tel",
        ),
        "xml_dictionary": _with(f"SELECT variable, {_LOOKUP} AS identifier, count(*) AS n FROM tel GROUP BY 1, 2", "tel"),
        "csv_by_name": _with(
            f"""SELECT asset, CAST(epoch(ts) AS BIGINT) AS unixtime,
            CASE WHEN day(ts) % 2 = 0 THEN round({SENSOR_COLUMNS[0]}, 6) END AS {SENSOR_COLUMNS[0]},
            {", ".join(f"round({s}, 6) AS {s}" for s in SENSOR_COLUMNS[1:])} FROM raw""",
            "raw",
        ),
        "epoch_preparation": _with(
            f"""SELECT asset, {_LABEL}, CAST(ts AS DATE) AS day, CAST(fcast_day AS TIMESTAMP) AS fcast_day, "range", fcast_time,
            round(WNACWindSpeed, 6) AS WNACWindSpeed, round(WNACWindSpeed_fcast, 6) AS WNACWindSpeed_fcast FROM paired""",
            "paired",
        ),
        "evaluation_flow": _after(
            "paired",
            f"""cut AS (SELECT max(fcast_day) - {TEST_DAYS} AS last FROM fcast),
            used AS (SELECT asset, WNACWindSpeed_fcast AS x, true_WTURPower AS y FROM paired, cut
              WHERE fcast_day <= last AND WNACWindSpeed_fcast IS NOT NULL AND true_WTURPower IS NOT NULL),
            c AS (SELECT asset, avg(x) AS mx FROM used GROUP BY 1),
            t AS (SELECT u.asset, y, x - mx AS p, (x - mx) * (x - mx) AS q FROM used u JOIN c ON c.asset = u.asset),
            s AS (SELECT asset, count(*) AS n, avg(y) AS my, avg(q) AS mq, stddev_pop(p) AS sp, stddev_pop(q) AS sq,
              covar_pop(p, q) / (stddev_pop(p) * stddev_pop(q)) AS r, covar_pop(p, y) / stddev_pop(p) AS cp,
              covar_pop(q, y) / stddev_pop(q) AS cq FROM t GROUP BY 1),
            w AS (SELECT s.*, mx, n * (cp * (n + 10.0) - cq * n * r) / (pow(n + 10.0, 2) - pow(n * r, 2)) AS w1,
              n * (cq * (n + 10.0) - cp * n * r) / (pow(n + 10.0, 2) - pow(n * r, 2)) AS w2 FROM s JOIN c ON c.asset = s.asset),
            cells AS (SELECT DISTINCT f.asset, f.fcast_day, f."range",
              my + w1 * (WNACWindSpeed_fcast - mx) / sp + w2 * (pow(WNACWindSpeed_fcast - mx, 2) - mq) / sq AS pred
              FROM paired f CROSS JOIN cut LEFT JOIN w ON w.asset = f.asset WHERE f.fcast_day > last),
            fine AS (SELECT d.asset, d.fcast_day, d."range", b.pred FROM
              (SELECT k.asset, k.fcast_day, g."range" FROM (SELECT DISTINCT asset, fcast_day FROM cells) k,
                (SELECT unnest(generate_series(min("range"), max("range"), 600)) AS "range" FROM cells) g) d
              LEFT JOIN cells b ON b.asset = d.asset AND b.fcast_day = d.fcast_day AND b."range" = d."range")""",
            curve,
        ),
        "trailing_avg_rows": _with(
            f"SELECT event_id, asset, variable, {_LABEL}, round({ma10}, 6) AS ma FROM tel", "tel"
        ),
        "trailing_avg_time": _with(
            f"""SELECT event_id, asset, variable, {_LABEL}, round(avg(value) OVER (PARTITION BY asset, variable
            ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999' SECOND PRECEDING AND CURRENT ROW), 6) AS ma FROM tel""",
            "tel",
        ),
        "resample_right_closed": _with(
            """SELECT asset, variable, make_timestamp(CAST(ceil(epoch_us(ts) / 600000000) * 600000000 AS BIGINT)) AS "timestamp",
            round(avg(value), 6) AS ma FROM tel GROUP BY 1, 2, 3""",
            "tel",
        ),
        "clock_aligned_sample": _with(
            f"""SELECT asset, variable, {_LABEL}, value, event_id FROM tel
            WHERE minute(ts) % 10 = 0 AND date_part('second', ts) = 0""",
            "tel",
        ),
        "day_hour_slice": _with(
            f"SELECT asset, variable, {_LABEL}, value, event_id FROM tel WHERE dayofyear(ts) = 3 AND hour(ts) <= 12", "tel"
        ),
        "translate_variables": _with(
            f"""SELECT event_id, asset, variable, {_LOOKUP} AS identifier, {_LOOKUP} || '_' || asset AS id FROM tel""", "tel"
        ),
        "untranslated_variables": _with(
            f"SELECT variable, count(*) AS n FROM tel WHERE {_LOOKUP} IS NULL GROUP BY variable", "tel"
        ),
        "pivot_wide": _with(
            f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS "timestamp",
            {_pivot(SERIES_COLUMNS, "variable || '_' || asset", 'value', 'min')} FROM tel GROUP BY 1""",
            "tel",
        ),
        "pivot_mean": _with(
            "SELECT CAST(ts AS DATE) AS day, variable, "
            + ", ".join(f"round(avg(value) FILTER (WHERE asset = '{a}'), 6) AS \"{a}\"" for a in ASSETS)
            + " FROM tel GROUP BY 1, 2",
            "tel",
        ),
        "wide_to_long": _with(
            """SELECT t.ts AS "timestamp", s.variable || '_' || s.asset AS id, s.asset, s.variable, round(h.value, 6) AS value
            FROM (SELECT DISTINCT ts FROM hourly) t CROSS JOIN (SELECT DISTINCT asset, variable FROM hourly) s
            LEFT JOIN hourly h ON h.ts = t.ts AND h.asset = s.asset AND h.variable = s.variable""",
            "hourly",
        ),
        "scalar_time_text": _with(
            f"""SELECT event_id, date_trunc('second', ts) AS parsed, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "text",
            strftime(ts, '%Y-%m-%d') AS day_text, variable || '_' || asset AS id, asset AS id_asset, variable AS id_variable,
            contains(variable || '_' || asset, 'ig') AS has_tag, CAST(date_part('second', ts) AS INTEGER) AS sec,
            CAST(minute(ts) AS INTEGER) AS "minute", CAST(hour(ts) AS INTEGER) AS "hour", CAST(dayofyear(ts) AS INTEGER) AS doy,
            CAST(minute(ts) % 10 AS INTEGER) AS minute_mod, round(value / 3, 6) AS third,
            date_trunc('second', ts) AS whole_second, CAST(ts AS DATE) + 1 AS next_day,
            ts + to_seconds(event_id % 1000) AS shifted,
            CAST(floor(epoch(ts)) AS BIGINT) - CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS second_of_day,
            round(abs(value - 100), 6) AS distance, round(value * value, 4) AS square,
            round(sin(2 * pi() * hour(ts) / 24), 6) AS sin_h, round(cos(2 * pi() * hour(ts) / 24), 6) AS cos_h,
            round((hour(ts) * 3600 + minute(ts) * 60) / 3600, 6) AS hours,
            round(1 + hour(ts) * (9.0 / 23), 6) AS spaced, {_LOOKUP} AS looked_up FROM tel""",
            "tel",
        ),
        "table_profile": _with(
            """SELECT count(DISTINCT asset) AS n_assets, count(DISTINCT variable) AS n_variables,
            count(DISTINCT ts) AS n_timestamps, min(ts) AS t_start, max(ts) AS t_stop, count(*) AS n_rows FROM tel""",
            "tel",
        ),
        "distinct_keys": _with("SELECT DISTINCT asset, variable FROM tel", "tel"),
        "first_keys": _with(
            "SELECT min(asset) AS asset, min(variable) AS variable, CAST(min(dayofyear(ts)) AS INTEGER) AS day_of_year FROM tel",
            "tel",
        ),
        "series_stats": _with(
            """SELECT asset, variable, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
            FROM tel GROUP BY 1, 2""",
            "tel",
        ),
        "step_to_previous": _with(
            """SELECT event_id, asset, variable, round((epoch_us(ts) - lag(epoch_us(ts)) OVER
            (PARTITION BY asset, variable ORDER BY ts)) / 1000000, 6) AS step_s FROM tel""",
            "tel",
        ),
        "missing_matrix": _with(
            "SELECT s.variable, "
            + ", ".join(
                f"count(*) FILTER (WHERE s.asset = '{a}' AND h.value IS NULL) AS \"{a}\"" for a in ASSETS
            )
            + """ FROM (SELECT DISTINCT ts FROM hourly) t CROSS JOIN (SELECT DISTINCT asset, variable FROM hourly) s
            LEFT JOIN hourly h ON h.ts = t.ts AND h.asset = s.asset AND h.variable = s.variable GROUP BY s.variable""",
            "hourly",
        ),
        "gap_report": _with(
            """SELECT min(ts) AS "start", max(ts) + INTERVAL 1 HOUR AS "stop", CAST(count(*) * 3600 AS BIGINT) AS duration_s,
            asset, variable
            FROM (SELECT *, rn - row_number() OVER (PARTITION BY asset, variable ORDER BY ts) AS island FROM dense
              WHERE value IS NULL) GROUP BY asset, variable, island""",
            "dense",
        ),
        "outlier_rows": _after(
            "tel", _outlier_flags(), "SELECT event_id, asset, variable, value FROM flags WHERE is_outlier"
        ),
        "outlier_matrix": _after(
            "tel",
            _outlier_flags(),
            "SELECT variable, "
            + ", ".join(f"CAST(sum(is_outlier::INT) FILTER (WHERE asset = '{a}') AS BIGINT) AS \"{a}\"" for a in ASSETS)
            + " FROM flags GROUP BY variable",
        ),
        "masked_outliers": _after(
            "tel",
            _outlier_flags(),
            "SELECT event_id, asset, variable, CASE WHEN is_outlier THEN value END AS masked FROM flags",
        ),
        "shared_histogram": _with(
            """SELECT variable, asset, CAST(least(floor(coalesce((value - lo) / nullif(hi - lo, 0), 0.5) * 100) + 1, 100) AS INTEGER) AS bin,
            count(*) AS n FROM (SELECT *, min(value) OVER (PARTITION BY variable) AS lo,
            max(value) OVER (PARTITION BY variable) AS hi FROM tel) GROUP BY 1, 2, 3""",
            "tel",
        ),
        "variables_by_type": _with("SELECT event_id, variable, value FROM tel WHERE variable LIKE '%i%'", "tel"),
        "dropna_any": _with(f"SELECT asset, {_LABEL}, {sensors} FROM raw WHERE {present}", "raw"),
        "drop_null_columns": _with(f"SELECT asset, {_LABEL}, day, fcast_day FROM raw", "raw"),
        "linear_interpolate": _with(
            f"SELECT asset, variable, {_LABEL}, round(value, 8) AS value FROM filled", "filled"
        ),
        "union_by_name": """SELECT o_orderkey AS "key", o_orderdate AS "timestamp", o_totalprice AS value, NULL::DOUBLE AS quantity
            FROM orders UNION ALL SELECT l_orderkey, l_shipdate, l_extendedprice, l_quantity FROM lineitem""",
        "correlation_matrix": _after(
            "hourly",
            """h AS (SELECT variable || '_' || asset AS id, ts, value FROM hourly), s AS (SELECT DISTINCT id FROM h WHERE value IS NOT NULL),
            p AS (SELECT x.id AS var_a, y.id AS var_b FROM s x, s y WHERE x.id <= y.id)""",
            f"""SELECT p.var_a, p.var_b, {_corr('va', 'vb')} AS corr, count(vb) AS n FROM p LEFT JOIN
            (SELECT a.id AS var_a, b.id AS var_b, a.value AS va, b.value AS vb FROM h a JOIN h b ON b.ts = a.ts AND a.id <= b.id
              WHERE a.value IS NOT NULL AND b.value IS NOT NULL) j ON j.var_a = p.var_a AND j.var_b = p.var_b GROUP BY 1, 2""",
        ),
        "correlation_by_asset": _after(
            "hourly",
            """s AS (SELECT DISTINCT asset, variable FROM hourly WHERE value IS NOT NULL),
            p AS (SELECT x.asset, x.variable AS var_a, y.variable AS var_b FROM s x JOIN s y ON x.asset = y.asset AND x.variable <= y.variable),
            j AS (SELECT p.*, a.value AS va, b.value AS vb FROM p JOIN hourly a ON a.asset = p.asset AND a.variable = var_a
              JOIN hourly b ON b.asset = p.asset AND b.variable = var_b AND b.ts = a.ts WHERE a.value IS NOT NULL AND b.value IS NOT NULL)""",
            f"""SELECT p.asset, p.var_a, p.var_b, {_corr('va', 'vb')} AS corr, count(vb) AS n
            FROM p LEFT JOIN j ON j.asset = p.asset AND j.var_a = p.var_a AND j.var_b = p.var_b GROUP BY 1, 2, 3""",
        ),
        "dft_magnitude": _with("SELECT asset, variable, k, round(amp, 6) AS amp FROM spec", "spec"),
        "fft_magnitude": _with(
            """SELECT asset, variable, k, round(sqrt(c * c + s * s), 6) AS amp, size,
            CASE WHEN k < size - size // 2 THEN k ELSE k - size END AS k_shift,
            round(CASE WHEN k < size - size // 2 THEN k ELSE k - size END / (size * 3600.0::DOUBLE), 12) AS freq
            FROM (SELECT asset, variable, k, size, sum(dev * cos(2 * pi() * ((k * n) % size) / size)) AS c,
              sum(dev * sin(2 * pi() * ((k * n) % size) / size)) AS s
              FROM wave, (SELECT unnest(range(0, (SELECT max(size) FROM wave))) AS k) WHERE k < size GROUP BY 1, 2, 3, 4)""",
            "wave",
        ),
        "cumulative_energy": _with(
            "SELECT asset, variable, k_shift, round(cum_energy, 6) AS cum_energy FROM energy", "energy"
        ),
        "energy_band": _after(
            "energy",
            """live AS (SELECT DISTINCT asset, variable FROM energy WHERE cum_energy IS NOT NULL),
            seen AS (SELECT e.asset, e.variable, e.k_shift, o.asset AS other, e.freq FROM energy e JOIN live o ON o.variable = e.variable),
            reached AS (SELECT s.asset, s.variable, s.k_shift, coalesce(e.cum_energy, 0) AS share FROM seen s
              ASOF LEFT JOIN energy e ON e.asset = s.other AND e.variable = s.variable AND s.freq >= e.freq)""",
            """SELECT e.asset, e.variable, e.k_shift, round(amp, 6) AS amp, round(cum_energy, 6) AS cum_energy FROM energy e
            JOIN (SELECT asset, variable, k_shift FROM reached GROUP BY 1, 2, 3 HAVING min(share) > 0.05 AND max(share) < 0.95) b
            ON b.asset = e.asset AND b.variable = e.variable AND b.k_shift = e.k_shift""",
        ),
        "spectral_correlation": _with(
            f"""SELECT a.asset, a.variable AS var_a, b.variable AS var_b, {_corr('a.amp', 'b.amp')} AS corr, count(*) AS n
            FROM padded a JOIN padded b ON a.asset = b.asset AND a.k = b.k AND a.variable <= b.variable
            GROUP BY 1, 2, 3""",
            "padded",
        ),
        "quadrature_demo": _after(
            "filled",
            """w AS (SELECT asset, variable, ts, value FROM filled UNION ALL
              SELECT asset, variable || '_late', ts + INTERVAL 6 HOUR, value FROM filled),
            d AS (SELECT asset, variable, value - avg(value) OVER (PARTITION BY asset, variable) AS dev,
              row_number() OVER (PARTITION BY asset, variable ORDER BY ts) - 1 AS n,
              count(*) OVER (PARTITION BY asset, variable) AS size FROM w WHERE value IS NOT NULL),
            f AS (SELECT asset, variable, k, sqrt(pow(sum(dev * cos(a)), 2) + pow(sum(dev * sin(a)), 2)) AS amp
              FROM (SELECT *, 2 * pi() * ((k * n) % size) / size AS a FROM d,
                (SELECT unnest(range(0, (SELECT max(size) FROM d))) AS k) WHERE k < size) GROUP BY 1, 2, 3)""",
            f"""SELECT a.asset, a.variable AS var_a, b.variable AS var_b, {_corr('a.value', 'b.value')} AS corr, count(*) AS n,
            'time' AS domain FROM w a JOIN w b ON a.asset = b.asset AND b.variable = a.variable || '_late' AND a.ts = b.ts
            WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2, 3
            UNION ALL SELECT a.asset, a.variable, b.variable, {_corr('a.amp', 'b.amp')}, count(*), 'spectrum'
            FROM f a JOIN f b ON a.asset = b.asset AND b.variable = a.variable || '_late' AND a.k = b.k GROUP BY 1, 2, 3""",
        ),
        "forecast_join": _with(
            """SELECT asset, fcast_day, "range", ts AS "timestamp", fcast_time, round(WTURPower, 6) AS WTURPower,
            round(WNACWindSpeed_fcast, 6) AS WNACWindSpeed_fcast, round(WNACAmbTemp_fcast, 6) AS WNACAmbTemp_fcast FROM paired""",
            "paired",
        ),
        "attach_truth": _with(
            """SELECT asset, fcast_day, "range", round(WNACWindSpeed_fcast, 6) AS WNACWindSpeed_fcast,
            round(true_WNACWindSpeed, 6) AS true_WNACWindSpeed FROM truth""",
            "truth",
        ),
        "test_days": _split(True),
        "train_days": _split(False),
        "days_except": _with(
            "SELECT DISTINCT fcast_day FROM fcast WHERE fcast_day NOT IN (SELECT fcast_day FROM picked)", "picked"
        ),
        "forecast_error_field": _with(
            """SELECT fcast_day, "range", round(avg(true_WNACWindSpeed), 8) AS true_mean, round(avg(WNACWindSpeed_fcast), 8) AS pred_mean,
            round(abs(avg(true_WNACWindSpeed) - avg(WNACWindSpeed_fcast)), 8) AS delta FROM truth GROUP BY 1, 2""",
            "truth",
        ),
        "error_stats_by_range": _with(
            """SELECT "range", count(d) AS "count", round(avg(d), 8) AS mean, round(stddev_samp(d), 8) AS std,
            round(min(d), 8) AS "min", round(max(d), 8) AS "max", round(quantile_cont(d, 0.25), 8) AS p25,
            round(quantile_cont(d, 0.5), 8) AS p50, round(quantile_cont(d, 0.75), 8) AS p75,
            round(avg(d) + stddev_samp(d), 8) AS mean_plus_std
            FROM (SELECT fcast_day, "range", abs(avg(true_WNACWindSpeed) - avg(WNACWindSpeed_fcast)) AS d FROM truth GROUP BY 1, 2)
            GROUP BY 1""",
            "truth",
        ),
        "regression_metrics": _with(
            f"""SELECT r."range", count(y) AS n, round(avg(pow(y - p, 2)), 4) AS mse,
            round(1 - sum(pow(y - p, 2)) / nullif(var_pop(y) * count(y), 0), 4) AS r2
            FROM (SELECT DISTINCT "range" FROM truth) r LEFT JOIN {known} k ON k."range" = r."range" GROUP BY 1""",
            "truth",
        ),
        "forecast_report": _with(
            f"""SELECT c.asset, n_cells, mean_delta, max_delta, n, mse, r2 FROM
            (SELECT asset, count(d) AS n_cells, round(avg(d), 6) AS mean_delta, round(max(d), 6) AS max_delta FROM
              (SELECT asset, fcast_day, "range", abs(avg(true_WNACWindSpeed) - avg(WNACWindSpeed_fcast)) AS d
               FROM truth GROUP BY 1, 2, 3) GROUP BY 1) c
            LEFT JOIN (SELECT asset, {scored} FROM {known} GROUP BY 1) s ON s.asset = c.asset""",
            "truth",
        ),
        "latest_prediction": _with(
            'SELECT asset, fcast_day, "range", round(pred, 6) AS pred_WTURPower FROM blend', "blend"
        ),
        "densify_grid": _with(
            'SELECT asset, fcast_day, "range", round(pred, 6) AS pred_WTURPower FROM fine', "fine"
        ),
        "linear_10min": _with(curve, "fine"),
        "daily_csv_round_trip": _with(curve, "fine"),
        "long_csv_round_trip": _with(
            """SELECT asset, variable, date_trunc('second', ts) AS "timestamp", value FROM tel""", "tel"
        ),
        "spline_six_hourly": _after(
            "blend",
            """knots AS (SELECT asset, fcast_day, CAST(floor("range" / 21600) * 21600 AS BIGINT) AS x, avg(pred) AS y FROM blend GROUP BY 1, 2, 3),
            curves AS (SELECT asset, fcast_day, count(*) AS n, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM knots GROUP BY 1, 2),
            points AS (SELECT c.*, g.x FROM curves c, (SELECT unnest(generate_series(min(x), max(x), 600)) AS x FROM knots) g),
            near AS (SELECT p.*, (SELECT max_by((x, y), x) FROM knots k WHERE k.asset = p.asset AND k.fcast_day = p.fcast_day AND k.x <= p.x) AS a,
              (SELECT min_by((x, y), x) FROM knots k WHERE k.asset = p.asset AND k.fcast_day = p.fcast_day AND k.x >= p.x) AS b FROM points p)""",
            """SELECT asset, fcast_day, CAST(x AS BIGINT) AS "range", round(CASE WHEN n = 4 THEN
              ys[1] * (x - xs[2]) * (x - xs[3]) * (x - xs[4]) / ((xs[1] - xs[2])::DOUBLE * (xs[1] - xs[3]) * (xs[1] - xs[4]))
            + ys[2] * (x - xs[1]) * (x - xs[3]) * (x - xs[4]) / ((xs[2] - xs[1])::DOUBLE * (xs[2] - xs[3]) * (xs[2] - xs[4]))
            + ys[3] * (x - xs[1]) * (x - xs[2]) * (x - xs[4]) / ((xs[3] - xs[1])::DOUBLE * (xs[3] - xs[2]) * (xs[3] - xs[4]))
            + ys[4] * (x - xs[1]) * (x - xs[2]) * (x - xs[3]) / ((xs[4] - xs[1])::DOUBLE * (xs[4] - xs[2]) * (xs[4] - xs[3]))
            WHEN a[1] = b[1] THEN a[2] ELSE a[2] + (b[2] - a[2]) * (x - a[1]) / (b[1] - a[1]) END, 6) AS pred_WTURPower FROM near""",
        ),
        "pca_variance_pair": _after(
            "raw",
            """m AS (SELECT asset, var_samp(WNACWindSpeed) AS a, var_samp(WNACAmbTemp) AS c, covar_samp(WNACWindSpeed, WNACAmbTemp) AS b
            FROM raw WHERE WNACWindSpeed IS NOT NULL AND WNACAmbTemp IS NOT NULL GROUP BY 1)""",
            """SELECT asset, CAST(n AS BIGINT) AS n, round(CASE n WHEN 2 THEN 1.0
            ELSE ((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)) / (a + c) END, 6) AS explained FROM m, (VALUES (1), (2)) AS v(n)""",
        ),
        "quadratic_ridge": _after(
            "truth",
            """used AS (SELECT asset, WNACWindSpeed_fcast AS x, true_WTURPower AS y FROM truth
              WHERE WNACWindSpeed_fcast IS NOT NULL AND true_WTURPower IS NOT NULL),
            c AS (SELECT asset, avg(x) AS mx FROM used GROUP BY 1),
            t AS (SELECT u.asset, y, x - mx AS p, (x - mx) * (x - mx) AS q FROM used u JOIN c ON c.asset = u.asset),
            s AS (SELECT asset, count(*) AS n, avg(y) AS my, avg(q) AS mq, stddev_pop(p) AS sp, stddev_pop(q) AS sq,
              covar_pop(p, q) / (stddev_pop(p) * stddev_pop(q)) AS r, covar_pop(p, y) / stddev_pop(p) AS cp,
              covar_pop(q, y) / stddev_pop(q) AS cq FROM t GROUP BY 1),
            w AS (SELECT s.*, mx, n * (cp * (n + 10.0) - cq * n * r) / (pow(n + 10.0, 2) - pow(n * r, 2)) AS w1,
              n * (cq * (n + 10.0) - cp * n * r) / (pow(n + 10.0, 2) - pow(n * r, 2)) AS w2 FROM s JOIN c ON c.asset = s.asset)""",
            """SELECT f.asset, f.fcast_day, f."range",
            round(my + w1 * (WNACWindSpeed_fcast - mx) / sp + w2 * (pow(WNACWindSpeed_fcast - mx, 2) - mq) / sq, 6) AS pred_WTURPower
            FROM truth f LEFT JOIN w ON w.asset = f.asset""",
        ),
        "kmeans_labels": _after("filled", _kmeans([8], KMEANS_STEPS), f"SELECT asset, {_LABEL}, label FROM l"),
        "silhouette_sweep": _after(
            "filled",
            _kmeans(list(range(2, 15)), KMEANS_STEPS)
            + f""", pairs AS (SELECT a.asset, a.ts, b.ts AS other, {" + ".join(f"pow(a.{x} - b.{x}, 2)" for x in SENSOR_COLUMNS)} AS d
              FROM p a JOIN p b ON a.asset = b.asset AND a.ts <> b.ts),
            near AS (SELECT q.asset, q.ts, m.k, o.label = m.label AS own, o.label, avg(d) AS d FROM pairs q
              JOIN l o ON o.asset = q.asset AND o.ts = q.other JOIN l m ON m.asset = q.asset AND m.ts = q.ts AND m.k = o.k GROUP BY 1, 2, 3, 4, 5),
            best AS (SELECT asset, ts, k, min(d) FILTER (WHERE own) AS a, min(d) FILTER (WHERE NOT own) AS b FROM near GROUP BY 1, 2, 3)""",
            """SELECT asset, k, round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
            FROM best GROUP BY 1, 2""",
        ),
        "grouped_grid_search_single": _after(
            "truth",
            """used AS (SELECT asset, WNACWindSpeed_fcast AS x, true_WTURPower AS y,
              ntile(3) OVER (PARTITION BY asset ORDER BY fcast_time, "range") - 1 AS fold FROM truth
              WHERE WNACWindSpeed_fcast IS NOT NULL AND true_WTURPower IS NOT NULL),
            h AS (SELECT unnest([0, 1, 2]) AS held),
            t AS (SELECT held, asset, y, x - avg(x) OVER (PARTITION BY held, asset) AS p FROM used, h WHERE fold <> held),
            m AS (SELECT held, asset, avg(x) AS mx FROM used, h WHERE fold <> held GROUP BY 1, 2),
            s AS (SELECT held, asset, count(*) AS n, avg(y) AS my, avg(p * p) AS mq, stddev_pop(p) AS sp, stddev_pop(p * p) AS sq,
              covar_pop(p, p * p) / (stddev_pop(p) * stddev_pop(p * p)) AS r, covar_pop(p, y) / stddev_pop(p) AS cp,
              covar_pop(p * p, y) / stddev_pop(p * p) AS cq FROM t GROUP BY 1, 2),
            w AS (SELECT s.*, mx, alpha, n * (cp * (n + alpha) - cq * n * r) / (pow(n + alpha, 2) - pow(n * r, 2)) AS w1,
              n * (cq * (n + alpha) - cp * n * r) / (pow(n + alpha, 2) - pow(n * r, 2)) AS w2
              FROM s JOIN m USING (held, asset), (VALUES (0.01::DOUBLE), (1.0), (100.0)) AS a(alpha)),
            e AS (SELECT u.asset, alpha, held, 1 - sum(pow(y - my - w1 * (x - mx) / sp - w2 * (pow(x - mx, 2) - mq) / sq, 2))
              / (var_pop(y) * count(*)) AS r2 FROM used u JOIN w ON w.asset = u.asset AND w.held = u.fold GROUP BY 1, 2, 3),
            g AS (SELECT asset, alpha, avg(r2) AS r2 FROM e GROUP BY 1, 2),
            c AS (SELECT asset, count(*) AS n FROM used GROUP BY 1)""",
            """SELECT g.asset, alpha, round(r2, 6) AS r2,
            row_number() OVER (PARTITION BY g.asset ORDER BY r2 DESC, alpha) = 1 AS best, n FROM g JOIN c ON c.asset = g.asset""",
        ),
        "ridge_gram": _gram(),
        "ridge_fit": "WITH "
        + _ridge("lineitem", LINE_FEATURES, "l_extendedprice", "alpha")
        + """SELECT CAST(alpha AS DOUBLE) AS alpha, round(intercept, 4) AS intercept, round(w1, 4) AS quantity,
            round(w2, 4) AS discount, round(w3, 4) AS tax FROM model""",
        "grouped_ridge": _after(
            "paired",
            ridge_paired,
            """SELECT asset, n, round(intercept, 6) AS intercept, round(w1, 6) AS w1, round(w2, 6) AS w2,
            round(w3, 6) AS w3 FROM model""",
        ),
        "grouped_ridge_predictions": _after(
            "paired",
            ridge_paired,
            """SELECT p.asset, p.fcast_day, p."range",
            round((arg_max({'v': intercept + w1 * p.WTURPower + w2 * p."range" + w3 * p.WNACWindSpeed_fcast}, p.ts)).v, 6) AS pred_WTURPower
            FROM paired p LEFT JOIN model m ON m.asset = p.asset GROUP BY 1, 2, 3""",
        ),
    }

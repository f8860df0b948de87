"""Queries over the driver's tables, one or more an operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine, scratch
from .operators import eventtime, shaping
from .plans import planner
from .sources import decoders, encoders, schemas

EVENTS = planner.Options(seq="event_id", ts="ts", hidden=())
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dialect(name: str, sql: str, oracle: str | None, options: planner.Options = EVENTS) -> None:
    """A query in the dialect over one table."""
    source = planner.s.parse(sql).source
    QUERIES[name] = lambda spark, sf_dir: planner.run(sql, read(spark, sf_dir, source), options)
    if oracle:
        ORACLE_SQL[name] = oracle


def frame(name: str, oracle: str | None):
    """A query as a function of (spark, sf_dir)."""

    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return wrap


NV = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"
ROW = planner.Options(seq="doc_id", ts="ts", hidden=())

# --- projection, filter, expressions -------------------------------------------------------
dialect("project_filter", "SELECT event_id, user_id, value * 2 + 1 AS v2, value FROM events WHERE value > 100 AND event_type = 'click'", "SELECT event_id, user_id, value * 2 + 1 AS v2, value FROM events WHERE value > 100 AND event_type = 'click'")
dialect("project_star", "SELECT * FROM events", "SELECT * FROM events")
dialect(
    "null_semantics",
    f"SELECT event_id, {NV} AS nv, nv = NULL AS a, nv != NULL AS b, nv > 5 AS c, nv > 5 OR event_type = 'error' AS d, nv BETWEEN 10 AND 200 AS e, nv NOT IN (1, 2) AS f, event_type IN ('click', NULL) AS g, nv + 1 AS h FROM events",
    """SELECT event_id, nv, nv IS NULL AS a, nv IS NOT NULL AS b, coalesce(nv > 5, false) AS c, coalesce(nv > 5, false) OR event_type = 'error' AS d, coalesce(nv BETWEEN 10 AND 200, false) AS e,
    true AND nv IS DISTINCT FROM 1 AND nv IS DISTINCT FROM 2 AS f, event_type = 'click' AS g, nv + 1 AS h FROM (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS nv FROM events)""",
)
dialect(
    "arithmetic",
    "SELECT event_id, user_id / 7 AS q, event_id % 7 AS r, event_id * 3 - user_id AS m, -event_id AS neg, event_type + '!' AS cat, (user_id + 1) * 2 AS g FROM events",
    "SELECT event_id, user_id / 7 AS q, event_id % 7 AS r, event_id * 3 - user_id AS m, -event_id AS neg, event_type || '!' AS cat, (user_id + 1) * 2 AS g FROM events",
)
dialect(
    "case_forms",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS a, CASE WHEN value > 400 THEN 'high' WHEN value > 100 THEN 'mid' END AS b FROM events",
    "SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS BIGINT) AS a, CASE WHEN value > 400 THEN 'high' WHEN value > 100 THEN 'mid' END AS b FROM events",
)
dialect("alias_reuse", "SELECT event_id, value + 1 AS v1, v1 * 2 AS v2 FROM events WHERE v1 > 50 AND v2 < 300", "SELECT event_id, value + 1 AS v1, (value + 1) * 2 AS v2 FROM events WHERE value + 1 > 50 AND (value + 1) * 2 < 300")
dialect("order_nulls_last", f"SELECT event_id, {NV} AS nv FROM events ORDER BY nv DESC, event_id", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS nv FROM events ORDER BY nv DESC NULLS LAST, event_id")

# --- aggregates and windows ----------------------------------------------------------------
dialect(
    "tumbling_group",
    "SELECT event_type, count(*) AS n, round(avg(value), 7) AS avg_v FROM events WHERE value > 10 GROUP BY tumblingwindow('ss', 3600), event_type",
    "SELECT event_type, count(*) AS n, round(avg(value), 7) AS avg_v FROM events WHERE value > 10 GROUP BY floor(epoch(ts) / 3600), event_type",
)
dialect(
    "aggregates_all",
    f"SELECT event_type, round(avg({NV}), 7) AS a, count({NV}) AS c, round(sum(value), 2) AS s, min(value) AS lo, max(value) AS hi, round(median(value), 6) AS med, ndv(user_id) AS d, last_row(value) AS l, round(var(value), 3) AS v, round(vars(value), 3) AS vs, round(stddev(value), 4) AS sd, round(stddevs(value), 4) AS sds FROM events GROUP BY event_type",
    """SELECT event_type, round(avg(CASE WHEN event_type = 'error' THEN NULL ELSE value END), 7) AS a, count(CASE WHEN event_type = 'error' THEN NULL ELSE value END) AS c, round(sum(value), 2) AS s, min(value) AS lo, max(value) AS hi,
    round(median(value), 6) AS med, count(DISTINCT user_id) AS d, arg_max(value, event_id) AS l, round(var_pop(value), 3) AS v, round(var_samp(value), 3) AS vs, round(stddev_pop(value), 4) AS sd, round(stddev_samp(value), 4) AS sds FROM events GROUP BY event_type""",
)
dialect(
    "aggregate_deduplicate",
    "SELECT user_id, to_json(deduplicate(event_type)) AS kinds FROM events GROUP BY user_id",
    "SELECT user_id, CAST(to_json(list(event_type ORDER BY f)) AS VARCHAR) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY user_id, event_type) GROUP BY user_id",
)
dialect("aggregate_global", "SELECT count(*) AS n, max(value) AS hi FROM events", "SELECT count(*) AS n, max(value) AS hi FROM events")
dialect(
    "aggregate_last_row_columns",
    "SELECT user_id, event_type, value, count(*) AS n FROM events GROUP BY user_id",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY user_id",
)
dialect(
    "group_expression",
    "SELECT user_id % 10 AS bucket, count(*) + 1 AS n1 FROM events GROUP BY user_id % 10 ORDER BY bucket",
    "SELECT user_id % 10 AS bucket, count(*) + 1 AS n1 FROM events GROUP BY user_id % 10",
)
dialect(
    "tumbling_having",
    "SELECT user_id, sum(value) > 500 AS big, count(*) AS n FROM events GROUP BY tumblingwindow('ss', 86400), user_id HAVING count(*) > 2 AND max(value) > 100 ORDER BY n DESC",
    "SELECT user_id, sum(value) > 500 AS big, count(*) AS n FROM events GROUP BY floor(epoch(ts) / 86400), user_id HAVING count(*) > 2 AND max(value) > 100",
)
dialect("tumbling_rows", "SELECT event_id, value FROM events GROUP BY tumblingwindow('ss', 60)", "SELECT event_id, value FROM events")
dialect(
    "count_window",
    "SELECT count(*) AS n, min(event_id) AS first_id, last_row(value) AS last_v, round(sum(value), 3) AS s FROM events GROUP BY countwindow(7)",
    """SELECT count(*) AS n, min(event_id) AS first_id, arg_max(value, event_id) AS last_v, round(sum(value), 3) AS s FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 7 AS w FROM events) GROUP BY w HAVING count(*) = 7""",
)
dialect(
    "count_window_group",
    "SELECT event_type, count(*) AS n FROM events GROUP BY countwindow(64), event_type",
    """SELECT event_type, count(*) AS n FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS w, count(*) OVER () // 64 AS full_ones FROM events) WHERE w < full_ones GROUP BY w, event_type""",
)
dialect(
    "sliding_window",
    "SELECT last_row(event_id) AS id, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY slidingwindow('ss', 1800)",
    """SELECT t.event_id AS id, count(*) AS n, round(sum(r.value), 3) AS s FROM events t JOIN events r ON r.ts BETWEEN t.ts - INTERVAL 1800 SECOND AND t.ts AND (r.ts < t.ts OR r.event_id <= t.event_id) GROUP BY t.event_id""",
)
dialect(
    "sliding_window_ahead",
    "SELECT event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY slidingwindow('ss', 600, 600), event_type",
    """SELECT r.event_type AS event_type, count(*) AS n, max(r.value) AS hi FROM events t JOIN events r ON r.ts BETWEEN t.ts - INTERVAL 600 SECOND AND t.ts + INTERVAL 600 SECOND GROUP BY t.event_id, r.event_type""",
)
_STATE = """WITH RECURSIVE r AS (SELECT user_id, event_id, value, event_type = 'view' AS o, {emit} AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s(user_id, event_id, value, k, active, w, inside) AS (SELECT user_id, event_id, value, k, o, CASE WHEN o THEN 1 ELSE 0 END, o FROM r WHERE k = 1
  UNION ALL SELECT r.user_id, r.event_id, r.value, r.k, CASE WHEN s.active THEN NOT r.e ELSE r.o END, s.w + CASE WHEN NOT s.active AND r.o THEN 1 ELSE 0 END, s.active OR r.o FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)
SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM s WHERE inside GROUP BY user_id, w"""
dialect("state_window", "SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY statewindow(event_type = 'view', event_type = 'purchase') OVER (PARTITION BY user_id), user_id", _STATE.format(emit="event_type = 'purchase'"))
dialect("state_window_both", "SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY statewindow(event_type = 'view', value > 250) OVER (PARTITION BY user_id), user_id", _STATE.format(emit="value > 250"))

# --- functions with state ------------------------------------------------------------------
_P = "OVER (PARTITION BY user_id)"
_W = "PARTITION BY user_id ORDER BY event_id"
_NVQ = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"
dialect(
    "stateful_lag",
    f"SELECT event_id, lag(value) AS l1, lag(value) {_P} AS lp, lag({NV}, 2) {_P} AS l2, lag({NV}, 1, false) {_P} AS ln FROM events",
    f"""SELECT event_id, lag(value) OVER (ORDER BY event_id) AS l1, lag(value) OVER ({_W}) AS lp, lag({_NVQ}, 2 IGNORE NULLS) OVER ({_W}) AS l2, lag({_NVQ}) OVER ({_W}) AS ln FROM events""",
)
dialect(
    "stateful_lag_filter",
    f"SELECT event_id, lag(value) FILTER (WHERE event_type = 'click') {_P} AS l FROM events",
    f"SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM events",
)
dialect("stateful_latest", f"SELECT event_id, latest({NV}) {_P} AS l FROM events", f"SELECT event_id, last_value({_NVQ} IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS l FROM events")
dialect(
    "stateful_changed",
    f"SELECT event_id, changed_col(true, event_type) {_P} AS c, had_changed(true, event_type, user_id) {_P} AS h FROM events",
    f"""SELECT event_id, CASE WHEN event_type IS DISTINCT FROM p THEN event_type END AS c, event_type IS DISTINCT FROM p AS h FROM (SELECT *, lag(event_type) OVER ({_W}) AS p FROM events)""",
)
dialect(
    "stateful_accumulate",
    f"SELECT event_id, round(acc_sum(value) {_P}, 3) AS s, acc_min({NV}) {_P} AS lo, acc_max({NV}) {_P} AS hi, acc_count({NV}) {_P} AS n, round(acc_avg(value) {_P}, 10) AS a, acc_count(value) FILTER (WHERE value > 100) {_P} AS nf FROM events",
    f"""SELECT event_id, round(sum(value) OVER w, 3) AS s, coalesce(min({_NVQ}) OVER w, 0.0) AS lo, coalesce(max({_NVQ}) OVER w, 0.0) AS hi, count({_NVQ}) OVER w AS n, round(avg(value) OVER w, 10) AS a, count(CASE WHEN value > 100 THEN 1 END) OVER w AS nf
    FROM events WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)""",
)
dialect(
    "stateful_lifecycle",
    f"SELECT event_id, round(acc_sum(value, event_type = 'view', event_type = 'purchase') {_P}, 3) AS s FROM events",
    f"""SELECT event_id, round(coalesce(sum(CASE WHEN o THEN value END) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0), 3) AS s FROM (SELECT *, bool_or(event_type = 'view') OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS o
    FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events))""",
)
dialect("stateful_where", f"SELECT event_id, value FROM events WHERE lag(value) {_P} > 300", f"SELECT event_id, value FROM (SELECT *, lag(value) OVER ({_W}) AS l FROM events) WHERE l > 300")
dialect(
    "stateful_in_aggregate",
    "SELECT count(*) AS n, last_row(lag(event_id)) AS p FROM events GROUP BY countwindow(50)",
    "SELECT count(*) AS n, arg_max(p, event_id) AS p FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS p, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS w FROM events) GROUP BY w HAVING count(*) = 50",
)

# --- scalar functions ----------------------------------------------------------------------
dialect(
    "math_trigonometry",
    "SELECT event_id, round(acos(value / 1000), 9) AS a, round(asin(value / 1000), 9) AS b, round(atan(value), 9) AS c, round(atan2(value, user_id + 1), 9) AS d, round(cos(value), 9) AS e, round(sin(value), 9) AS f, round(tan(value / 1000), 9) AS g, round(cosh(value / 1000), 9) AS h, round(sinh(value / 1000), 9) AS i, round(tanh(value / 100), 9) AS j, round(cot(value / 1000 + 0.5), 6) AS k, round(radians(value), 9) AS l, round(degrees(value), 6) AS m, acos(value + 2) AS nan FROM events",
    "SELECT event_id, round(acos(value / 1000), 9) AS a, round(asin(value / 1000), 9) AS b, round(atan(value), 9) AS c, round(atan2(value, user_id + 1), 9) AS d, round(cos(value), 9) AS e, round(sin(value), 9) AS f, round(tan(value / 1000), 9) AS g, round(cosh(value / 1000), 9) AS h, round(sinh(value / 1000), 9) AS i, round(tanh(value / 100), 9) AS j, round(1 / tan(value / 1000 + 0.5), 6) AS k, round(radians(value), 9) AS l, round(degrees(value), 6) AS m, CAST(NULL AS DOUBLE) AS nan FROM events",
)
dialect(
    "math_general",
    "SELECT event_id, abs(0 - event_id) AS a, ceil(value) AS b, ceiling(value) AS c, floor(value) AS d, round(value) AS e, round(value, 1) AS f, round(exp(value / 100), 6) AS g, round(ln(value), 9) AS h, round(log(value), 9) AS i, round(log(2, value), 9) AS j, mod(event_id, 7) AS k, round(power(value, 2), 5) AS l, round(pow(value, 0.5), 9) AS m, sign(value - 100) AS n, round(sqrt(value), 9) AS o, round(pi(), 9) AS p, trunc(value, 1) AS q, isnull(sqrt(0 - value)) AS r FROM events",
    "SELECT event_id, abs(0 - event_id) AS a, ceil(value) AS b, ceil(value) AS c, floor(value) AS d, round(value) AS e, round(value, 1) AS f, round(exp(value / 100), 6) AS g, round(ln(value), 9) AS h, round(log10(value), 9) AS i, round(ln(value) / ln(2), 9) AS j, CAST(event_id % 7 AS DOUBLE) AS k, round(pow(value, 2), 5) AS l, round(sqrt(value), 9) AS m, CAST(sign(value - 100) AS BIGINT) AS n, round(sqrt(value), 9) AS o, round(pi(), 9) AS p, trunc(value * 10) / 10 AS q, true AS r FROM events",
)
dialect(
    "math_bits",
    "SELECT event_id, bitand(event_id, 12) AS a, bitor(event_id, 3) AS b, bitxor(event_id, user_id) AS c, bitnot(event_id) AS d, conv(cast(event_id, 'string'), 10, 16) AS e, dec2hex(event_id) AS f, hex2dec(dec2hex(event_id)) AS g FROM events",
    "SELECT event_id, event_id & 12 AS a, event_id | 3 AS b, xor(event_id, user_id) AS c, ~event_id AS d, to_hex(event_id) AS e, '0x' || lower(to_hex(event_id)) AS f, event_id AS g FROM events",
)
dialect(
    "string_functions",
    "SELECT event_id, concat(event_type, '-x') AS a, endswith(event_type, 'k') AS b, startswith(event_type, 'c') AS c, indexof(event_type, 'i') AS d, length(event_type) AS e, upper(event_type) AS f, lower('ABC') AS g, lpad(event_type, 2) AS h, rpad(event_type, 2) AS i, ltrim('  a ') AS j, rtrim(' a  ') AS k, trim('  a  ') AS l, reverse(event_type) AS m, numbytes(event_type) AS n, substring(event_type, 1, 3) AS o, substring(event_type, 2) AS p, split_value(props, ':', -1) AS q FROM events",
    """SELECT event_id, event_type || '-x' AS a, ends_with(event_type, 'k') AS b, starts_with(event_type, 'c') AS c, CAST(strpos(event_type, 'i') - 1 AS BIGINT) AS d, length(event_type) AS e, upper(event_type) AS f, 'abc' AS g, '  ' || event_type AS h, event_type || '  ' AS i, 'a ' AS j, ' a' AS k, 'a' AS l, reverse(event_type) AS m,
    strlen(event_type) AS n, substr(event_type, 2, 3) AS o, substr(event_type, 3) AS p, string_split(props, ':')[-1] AS q FROM events""",
)
dialect(
    "string_patterns",
    "SELECT event_id, regexp_matches(event_type, '^[cv]') AS a, regexp_replace(event_type, '[aeiou]', '_') AS b, regexp_substring(props, '[0-9]+') AS c, regexp_substr(event_type, 'zz') AS d, format(value, 1) AS e, format(value * 1000, 2, 'en_US') AS f FROM events",
    """SELECT event_id, regexp_matches(event_type, '^[cv]') AS a, regexp_replace(event_type, '[aeiou]', '_', 'g') AS b, regexp_extract(props, '[0-9]+') AS c, '' AS d, printf('%.1f', value) AS e, format('{:,.2f}', value * 1000) AS f FROM events""",
)
dialect(
    "array_functions",
    "SELECT event_id, array_position(array_create(1, 2, 2, 3), 2) AS a, array_last_position(array_create(1, 2, 2, 3), 2) AS b, element_at(array_create(5, 6), -1) AS c, element_at(array_create(5, 6), 9) AS d, array_contains(array_create(user_id, 2), 2) AS e, array_contains_any(array_create(1, 2), array_create(2, 9)) AS f, to_json(array_remove(array_create(1, 2, 1), 1)) AS g, to_json(repeat(7, 3)) AS h, to_json(sequence(1, 7, 3)) AS i, to_json(sequence(3, 1)) AS j, to_json(array_concat(array_create(1), array_create(2, 3))) AS k, cardinality(array_create(1, 2)) AS l, array_create(4, user_id)[1] AS m FROM events",
    "SELECT event_id, CAST(1 AS BIGINT) AS a, CAST(2 AS BIGINT) AS b, CAST(6 AS BIGINT) AS c, CAST(NULL AS BIGINT) AS d, true AS e, true AS f, '[2]' AS g, '[7,7,7]' AS h, '[1,4,7]' AS i, '[3,2,1]' AS j, '[1,2,3]' AS k, CAST(2 AS BIGINT) AS l, user_id AS m FROM events",
)
dialect(
    "object_functions",
    "SELECT event_id, to_json(object_construct('b', user_id, 'a', 1)) AS a, to_json(keys(object_construct('b', 1, 'a', 2))) AS b, to_json(values(object_construct('b', 1, 'a', 2))) AS c, to_json(object(array_create('x', 'y'), array_create(1, user_id))) AS d, to_json(object_concat(object_construct('a', 1), object_construct('a', 2, 'b', 3))) AS e, to_json(erase(object_construct('a', 1, 'b', 2), 'a')) AS f, object_size(object_construct('a', 1, 'b', 2)) AS g, to_json(object_pick(object_construct('a', 1, 'b', 2), 'b')) AS h, to_json(obj_to_kvpair_array(object_construct('a', 5))) AS i, to_json(items(object_construct('a', 5))) AS j, to_json(zip(array_create(array_create('p', 'q')))) AS k FROM events",
    """SELECT event_id, '{"a":1,"b":' || user_id || '}' AS a, '["a","b"]' AS b, '[2,1]' AS c, '{"x":1,"y":' || user_id || '}' AS d, '{"a":2,"b":3}' AS e, '{"b":2}' AS f, CAST(2 AS BIGINT) AS g, '{"b":2}' AS h, '[{"key":"a","value":5}]' AS i, '[["a","5"]]' AS j, '{"p":"q"}' AS k FROM events""",
)
dialect(
    "hash_and_encoding",
    "SELECT event_id, md5(props) AS a, sha1(props) AS b, sha256(props) AS c, encode(event_type, 'base64') AS d, decode(encode(event_type, 'base64'), 'base64') AS e, chr(64 + user_id % 26 + 1) AS f, chr(20013) AS g, crc32('weir') AS h, length(sha384(props)) AS i, length(sha512(props)) AS j, coalesce(NULL, user_id) AS k, bypass(value) AS l, isnull(NULL) AS m, length(newuuid()) AS n, tstamp() > 0 AS o, rand() < 1 AS p, delay(1, user_id) AS q, to_json(parse_json(props)) AS r FROM events",
    """SELECT event_id, md5(props) AS a, sha1(props) AS b, sha256(props) AS c, base64(encode(event_type)) AS d, event_type AS e, chr(CAST(64 + user_id % 26 + 1 AS INT)) AS f, '中' AS g, '93848e0c' AS h, CAST(96 AS BIGINT) AS i, CAST(128 AS BIGINT) AS j, user_id AS k, value AS l, true AS m, CAST(36 AS BIGINT) AS n, true AS o, true AS p, user_id AS q, replace(props, ' ', '') AS r FROM events""",
)
dialect(
    "casts",
    "SELECT event_id, cast('12', 'bigint') AS a, cast(event_id, 'float') AS b, cast(user_id, 'string') AS c, cast('1', 'boolean') AS d, cast(ts, 'string') AS e, cast('2024-01-02T03:04:05Z', 'timestamp') AS f FROM events",
    "SELECT event_id, CAST(12 AS BIGINT) AS a, CAST(event_id AS DOUBLE) AS b, CAST(user_id AS VARCHAR) AS c, true AS d, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS e, TIMESTAMP '2024-01-02 03:04:05' AS f FROM events",
)
dialect(
    "time_functions",
    "SELECT event_id, format_time(ts, '%Y/%m/%d %H:%M:%S') AS a, day_name(ts) AS b, day_of_month(ts) AS c, day_of_week(ts) AS d, day_of_year(ts) AS e, from_unix_time(event_id) AS f, hour(ts) AS g, last_day(ts) AS h, microsecond(ts) AS i, minute(ts) AS j, month(ts) AS k, month_name(ts) AS l, second(ts) AS m, day(ts) AS n, length(cur_date()) AS o, length(cur_time()) AS p, now() > ts AS q FROM events",
    """SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS a, dayname(ts) AS b, day(ts) AS c, CAST(dayofweek(ts) + 1 AS BIGINT) AS d, dayofyear(ts) AS e, make_timestamp(event_id * 1000000) AS f, hour(ts) AS g, strftime(last_day(ts), '%Y-%m-%d') AS h, CAST(epoch_us(ts) % 1000000 AS BIGINT) AS i, minute(ts) AS j, month(ts) AS k, monthname(ts) AS l, second(ts) AS m, day(ts) AS n, CAST(10 AS BIGINT) AS o, CAST(15 AS BIGINT) AS p, true AS q FROM events""",
)


# --- sources, shaping, sinks ---------------------------------------------------------------
@frame("decode_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def decode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = schemas.stream_schema({"columns": [{"name": "k", "data_type": "int64"}, {"name": "missing", "data_type": "String"}]})
    return decoders.decode_json(read(spark, sf_dir, "events").select("event_id", "props"), "props", schema)


@frame("sampler_latest", "SELECT arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY epoch_us(ts) // 600000000")
def sampler_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.sample_latest(read(spark, sf_dir, "events"), "ts", "event_id", 600).select("event_id", "value")


@frame("on_change", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.on_change(read(spark, sf_dir, "events"), "event_id", ["event_type"], by=["user_id"]).select("event_id", "user_id", "event_type")


@frame("row_diff", "SELECT event_id, user_id, CASE WHEN event_type IS DISTINCT FROM p THEN event_type END AS event_type, event_type IS DISTINCT FROM p AS sent FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)")
def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return shaping.row_diff(rows, "event_id", ["event_type"], by=["user_id"]).select("event_id", "user_id", "event_type", F.col("__mask")[1].alias("sent"))


@frame("omit_if_empty", """SELECT event_id, b FROM (SELECT event_id, b, bool_or(sent) OVER (PARTITION BY b) AS any_sent FROM (SELECT event_id, event_id // 4 AS b, event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AS sent FROM (SELECT event_id, CASE WHEN event_id % 40 < 20 THEN 'x' ELSE 'y' END AS event_type FROM events))) WHERE any_sent""")
def omit_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 40 < 20, "x").otherwise("y").alias("event_type"))
    sent = shaping.row_diff(rows, "event_id", ["event_type"]).withColumn("__b", F.floor(F.col("event_id") / 4).cast("long"))
    return shaping.omit_if_empty(sent, "__b").select("event_id", F.col("__b").alias("b"))


@frame("late_drop", """SELECT event_id FROM (SELECT event_id, t, max(t) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT event_id, epoch_us(ts) - CASE WHEN event_id % 5 = 0 THEN 7200000000 ELSE 0 END AS t FROM events)) WHERE m IS NULL OR t > m - 3600000000""")
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 5 == 0, 7_200_000_000).otherwise(0))
    return eventtime.drop_late(read(spark, sf_dir, "events").select("event_id", moved.alias("t")), "t", "event_id", 3600).select("event_id")


@frame("event_time", "SELECT event_id, make_timestamp(event_id * 1000000) AS t FROM events WHERE event_id % 3 <> 0")
def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).otherwise("bad").alias("raw"))
    return eventtime.event_time(rows, "raw", "unixtimestamp_s", "t").select("event_id", "t")


@frame("batch_count_json", """SELECT event_id // 100 AS b, '[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY event_id) || ']' AS payload FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS event_id, event_type FROM events) GROUP BY event_id // 100""")
def batch_count_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "events").agg(F.min("event_id")).head()[0] or 0
    rows = read(spark, sf_dir, "events").select((F.col("event_id") - first).alias("event_id"), "event_type", F.col("event_id").alias("__seq"))
    return encoders.encode_json(shaping.batches(rows, "__seq", rows=100), "__seq", "__batch").withColumnRenamed("__batch", "b")


@frame("columnar_json", """SELECT user_id, '{"event_id":[' || string_agg(event_id, ',' ORDER BY event_id) || '],"event_type":[' || string_agg('"' || event_type || '"', ',' ORDER BY event_id) || ']}' AS payload FROM events GROUP BY user_id""")
def columnar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("event_id").alias("__seq"))
    return encoders.columnar_json(rows, "__seq", "user_id", ["event_id", "event_type"])


@frame("columnar_csv_json", """SELECT user_id, '{"event_type":"' || string_agg(event_type, ',' ORDER BY event_id) || '"}' AS payload FROM events GROUP BY user_id""")
def columnar_csv_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", "user_id", F.col("event_id").alias("__seq"))
    return encoders.columnar_csv_json(rows, "__seq", "user_id", ["event_type"])


@frame("template_json", """SELECT event_id, '{"id": ' || event_id || ', "kind": "' || event_type || '"}' AS item FROM events""")
def template_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", encoders.render('{"id": {{ event_id }}, "kind": {{ json(event_type) }}}', rows).alias("item"))


# --- one history for all rows --------------------------------------------------------------
@frame("on_change_all", "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def on_change_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.on_change(read(spark, sf_dir, "events"), "event_id", ["event_type"]).select("event_id", "event_type")


dialect(
    "state_window_all",
    "SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY statewindow(event_type = 'view', event_type = 'purchase')",
    """SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, active, event_type = 'view' AS o, sum(CASE WHEN NOT active AND event_type = 'view' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS w
    FROM (SELECT *, coalesce(last_value(CASE event_type WHEN 'view' THEN true WHEN 'purchase' THEN false END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS active FROM events)) WHERE active OR o GROUP BY w""",
)
dialect(
    "stateful_lifecycle_all",
    "SELECT event_id, round(acc_sum(value, event_type = 'view', event_type = 'purchase'), 3) AS s FROM events",
    """SELECT event_id, round(coalesce(sum(CASE WHEN o THEN value END) OVER (PARTITION BY g ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0), 3) AS s FROM (SELECT *, bool_or(event_type = 'view') OVER (PARTITION BY g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS o
    FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events))""",
)
dialect(
    "sliding_window_last_row",
    "SELECT event_type, user_id, count(value) AS n, round(avg(value), 7) AS a, min(value) AS lo, max(value) AS hi FROM events GROUP BY slidingwindow('ss', 900, 300)",
    """SELECT arg_max(r.event_type, r.event_id) AS event_type, arg_max(r.user_id, r.event_id) AS user_id, count(r.value) AS n, round(avg(r.value), 7) AS a, min(r.value) AS lo, max(r.value) AS hi
    FROM events t JOIN events r ON r.ts BETWEEN t.ts - INTERVAL 900 SECOND AND t.ts + INTERVAL 300 SECOND GROUP BY t.event_id""",
)


# --- nested columns, lists and objects of columns --------------------------------------------
@frame("nested_columns", "SELECT event_id, event_type AS kind, value AS v, CASE WHEN event_id % 2 = 0 THEN user_id ELSE -1 END AS second, value > 100 AS high FROM events")
def nested_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.struct("event_type", F.struct("value").alias("inner")).alias("r"), F.array("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id"))).alias("l"))
    return planner.run("SELECT event_id, r->event_type AS kind, r->inner->value AS v, coalesce(l[1], -1) AS second, r->inner->value > 100 AS high FROM events", rows, EVENTS)


@frame(
    "array_columns",
    """SELECT event_id, CAST(coalesce(list_position(arr, 2), 0) - 1 AS BIGINT) AS a, CAST(CASE WHEN arr[3] = 2 THEN 2 WHEN arr[2] = 2 THEN 1 WHEN arr[1] = 2 THEN 0 ELSE -1 END AS BIGINT) AS b, arr[3] AS c, coalesce(arr[2], -1) AS d, list_contains(arr, 1) AS e,
    replace(replace(list_filter(arr, lambda x: x IS DISTINCT FROM 2)::VARCHAR, ' ', ''), 'NULL', 'null') AS f, replace(replace((arr || [event_id])::VARCHAR, ' ', ''), 'NULL', 'null') AS g
    FROM (SELECT event_id, [user_id % 3, CASE WHEN event_id % 4 <> 0 THEN event_id % 3 END, user_id % 4] AS arr FROM events)""",
)
def array_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 3)
    rows = read(spark, sf_dir, "events").select("event_id", F.array(F.col("user_id") % 3, third, F.col("user_id") % 4).alias("arr"))
    sql = "SELECT event_id, array_position(arr, 2) AS a, array_last_position(arr, 2) AS b, element_at(arr, -1) AS c, coalesce(element_at(arr, 1), -1) AS d, array_contains(arr, 1) AS e, to_json(array_remove(arr, 2)) AS f, to_json(array_concat(arr, array_create(event_id))) AS g FROM events"
    return planner.run(sql, rows, EVENTS)


_PAIR = """CASE WHEN event_type < 'view' THEN '{"' || event_type || '":' || user_id || ',"view":' || event_id || '}' WHEN event_type = 'view' THEN '{"view":' || event_id || '}' ELSE '{"view":' || event_id || ',"' || event_type || '":' || user_id || '}' END"""
dialect(
    "object_columns",
    "SELECT event_id, to_json(object_construct(event_type, user_id, 'view', event_id)) AS a, to_json(keys(object_construct(event_type, user_id))) AS b, object_size(object_construct(event_type, user_id, 'view', event_id)) AS c, to_json(erase(object_construct(event_type, user_id, 'zz', event_id), event_type)) AS d, to_json(object_concat(object_construct(event_type, user_id), object_construct('view', event_id))) AS e, to_json(values(object_construct(event_type, user_id))) AS f FROM events",
    f"""SELECT event_id, {_PAIR} AS a, '["' || event_type || '"]' AS b, CAST(CASE event_type WHEN 'view' THEN 1 ELSE 2 END AS BIGINT) AS c, '{{"zz":' || event_id || '}}' AS d, {_PAIR} AS e, '[' || user_id || ']' AS f FROM events""",
)


# --- streams and sinks of the engine -----------------------------------------------------------
_EVENT_COLUMNS = {"columns": [{"name": "event_id", "data_type": "int64"}, {"name": "event_type", "data_type": "string"}, {"name": "user_id", "data_type": "int64"}, {"name": "value", "data_type": "float64"}, {"name": "at", "data_type": "int64"}]}


def _sunk(spark: SparkSession, sf_dir: str, sql: str, **sink) -> DataFrame:
    """What a sink gets of a query over shuffled events."""
    got, own = [], engine.Engine(spark)
    own.create_stream(engine.Stream("events", _EVENT_COLUMNS, lambda s: read(s, sf_dir, "events").repartition(7), seq="event_id"))
    own.create_pipeline(engine.Pipeline("p", sql, [engine.Sink(lambda df: got.append(scratch.kept(df, "sunk")), **sink)]))
    own.run("p")
    return got[0]


@frame("sink_delta_keyed", "SELECT event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN event_type END AS event_type, count(value) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
def sink_delta_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sunk(spark, sf_dir, "SELECT event_id, event_type, acc_count(value) OVER (PARTITION BY user_id) AS n FROM events", delta=True, delta_columns=["event_type"])
    return found.select("event_id", "event_type", "n")


@frame("sink_batches_shuffled", """SELECT b, '[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY event_id) || ']' AS payload FROM (SELECT event_id, event_type, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS b FROM events WHERE value > 50) GROUP BY b""")
def sink_batches_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sunk(spark, sf_dir, "SELECT event_id, event_type FROM events WHERE value > 50", encoder="json", batch_count=100)
    return found.select(F.col("__batch").alias("b"), "payload")


@frame("sink_omit_batches", """SELECT CASE WHEN sent THEN level END AS level FROM (SELECT level, sent, bool_or(sent) OVER (PARTITION BY b) AS any_sent FROM (SELECT level, level IS DISTINCT FROM lag(level) OVER (ORDER BY event_id) AS sent, (row_number() OVER (ORDER BY event_id) - 1) // 4 AS b FROM (SELECT event_id, CASE WHEN value > 20 THEN 'hi' ELSE 'lo' END AS level FROM events))) WHERE any_sent""")
def sink_omit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sunk(spark, sf_dir, "SELECT CASE WHEN value > 20 THEN 'hi' ELSE 'lo' END AS level FROM events", delta=True, omit_if_empty=True, batch_count=4).select("level")


@frame(
    "event_time_order",
    """SELECT event_id, coalesce(lag(event_id) OVER (ORDER BY t, event_id), -1) AS before FROM (SELECT event_id, t, max(t) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
    FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CASE event_type WHEN 'click' THEN 1800 WHEN 'error' THEN 7200 ELSE 0 END AS t FROM events)) WHERE top IS NULL OR t > top - 3600""",
)
def event_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    behind = F.when(F.col("event_type") == "click", 1800).when(F.col("event_type") == "error", 7200).otherwise(0)
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - behind
    own = engine.Engine(spark)
    own.create_stream(engine.Stream("events", _EVENT_COLUMNS, lambda s: read(s, sf_dir, "events").withColumn("at", at.cast("long")), seq="event_id", event_column="at", event_kind="unixtimestamp_s", late_tolerance=3600))
    return own.query("SELECT event_id, coalesce(lag(event_id), -1) AS before FROM events")

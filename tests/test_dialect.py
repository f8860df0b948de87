"""The dialect on random sequences, against plain folds in Python; and what it refuses."""

import random

import pytest

import weir

SCHEMA = "__seq bigint, key string, x double, n bigint, word string, on boolean, off boolean"


def sequence(seed, size=40):
    rnd = random.Random(seed)
    gap = lambda v: None if rnd.random() < 0.25 else v
    return [(i, rnd.choice("pqr"), gap(rnd.randrange(1, 9) * 0.5), gap(rnd.randrange(4)), gap(rnd.choice(["ash", "elm", "oak"])), rnd.random() < 0.3, rnd.random() < 0.2) for i in range(size)]


def record(row):
    return dict(zip(("seq", "key", "x", "n", "word", "on", "off"), row))


def lag(k=1, skip_null=True):
    def step(seen, taken, v):
        out = seen[-k] if len(seen) >= k else None
        return (seen + [v] if taken and not (skip_null and v is None) else seen), out

    return list, step


def latest():
    return lambda: None, lambda s, taken, v: ((v, v) if taken and v is not None else (s, s))


def changed(skip_null, flag):
    def step(s, taken, v):
        if not taken or skip_null and v is None:
            return s, False if flag else None
        return v, v != s if flag else (v if v != s else None)

    return lambda: None, step


def gathered(finish, nothing):
    def step(s, taken, v):
        s = s + [v] if taken and v is not None else s
        return s, finish(s) if s else nothing

    return list, step


FOLDS = {
    "lag({c})": lambda: lag(), "lag({c}, 3)": lambda: lag(3), "lag({c}, 2, false)": lambda: lag(2, False), "latest({c})": latest, "changed_col(true, {c})": lambda: changed(True, False), "changed_col(false, {c})": lambda: changed(False, False),
    "had_changed(true, {c})": lambda: changed(True, True), "had_changed(false, {c})": lambda: changed(False, True), "acc_count({c})": lambda: gathered(len, 0),
}
NUMBERS = {"acc_sum(x)": lambda: gathered(sum, 0.0), "acc_min(x)": lambda: gathered(min, 0.0), "acc_max(x)": lambda: gathered(max, 0.0), "acc_avg(x)": lambda: gathered(lambda s: sum(s) / len(s), 0.0)}
CALLS = {f.format(c=c): (c, make) for f, make in FOLDS.items() for c in ("n", "word")} | {f: ("x", make) for f, make in NUMBERS.items()}


def folded(rows, column, make, accept, by):
    start, step = make()
    states, out = {}, []
    for r in map(record, rows):
        key = r["key"] if by else None
        states[key], value = step(states.get(key, start()), accept(r), r[column])
        out.append((r["seq"], value))
    return out


def same(got, want):
    assert [i for i, _ in got] == [i for i, _ in want]
    for (_, a), (_, b) in zip(got, want):
        assert a == b or isinstance(a, float) and abs(a - b) < 1e-9, (got, want)


@pytest.mark.parametrize("over, rows", [("", 7), (" OVER (PARTITION BY key)", 1_000_000)])
def test_functions_with_state(spark, over, rows):
    data = sequence(len(over) + rows)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    chosen = list(CALLS) if over else ["lag(n, 3)", "acc_sum(x)", "had_changed(true, word)"]
    for filtered, accept in (("", lambda r: True), (" FILTER (WHERE on)", lambda r: r["on"])):
        for at in range(0, len(chosen), 8):
            names = chosen[at : at + 8]
            sql = "SELECT key AS k, " + ", ".join(f"{c}{filtered}{over} AS f{i}" for i, c in enumerate(names)) + " FROM stream"
            query = weir.plan(sql, ["key", "x", "n", "word", "on", "off"])
            out, sort = query.ordered(df, weir.Options(range_rows=rows))
            got = out.orderBy(*sort).collect()
            for i, c in enumerate(names):
                same([(k, r[f"f{i}"]) for k, r in enumerate(got)], folded(data, CALLS[c][0], CALLS[c][1], accept, over))


@pytest.mark.parametrize("over, rows", [("", 6), (" OVER (PARTITION BY key)", 1_000_000)])
def test_lives(spark, over, rows):
    """Accumulators that begin and are reset, and windows that open and emit."""
    data, states, want = sequence(71), {}, []
    for r in map(record, data):
        key = r["key"] if over else None
        live, values = states.get(key, (False, []))
        live |= r["on"]
        values = values + [r["x"]] if live and r["x"] is not None else values
        want.append((r["seq"], sum(values)))
        states[key] = (False, []) if r["off"] else (live, values)
    df = spark.createDataFrame(data, SCHEMA)
    out, sort = weir.plan(f"SELECT acc_sum(x, on, off){over} AS s FROM stream", ["key", "x", "n", "word", "on", "off"]).ordered(df, weir.Options(range_rows=rows))
    same([(k, r.s) for k, r in enumerate(out.orderBy(*sort).collect())], want)
    for graceful in (True, False):
        held, closed = {}, []
        for r in map(record, data):
            key = r["key"] if over else None
            if key not in held and not r["on"]:
                continue
            fresh = key not in held
            held.setdefault(key, []).append(r["seq"])
            if not fresh and r["off"]:
                closed.append(held.pop(key))
        closed += list(held.values()) if graceful else []
        sql = f"SELECT count(*) AS c, min(n) AS least FROM stream GROUP BY statewindow(on, off){over}"
        got = weir.run(sql, df, weir.Options(graceful=graceful, range_rows=rows)).collect()
        least = lambda w: min((data[i][3] for i in w if data[i][3] is not None), default=None)
        assert sorted(map(repr, ((r.c, r.least) for r in got))) == sorted(repr((len(w), least(w))) for w in closed)


def test_windows_of_rows(spark):
    data = sequence(5)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    whole = [data[i : i + 6] for i in range(0, 36, 6)]
    got = weir.run("SELECT count(n) AS c, last_row(word) AS w, sum(n) + 1 AS s FROM stream GROUP BY countwindow(6)", df).collect()
    want = [(sum(r[3] is not None for r in w), w[-1][4], 1 + sum(r[3] or 0 for r in w) if any(r[3] is not None for r in w) else None) for w in whole]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    keyed = weir.run("SELECT key AS k, count(*) AS c FROM stream GROUP BY countwindow(6), key HAVING count(*) > 1 ORDER BY c DESC, k", df).collect()
    want = sorted((k, sum(r[1] == k for r in w)) for w in whole for k in "pqr" if sum(r[1] == k for r in w) > 1)
    assert sorted((r.k, r.c) for r in keyed) == want


def test_rows_and_aliases(spark):
    data = sequence(6)
    df = spark.createDataFrame(data, SCHEMA)
    got = weir.run("SELECT n + 1 AS m, m * 2 AS d, word FROM stream WHERE m > 2 AND word != 'elm' ORDER BY d DESC, word", df).collect()
    want = [(n + 1, (n + 1) * 2, w) for _, _, _, n, w, *_ in data if n is not None and n + 1 > 2 and w != "elm"]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (-r[1], r[2] is None, r[2] or ""))
    got = weir.run("SELECT lag(on) AS p, lag(n) FILTER (WHERE lag(on)) AS q FROM stream", df).collect()
    assert len(got) == 40 and got[0].p is None
    assert [r.p for r in weir.plan("SELECT lag(on) AS p FROM stream", ["on"]).ordered(df)[0].orderBy("__h0").collect()] == [None, *(r[5] for r in data[:-1])]


def frame(spark, columns):
    rows = [(i, *r) for i, r in enumerate(zip(*columns.values()))]
    return spark.createDataFrame(rows, "__seq bigint, " + ", ".join(f"`{c}` bigint" for c in columns))


REFUSED = [
    "SELECT DISTINCT a FROM stream", "SELECT a FROM stream LIMIT 3", "SELECT a FROM stream UNION SELECT a FROM stream", "SELECT a FROM stream, other", "SELECT a FROM stream JOIN other", "SELECT a FROM (SELECT a FROM stream)",
    "SELECT a FROM stream GROUP BY a", "SELECT a FROM stream HAVING a > 1", "SELECT a AS x, b AS x FROM stream", "SELECT a LIKE 'x' FROM stream", "SELECT a IS NULL FROM stream", "SELECT CAST(a AS bigint) FROM stream", "SELECT nope FROM stream",
    "SELECT lag(a) OVER () FROM stream", "SELECT lag(a) OVER (PARTITION BY b ORDER BY a) FROM stream", "SELECT count(DISTINCT a) FROM stream", "SELECT sum(sum(a)) FROM stream", "SELECT sum(a) FROM stream GROUP BY tumblingwindow('mm', 1)",
    "SELECT sum(a) FROM stream GROUP BY countwindow(0)", "SELECT sum(a) FROM stream GROUP BY countwindow(1), countwindow(2)", "SELECT acc_sum(a, true) FROM stream", "SELECT a FROM stream ORDER BY a NULLS FIRST", "SELECT a + 1 AS b FROM stream",
    "SELECT a FROM stream WHERE a", "SELECT lag(sum(a)) FROM stream", "SELECT sum(a) FROM stream GROUP BY sessionwindow('ss', 3)",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(ValueError):
        weir.run(sql, frame(spark, {"a": [1], "b": [2]}))


@pytest.mark.parametrize("back, ahead", [(1, 0), (7, 0), (7, 3), (5, 20)])
def test_sliding_windows(spark, back, ahead):
    """Windows of rows in any order of time, with ties and nulls, against a scan of all rows for each."""
    rng = random.Random(back * 31 + ahead)
    rows = [(i, rng.choice([None, *range(-9, 60)]), rng.choice([None, 1, 2, 30, 2**31 - 1]), rng.choice([None, 0.5, 2.25, -8.0]), [rng.choice("xyz")]) for i in range(150)]
    df = spark.createDataFrame(rows, "__seq long, t long, a int, b double, c array<string>").selectExpr("__seq", "timestamp_seconds(t) AS __ts", "a", "b", "c").repartition(5)
    sql = f"SELECT c, count(*) AS n, count(a) AS na, sum(a) AS s, avg(b) AS m, min(b) AS lo, max(a) AS hi, last_row(b) AS z FROM s GROUP BY slidingwindow('ss', {back}{f', {ahead}' if ahead else ''})"
    found, want = [tuple(r) for r in weir.run(sql, df).collect()], []
    for i, t, *_ in rows:
        if t is not None:
            seen = [r for r in rows if r[1] is not None and t - back <= r[1] <= t + ahead and (ahead or r[1] < t or r[0] <= i)]
            a, b = [r[2] for r in seen if r[2] is not None], [r[3] for r in seen if r[3] is not None]
            want.append((seen[-1][4], len(seen), len(a), min(sum(a), 2**31 - 1) if a else None, sum(b) / len(b) if b else None, min(b, default=None), max(a, default=None), seen[-1][3]))
    assert sorted(found, key=repr) == sorted(want, key=repr)
    # nothing is joined, so the work doesn't grow with the rows of a window
    assert "Join" not in weir.run(sql, df)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("back, ahead", [(1, 0), (7, 0), (7, 3), (5, 20)])
def test_sliding_windows_by_key(spark, back, ahead):
    """Groups of sliding windows, by keys some of which are null, against a scan of all rows for each."""
    rng = random.Random(back * 37 + ahead)
    rows = [(i, rng.choice([None, *range(-9, 60)]), rng.choice([None, "p", "q", "r"]), rng.choice([None, 1, 2, 30, 2**31 - 1]), rng.choice([None, 0.5, 2.25, -8.0]), {"x": rng.randrange(2)}) for i in range(150)]
    df = spark.createDataFrame(rows, "__seq long, t long, k string, a int, b double, o map<string, int>").selectExpr("__seq", "timestamp_seconds(t) AS __ts", "k", "a", "b", "o").repartition(5)
    slides = f"slidingwindow('ss', {back}{f', {ahead}' if ahead else ''})"
    asked = "count(*) AS n, count(a) AS na, sum(a) AS s, avg(b) AS m, min(b) AS lo, max(a) AS hi, last_row(b) AS z"
    for sql, key in (
        (f"SELECT k, a + 0 AS e, {asked} FROM s GROUP BY {slides}, k, a + 0", lambda r: (r[2], r[3])),
        (f"SELECT b, k, {asked} FROM s GROUP BY {slides}, k HAVING count(*) > 0", lambda r: (r[2],)),
        (f"SELECT o['x'] AS x, {asked} FROM s GROUP BY {slides}, o", lambda r: (r[5]["x"],)),
    ):
        found, want = [tuple(r) for r in weir.run(sql, df).collect()], []
        for i, t, *_ in rows:
            seen = [r for r in rows if t is not None and r[1] is not None and t - back <= r[1] <= t + ahead and (ahead or r[1] < t or r[0] <= i)]
            for k in {key(r) for r in seen}:
                group = [r for r in seen if key(r) == k]
                a, b = [r[3] for r in group if r[3] is not None], [r[4] for r in group if r[4] is not None]
                shown = (group[-1][4], *k) if sql.startswith("SELECT b") else k
                want.append((*shown, len(group), len(a), min(sum(a), 2**31 - 1) if a else None, sum(b) / len(b) if b else None, min(b, default=None), max(a, default=None), group[-1][4]))
        assert sorted(found, key=repr) == sorted(want, key=repr)


def joined(plan):
    """How many rows the joins of a plan that has run gave."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return sum(map(joined, inner)) + (plan.metrics().apply("numOutputRows").value() if name.endswith("Join") else 0)


def test_sliding_windows_by_key_join_no_rows(spark):
    """Only the groups of the result are joined, however many rows a window has."""
    df = spark.range(600).selectExpr("id AS __seq", "timestamp_millis(id) AS __ts", "id % 2 AS k")
    got = weir.run("SELECT k, count(*) AS n FROM s GROUP BY slidingwindow('ss', 5, 5), k", df)
    assert {tuple(r) for r in got.collect()} == {(0, 300), (1, 300)}
    assert joined(got._jdf.queryExecution().executedPlan()) == 1200

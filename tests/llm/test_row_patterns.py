"""Row patterns against a plain reading of the pattern, row by row, with Python's backtracking."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from biblens.llm import row_patterns as R

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
BEGAN = dt.datetime(2024, 1, 1)


def plain(rows, gap=dt.timedelta(minutes=15)):
    """The matches of all clients: letters tried at each row in turn, backtracking in code of its own."""
    out = []
    clients = {}
    for r in set(rows):
        if r[3] is not None and r[1] is not None:
            clients.setdefault(r[3], []).append(r)
    for client, own in clients.items():
        own.sort(key=lambda r: (r[1], r[0], r[4] is not None, r[4] or "", r[5] is not None, r[5] or 0))
        cents = [None if r[5] is None or not math.isfinite(r[5]) else math.floor(100 * r[5] + 0.5) for r in own]

        def fits(letter, i, goal):
            if cents[i] is None or own[i][1] - own[i - 1][1] > gap:
                return False
            if letter == "P":
                return own[i][4] == "view" and cents[i] >= goal
            if own[i][4] in (None, "error") or cents[i - 1] is None:
                return False
            return cents[i] < cents[i - 1] if letter == "D" else cents[i] > cents[i - 1]

        def match(s):
            """The greedy choice first: on with D or U as far as possible, then P, then D."""
            text, i = "", s + 1
            while i < len(own) and (letter := next((x for x in "DU" if fits(x, i, None)), None)):
                text, i = text + letter, i + 1
            while True:
                if i < len(own) and fits("P", i, cents[s]):
                    tail = i + 1
                    while tail < len(own) and fits("D", tail, None):
                        tail += 1
                    return "A" + text + "P" + "D" * (tail - i - 1)
                if not text:
                    return None
                text, i = text[:-1], i - 1

        at, no = 0, 0
        while at < len(own):
            found = match(at) if cents[at] is not None else None
            if found is None:
                at += 1
                continue
            assert re.fullmatch("A(D|U)*PD*", found)
            end, no = at + len(found) - 1, no + 1
            out.append((client, no, own[at][0], own[end][0], len(found), sum(cents[at : end + 1]), found))
            at = end
    return sorted(out)


def some_rows(seed, n, clients, breaks=0.1):
    rng, rows = random.Random(seed), []
    clock = {c: BEGAN for c in clients}
    for i in range(n):
        c = rng.choice(clients)
        late = rng.random()
        clock[c] += dt.timedelta(minutes=16) if late < breaks / 2 else dt.timedelta(minutes=15) if late < breaks else dt.timedelta(seconds=rng.choice([0, 0, 1, 30]))
        kind = rng.choice(["view", "view", "click", "purchase"]) if rng.random() > breaks / 2 else rng.choice([None, "error"])
        value = None if rng.random() < breaks / 4 else rng.choice([float("nan"), float("inf")]) if rng.random() < breaks / 10 else rng.randint(-3, 12) / rng.choice([1, 8, 100])
        rows.append((i, clock[c], BEGAN, c, kind, value, "{}"))
    return rows


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA) if rows else spark.createDataFrame([], SCHEMA)
    return sorted(tuple(r) for r in R.find(df, **options).select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels").collect())


@pytest.mark.parametrize("most", [3, 4096])
def test_equals_plain_search(spark, most):
    rows = some_rows(most, 1500, [1, 1, 1, 1, 2, 3, None])
    rows += rows[::9] + [(9000, None, BEGAN, 1, "view", 1.0, "{}"), (9001, None, None, None, None, None, None)]
    want = plain(rows)
    assert len(want) > 100
    assert got(spark, rows, long_rows=most) == want


def test_long_segments(spark):
    """A client of one segment over all slices, a match of nearly all rows, one of falling rows after its goal, and a run without any goal."""
    t = lambda i: BEGAN + dt.timedelta(seconds=i)
    one = [(5000 + r[0], *r[1:]) for r in some_rows(5, 700, [5], breaks=0)]
    up = [(i, t(i), None, 1, "click", float(i), None) for i in range(300)] + [(300, t(300), None, 1, "view", 1e6, None)]
    down = [(1000 + i, t(i), None, 2, "view" if i < 2 else "click", 5.0 if i < 2 else -float(i), None) for i in range(300)]
    bare = [(2000 + i, t(i), None, 3, "click", float(i % 7), None) for i in range(300)]
    rows = one + up + down + bare
    want = plain(rows)
    assert [m[4] for m in want if m[0] < 5] == [301, 300] and max(m[4] for m in want if m[0] == 5) > 5
    for most in (20, 4096):
        assert got(spark, rows, long_rows=most) == want


def test_empty_extra_columns_and_ties(spark):
    assert got(spark, []) == []
    a = dt.datetime(2024, 1, 1)
    rows = [(1, a, a, 1, "view", 1.0, "x"), (1, a, a, 1, "view", 1.0, "y"), (1, a, a, 1, "view", 1.0, "y")]
    assert got(spark, rows) == [(1, 1, 1, 1, 2, 200, "AP")] == plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.lit(1), "Piece": F.lit("p"), "_slice": F.lit(None).cast("int"), "labels": F.lit("l")})
    assert R.find(df).count() == 1


def test_steps_of_time_and_cents(spark):
    """15 minutes still count, a microsecond more does not; halves of cents round up."""
    a, late = BEGAN, dt.timedelta(minutes=15)
    rows = [(1, a, None, 1, "click", 0.125, None), (2, a + late, None, 1, "view", 0.125, None), (3, a + 2 * late + dt.timedelta(microseconds=1), None, 1, "view", 9.0, None)]
    assert got(spark, rows) == [(1, 1, 1, 2, 2, 26, "AP")] == plain(rows)


def test_query_on_the_given_table(spark):
    from biblens.llm.queries import op11_row_patterns

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/clicks.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    import hashlib

    want = [(*m[:6], hashlib.sha256(m[6].encode()).hexdigest()) for m in plain(rows)]
    names = ("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256")
    assert sorted(tuple(r) for r in op11_row_patterns(spark, d).select(*names).collect()) == want

"""Mixing against plain Python: targets, quotas by highest quotients, and the defined cases."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import mixing
from tallyspark.llm.queries import ORACLES
from tests.oracle import connect, difference

SCHEMA = "doc_id long, source string, text string, size string, target double, place int, key string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", -1.0, 7, "k") for r in rows], SCHEMA)


def plain_targets(sizes: dict, weights=(5, 2, 1), repeat=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped: dict = {}
    while True:
        left, heavy = sum(sizes.values()) - sum(stopped.values()), sum(weight[s] for s in names if s not in stopped)
        over = [s for s in names if s not in stopped and weight[s] * left / heavy > repeat * sizes[s]]
        if not over:
            return {s: stopped.get(s, weight[s] * left / max(heavy, 1)) for s in names}
        stopped |= {s: repeat * sizes[s] for s in over}


def plain_seats(votes: dict, most: dict, house: int) -> Counter:
    seats, queue = Counter(), [(-v, p) for p, v in votes.items() if most[p]]
    heapq.heapify(queue)
    while queue and sum(seats.values()) < house:
        _, p = heapq.heappop(queue)
        seats[p] += 1
        if seats[p] < most[p]:
            heapq.heappush(queue, (-votes[p] / (2 * seats[p] + 1), p))
    return seats


@pytest.fixture(scope="module")
def rows():
    made = [(i, f"s{i % 3}", "w " * (i % 40)) for i in range(300)]
    made += [(None, "s0", "null id here " * 9), (1000, None, "no source " * 70), (1001, "tiny", "one"), (1002, "", "x y z " * 400), (1003, "empty", None)]
    made += [(1004, "empty", ""), (1005, "s1", "\t\n "), (1006, "s1", "lang " * 30_000)]
    return made + [(2000, "hot", "the same row again")] * 300 + [(None, "s2", None)] * 150


def test_targets_and_taken_words(spark, rows):
    found = mixing.mix(documents(spark, rows), shard_words=2048).collect()
    assert len(found) == len(rows)
    sizes, source = defaultdict(int), {}
    for doc_id, name, text in rows:
        sizes[name] += len((text or "").split())
        source.setdefault(doc_id, name)
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in found:
        name = source[r.doc_id] if r.doc_id is not None else next(s for s in ("s0", "s2") if abs(r.target - want[s]) < 1e-6)
        assert r.source_size == sizes[name] and r.target == pytest.approx(want[name])
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum((p.end - p.begin) * p.times for p in r.pieces)
        assert all(0 <= p.begin < p.end <= r.size and p.times in (1, 2, 3) for p in r.pieces)
        assert [p.begin for p in r.pieces] == sorted(p.begin for p in r.pieces)
        taken[name] += r.taken
    for name, size in sizes.items():
        assert abs(taken[name] - want[name]) <= max(2 * mixing.BLOCK, 0.01 * want[name]), name
    assert any(want[s] == 3 * sizes[s] for s in sizes) and taken["tiny"] == 3


def test_reruns_and_partitions_agree(spark, rows):
    order = ["doc_id", "size", "source_size", "taken"]
    first = mixing.mix(documents(spark, rows), shard_words=2048).select(*order).orderBy(*order).collect()
    again = mixing.mix(documents(spark, rows[::-1]).repartition(13), shard_words=2048).select(*order).orderBy(*order).collect()
    assert first == again


def test_query_matches_its_sql_on_odd_rows(spark, rows):
    con = connect("/nowhere")
    frame = documents(spark, rows)
    con.register("documents", frame.toArrow())
    found = mixing.mix(frame).select("doc_id", "size", "source_size", "target", "taken")
    assert difference(con, found, ORACLES["op11_mixing"]) is None


@pytest.mark.parametrize("parties, scale", [(1, 10.0), (7, 0.4), (60, 3.0), (400, 1.1)])
def test_seats_go_by_highest_quotients(spark, parties, scale):
    votes = {p: scale * (1 + (p * 7919) % 101 / 10) if p % 11 else 0.0 for p in range(parties)}
    votes |= {1: sum(votes.values())} if parties > 1 else {}
    most = {p: 3 * (int(v) + 1) for p, v in votes.items()}
    house = round(sum(votes.values()))
    given = spark.createDataFrame([(0, p, v, most[p], house) for p, v in votes.items()], "g int, p int, votes double, most long, house long")
    found = {r.p: r.seats for r in mixing.apportion(given, "g", "p").collect()}
    assert sum(found.values()) == house and {p: n for p, n in found.items() if n} == dict(plain_seats(votes, most, house))


def test_empty_tables(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    nothing = mixing.mix(documents(spark, [(1, "a", None), (2, "b", " ")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in nothing] == [(0, 0, 0.0, 0)] * 2


def test_no_python_in_the_plan(spark, rows):
    plan = mixing.mix(documents(spark, rows).where(F.col("doc_id") < 9))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

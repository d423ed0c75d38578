from collections import defaultdict

from millrace.llm import mixing as d
from millrace.llm.catalog import OP4_SQL, op4_mixing
from tests.oracle import assert_same


def plain_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), list(names), float(sum(sizes.values()))
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        gain = {s: rest * weight[s] / total for s in open_}
        rest = 0.0
        for s in list(open_):
            target[s] += gain[s]
            if target[s] >= cap * sizes[s]:
                rest += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.remove(s)
    return target


def test_query_agrees_with_sql(spark):
    assert_same(spark, "/root/testdata/sf0.001", op4_mixing, OP4_SQL)


def test_targets_equal_rounds_of_resharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "d": 1, None: 100}, {"a": 1, "b": 1, "c": 1000000}, {"x": 0, "y": 0}, {"z": 7}):
        table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in d.targets(table).collect()}
        want = plain_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_edge_cases_and_reruns(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}", 0) for i in range(200)] + [(None, "a b", "s1", 0), (None, "a b", "s1", 0), (5, None, None, 0), (6, "x\x1fy \x0bz", None, 0), (7, "", "empty", 0), (8, "long " * 40000, "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    got = d.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, d.mix(docs.repartition(5)).collect()), key=repr)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size, r.target] += r.taken
    for (_, goal), words in taken.items():
        assert abs(words - goal) <= 1
    assert {r.size for r in got if r.doc_id == 6 and r.source_size == 2} <= {2}
    mixed = d.repeat(docs)
    assert mixed.columns == docs.columns
    assert d.mix(docs.limit(0)).count() == 0 and d.repeat(docs.limit(0)).count() == 0

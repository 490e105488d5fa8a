"""Cycle detection against depth-first search, and the number of rounds of a long chain."""

import random

from celstack.operators import graph


def has_cycle(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    done = set()
    for start in out:
        stack, path = [(start, iter(out[start]))], {start}
        while stack:
            node, further = stack[-1]
            step = next(further, None)
            if step is None:
                done.add(node)
                path.discard(node)
                stack.pop()
            elif step in path:
                return True
            elif step not in done and step in out:
                path.add(step)
                stack.append((step, iter(out[step])))
    return False


def graphs():
    rng, made = random.Random(2), []
    for _ in range(60):
        n = rng.randint(2, 12)
        made.append([(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 16))])
    made.append([(i, i + 1) for i in range(40)])
    made.append([(i, (i + 1) % 40) for i in range(40)])
    made.append([(i // 2, i) for i in range(1, 60)] + [(59, 30), (30, 99)])
    made.append([(2 * i + a, 2 * i + 2 + b) for i in range(6) for a in (0, 1) for b in (0, 1)])  # a ladder
    made.append(made[-1] + [(12, 1)])
    return made


def test_cycles_of_many_graphs(spark):
    made = graphs()
    rows = [(k if k else None, a, b) for k, edges in enumerate(made) for a, b in edges]
    got = {r["p"] for r in graph.cyclic_graphs(spark.createDataFrame(rows, "p int, behind int, front int"), ["p"]).collect()}
    assert got == {k if k else None for k, edges in enumerate(made) if has_cycle(edges)}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or plain(df))
    chain = spark.range(10_000).selectExpr("1 as p", "id as behind", "id + 1 as front")
    assert graph.cyclic_graphs(chain, ["p"]).collect() == []
    closed = chain.unionByName(spark.createDataFrame([(2, 0, 1), (2, 1, 0)], "p int, behind bigint, front bigint"))
    assert [r["p"] for r in graph.cyclic_graphs(closed, ["p"]).collect()] == [2]
    assert len(written) < 80  # tables written in both runs: two rounds with some fifteen doublings each

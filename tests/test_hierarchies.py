"""Depths and cycles of hierarchies against brute force, long chains and dense cyclic parts."""

import random

from pyspark.sql import functions as F

from strataweave.operators import graph

LINKS = "child string, parent string"


def brute_depth(links):
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    nodes, depth = {n for link in links for n in link}, {}
    while True:
        new = {n: max((depth[p] + 1 for p in up.get(n, ())), default=0) for n in nodes - depth.keys() if all(p in depth for p in up.get(n, ()))}
        if not new:
            return {n: depth.get(n) for n in nodes}
        depth |= new


def brute_cycles(links):
    down, found = {}, set()
    for c, p in set(links):
        down.setdefault(c, []).append(p)

    def walk(path):
        for n in down.get(path[-1], ()):
            if n == path[0]:
                found.add(">".join(path))
            elif n > path[0] and n not in path:
                walk([*path, n])

    for n in down:
        walk([n])
    return found


def test_depths_and_cycles_of_random_links(spark):
    random.seed(11)
    links = []
    for part in range(12):  # some with cycles, some without, with chains, branches and self loops
        n = 9
        for i in range(1, n):
            links.append((f"{part}-{i}", f"{part}-{i - 1 if random.random() < 0.6 else random.randrange(i)}"))
        links += [(f"{part}-{random.randrange(n)}", f"{part}-{random.randrange(n)}") for _ in range(part % 4)]
    frame = spark.createDataFrame([*links, links[0], ("lone", None)], LINKS)
    assert {r.node: r.depth for r in graph.hierarchy_depth(frame).collect()} == brute_depth(links)
    cycles = brute_cycles(links)
    assert len(cycles) > 5 and sorted(r.cycle for r in graph.cycles(frame).collect()) == sorted(cycles)
    first = sorted(cycles, key=lambda c: (c.count(">"), c))[:3]
    assert [r.cycle for r in graph.cycles(frame, 3).collect()] == first
    empty = spark.createDataFrame([], LINKS)
    assert graph.hierarchy_depth(empty).isEmpty() and graph.cycles(empty).isEmpty()


def test_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    chain = spark.range(1, n).select(F.col("id").cast("string").alias("child"), (F.col("id") - 1).cast("string").alias("parent"))
    more = spark.createDataFrame([("top", str(n - 1)), ("top", "5"), ("leaf", "top"), ("x", "y"), ("y", "x"), ("z", "x")], LINKS)
    got = graph.hierarchy_depth(chain.union(more))
    assert got.filter("not cyclic and node rlike '^[0-9]+$' and depth <> cast(node as int)").isEmpty()
    rest = {r.node: (r.depth, r.cyclic) for r in got.filter("node not rlike '^[0-9]+$'").collect()}
    assert rest == {"top": (n, False), "leaf": (n + 1, False), "x": (None, True), "y": (None, True), "z": (None, True)} and got.count() == n + 5


def test_a_dense_cyclic_part_gives_its_first_cycles(spark):
    links = [(f"n{i:02d}", f"n{j:02d}") for i in range(30) for j in range(30) if i != j]
    got = [r.cycle for r in graph.cycles(spark.createDataFrame(links, LINKS), 5).collect()]
    assert got == [f"n00>n{j:02d}" for j in range(1, 6)]

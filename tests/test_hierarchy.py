import random

from notewarp.operators.hierarchy import ancestor_pairs, folder_report, hierarchy, paths
from notewarp.session import cut

SCHEMA = "id string, parent_folder_id string, name string, depth int"


def brute(rows):
    nodes = {}
    for i, p, *_ in rows:
        if i is None or not i.strip():
            continue
        nodes.setdefault(i.strip(), set()).add((p or "").strip() or None)
    parent = {i: min((p for p in ps if p in nodes), default=None) for i, ps in nodes.items()}
    out, below = {}, {i: 0 for i in nodes}
    for i in nodes:
        seen, at = [i], i
        while parent[at] is not None and parent[at] not in seen:
            at = parent[at]
            seen.append(at)
        out[i] = (at, len(seen) - 1) if parent[at] is None else ("cycle", -1)
        if parent[at] is None:
            for a in seen[1:]:
                below[a] += 1
    return {(i, r, d, below[i] if r != "cycle" else -1) for i, (r, d) in out.items()}


def got(spark, rows):
    return {tuple(r) for r in folder_report(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_random_forests_with_loops(spark):
    rng = random.Random(3)
    rows = [(f"n{i}", f"n{rng.randrange(40)}" if rng.random() < 0.8 else rng.choice([None, "", "gone", "  "]), "x", 1) for i in range(40)]
    rows += [rows[3], (" n5 ", rows[5][1], "y", 2), (None, "n1", "z", 3), ("  ", "n1", "z", 3)]
    assert got(spark, rows) == brute(rows)


def test_deep_chain_under_and_above_a_loop(spark):
    rows = [(f"c{i}", f"c{i + 1}", None, None) for i in range(70)] + [("c70", None, None, None)]
    rows += [("l1", "l2", None, None), ("l2", "l3", None, None), ("l3", "l1", None, None), ("self", "self", None, None)]
    rows += [(f"t{i}", f"t{i + 1}" if i < 20 else "l1", None, None) for i in range(21)]
    assert got(spark, rows) == brute(rows)


def test_hot_parent_in_salted_groups(spark, monkeypatch):
    from notewarp.operators import hierarchy as h

    monkeypatch.setattr(h, "GROUP_SIBLINGS", 7)
    rows = [("root", None, None, None)] + [(f"k{i}", "root", None, None) for i in range(60)] + [(f"g{i}", f"k{i % 5}", None, None) for i in range(30)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == set()


def test_paths_and_pairs(spark):
    rows = [("a", None, "A", 0), ("b", "a", "B", 0), ("c", "b", None, 0), ("d", "a", "D", 0), ("x", "x", "X", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = cut(hierarchy(df))
    assert {(r.ancestor, r.id) for r in ancestor_pairs(nodes).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d")}
    assert {r.id: r.path for r in paths(nodes, df.select("id", "name")).collect()} == {"a": "A", "b": "A/B", "c": "A/B/", "d": "A/D", "x": None}

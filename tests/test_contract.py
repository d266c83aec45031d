import itertools
import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from millrace.operators import components, contract, name_merge

# Field names with the number of runs that saw them, in order of first appearance
# (recorded result for a coffee machine), and the groups they merge into.
COUNTS = None


def _norm_pairs(names, least=name_merge.CONFIRM):
    out = set()
    for a, b in itertools.combinations(names, 2):
        ta, tb = set(a.split("_")), set(b.split("_"))
        if any(ta & set(g) and tb & set(g) and ta & set(g) != tb & set(g)
               for g in name_merge.ANTONYMS):
            continue
        score = 0.6 * len(ta & tb) / len(ta | tb) + 0.4 * SequenceMatcher(None, a, b).ratio()
        if ta & tb and score >= 0.55 and round(score, 3) >= least:
            out.add((a, b, round(score, 3)))
    return out


def _names_frame(spark, names):
    return spark.createDataFrame([("m", n, 0, i) for i, n in enumerate(names)],
                                 "scope string, name string, first_run int, first_ord int")


def _random_names(seed, n, words="temp water milk flow in out min max start stop boiler pump a b"):
    rng = random.Random(seed)
    words = words.split()
    names = ["_".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(n)]
    return list(dict.fromkeys(names))


def test_blocked_join_finds_every_pair(spark):
    for seed, least in ((1, name_merge.CONFIRM), (2, name_merge.CONFIRM), (3, name_merge.REVIEW)):
        names = _random_names(seed, 120)
        found = name_merge.similar_names(_names_frame(spark, names), least, block_rows=7)
        rows = [(r.name_a, r.name_b, r.rounded) for r in found.collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == _norm_pairs(names, least)


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [("s", f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(45)]
    edges += [("s", f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    edges = [e for e in edges if e[1] != e[2]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    frame = spark.createDataFrame(edges, "scope string, name_a string, name_b string")
    labels = {r.name: r.label for r in name_merge.connected_components(frame).collect()}
    assert labels == {x: find(x) for x in parent}


def test_long_chain_in_few_rounds(spark, monkeypatch):
    rounds, plain = [], components.reliable_checkpoint
    monkeypatch.setattr(components, "reliable_checkpoint", lambda df: rounds.append(1) or plain(df))
    order = list(range(2000))
    random.Random(3).shuffle(order)
    for nodes in (list(range(2000)), order):
        rounds.clear()
        edges = spark.createDataFrame([(i % 1, a, b) for i, (a, b) in enumerate(zip(nodes, nodes[1:]))] + [(1, 7, 9), (1, 5, 5)], "s int, a int, b int")
        found = components.star_components(edges, ["s"], "a", "b").collect()
        assert sorted((r.s, r.node, r.root) for r in found) == [(0, i, 0) for i in range(2000)] + [(1, 7, 7), (1, 9, 7)]
        assert len(rounds) <= 15, len(rounds)
    assert components.star_components(edges.filter("false"), ["s"], "a", "b").count() == 0


def test_ratio_bound_is_a_bound(spark):
    names = _random_names(9, 60) + ["x9_é", "é_9", "", "_"]
    df = spark.createDataFrame([(a, b) for a in names for b in names[:20]], "a string, b string").filter("a <> '' or b <> ''")
    bound = name_merge.ratio_bound(*[name_merge.letter_counts(F.col(c)) for c in "ab"], F.length("a"), F.length("b"))
    for r in df.select("a", "b", bound.alias("bound")).collect():
        assert SequenceMatcher(None, r.a, r.b).ratio() <= r.bound + 1e-12


def test_canonical_and_conflict(spark):
    counts = spark.createDataFrame(
        [("m", "temp_min", 1, 0, 0), ("m", "temp", 3, 0, 1), ("m", "temp_max", 3, 0, 2),
         ("m", "flow", 1, 0, 3)],
        "scope string, name string, n_runs int, first_run int, first_ord int")
    edges = spark.createDataFrame([("m", "temp_min", "temp"), ("m", "temp", "temp_max")],
                                  "scope string, name_a string, name_b string")
    rows = {r.name: r for r in name_merge.merge_names(counts, edges).collect()}
    assert {n: r.canonical for n, r in rows.items()} == {
        "temp_min": "temp", "temp": "temp", "temp_max": "temp", "flow": "flow"}
    assert rows["temp"].conflict_in_group and not rows["flow"].conflict_in_group


def test_lenient_json(spark):
    cases = {
        '{"a": 1}': {"a": 1}, '```json\n[1, 2]\n```': [1, 2], 'Sure: {"a": 2} done': {"a": 2},
        'x [1] y': [1], '{"a":1} junk': {"a": 1}, "none": None, "": None,
        'list [{"a":1},{"b":2}] end': [{"a": 1}, {"b": 2}], '[{"a":1}] x': {"a": 1},
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for row in df.select("t", contract.lenient_json(F.col("t")).alias("v")).collect():
        assert (json.loads(row.v) if row.v is not None else None) == cases[row.t], row.t


def test_runs_to_contract(spark):
    runs = [
        ("m", 0, '```json\n[{"field_name": "Water Temp", "unit": "C", "category": ""},'
                 ' {"field_name": "water-temp", "unit": "F"}, {"field_name": "%%"}]\n```'),
        ("m", 1, '[{"field_name": "water_temp"}, {"field_name": "temp_water", "unit": "K",'
                 ' "typical_range": " 80 -  90 "}]'),
        ("m", 2, 'Here: [{"field_name": "lonely"}] ok'),  # parses to an object: dropped
        ("m", 3, "no json"),
    ]
    df = spark.createDataFrame(runs, "scope string, run int, text string")
    fields = contract.dedupe_fields(contract.normalize_fields(contract.parse_runs(df)))
    counts = {r.name: r.n_runs for r in contract.field_counts(fields).collect()}
    assert counts == {"water_temp": 2, "temp_water": 1}
    rep = {r.name: r.record for r in contract.representatives(fields).collect()}
    assert rep["water_temp"].unit == "c" and rep["water_temp"].category is None
    assert rep["temp_water"].typical_range == "80 - 90"
    groups = spark.createDataFrame(
        [("m", "temp_water", "water_temp"), ("m", "water_temp", "water_temp"),
         ("m", "gone", "gone")], "scope string, name string, canonical string")
    final = contract.final_contract(groups, contract.representatives(fields)).collect()
    assert [(r.field_name, r.unit) for r in final] == [("water_temp", "c")]


def test_blocks_of_edges_are_contracted(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(components, "BLOCK_EDGES", 6)
    edges = sorted([(1, "b", "a"), (1, "c", "b")] + [(2, "y", "x"), (2, "z", "y"), (2, "q", "p")] + [(3, "é", "z"), (3, "z", "a")]
                   + [(4, chr(98 + i), chr(97 + i)) for i in range(9)], key=lambda e: e[0])
    batches = [pa.RecordBatch.from_pylist([dict(zip("suv", e)) for e in edges[i:i + 3]]) for i in range(0, len(edges), 3)]
    rows = [tuple(r.values()) for b in components._least_of_blocks(iter(batches), 1) for r in b.to_pylist()]
    assert [r for r in rows if not r[3]] == [(2, "p", "p", False), (2, "q", "p", False), *[(2, n, "x", False) for n in "xyz"]]
    assert {r[0] for r in rows if r[3]} == {1, 3, 4}
    assert {(3, "é", "z"), (3, "z", "a"), (1, "c", "a")} <= {r[:3] for r in rows}


def test_components_of_many_small_scopes_and_a_large_one(spark):
    rng = random.Random(4)
    edges = [(s % 50, f"n{rng.randrange(12):02}", f"n{rng.randrange(12):02}") for s in range(600)]
    edges += [(99, f"n{rng.randrange(900):04}", f"n{rng.randrange(900):04}") for _ in range(700)]
    edges += [(99, f"n{i:04}", f"n{i + 1:04}") for i in range(2000, 2100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, a, b in edges:
        if a != b:
            low, high = sorted((find((s, a)), find((s, b))))
            root[high] = low
    df = spark.createDataFrame(edges, "s int, a string, b string").repartition(5)
    got = components.star_components(df, ["s"], "a", "b").collect()
    assert sorted(tuple(r) for r in got) == sorted((*x, find(x)[1]) for x in root)

"""Questions to the graph against plain code on random graphs: many roots, many queries, very long careers, late visits."""

import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from attestry.plans import graph as G
from attestry.streaming import streams

EDGE = "id string, subject_entity_id string, predicate string, object_entity_id string, valid_from string, valid_to string, observed_at string"


def random_graph(spark, seed, n, m):
    r = random.Random(seed)
    kinds = {f"n{k}": r.choice(["A", "B", "C"]) for k in range(n)}
    hub = lambda: f"n{min(r.randrange(n), r.randrange(n), r.randrange(n))}"
    edges = [(f"e{k}", hub(), r.choice(["P", "Q"]), hub(), None, None, r.choice([None, f"2020-01-{r.randint(10, 28)}"])) for k in range(m)]
    return kinds, edges, spark.createDataFrame([(k, t, k) for k, t in kinds.items()], "id string, entity_type string, canonical_name string"), spark.createDataFrame(edges, EDGE)


def walked(edges, direction):
    out = defaultdict(list)
    for e in edges:
        if direction in ("out", "both"):
            out[e[1]].append((e[3], e[0], "out"))
        if direction in ("in", "both") and (direction == "in" or e[1] != e[3]):
            out[e[3]].append((e[1], e[0], "in"))
    return out


def test_traversal_from_many_roots(spark, monkeypatch):
    """More roots than one bitmap has, hubs in parts, and roots that the type filter would not let in."""
    monkeypatch.setattr(G, "HUB", 20)
    kinds, edges, nodes, table = random_graph(spark, 1, 120, 170)
    roots = spark.createDataFrame([(f"n{k}",) for k in range(100)] + [("nobody",), ("n1",)], "root string")
    for depth, types, direction in ((4, None, "both"), (3, ["A", "B"], "both"), (2, ["A"], "out"), (1, None, "in")):
        steps, near, seen = walked(edges, direction), set(), set()
        ok = lambda x: types is None or kinds[x] in types
        for root in (f"n{k}" for k in range(100)):
            distance, queue = {root: 0}, deque([root])
            while queue:
                x = queue.popleft()
                if distance[x] < depth:
                    for y, e, _ in steps[x]:
                        if ok(y) or y == root:
                            seen.add((root, e))
                        if ok(y) and y not in distance:
                            distance[y] = distance[x] + 1
                            queue.append(y)
            near |= {(root, x, d) for x, d in distance.items()}
        reached, through = G.traverse(nodes, table, roots, depth, entity_types=types, direction=direction)
        assert {tuple(x) for x in reached.select("root", "id", "distance").collect()} == near
        assert {tuple(x) for x in through.select("root", "edge_id").collect()} == seen


def test_paths_from_both_ends(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB", 20)
    kinds, edges, nodes, table = random_graph(spark, 2, 90, 120)
    rank = {e[0]: k for k, e in enumerate(sorted(edges, key=lambda e: (e[6] is None, [-ord(c) for c in e[6] or ""], e[0])))}
    r = random.Random(3)
    asked = sorted({(f"n{r.randrange(90)}", f"n{r.randrange(90)}") for _ in range(150)})
    for depth, types, direction in ((4, None, "both"), (3, ["A", "B"], "out"), (4, ["B", "C"], "in")):
        steps, want = walked(edges, direction), {}
        for source, target in asked:
            best = {source: ()}
            level = {source: ()}
            for _ in range(depth):
                new = {}
                for x, path in level.items():
                    for y, e, way in steps[x]:
                        if (types is None or kinds[y] in types) and y not in best:
                            step = (*path, (rank[e], x, y, way, e))
                            if y not in new or [s[0] for s in step] < [s[0] for s in new[y]]:
                                new[y] = step
                best |= new
                level = new
            path = best.get(target)
            want[source, target] = None if path is None else [s[1:] for s in path]
        rows = G.find_path(nodes, table, spark.createDataFrame(asked, "source string, target string"), depth, entity_types=types, direction=direction).collect()
        got = defaultdict(list)
        for x in sorted(rows, key=lambda x: (x.source, x.target, x.hop or 0)):
            got[x.source, x.target] += [] if x.hop is None else [(x.from_id, x.to_id, x.way, x.edge_id)]
        depths = {(x.source, x.target): x.depth for x in rows}
        assert depths == {k: None if p is None else len(p) for k, p in want.items()}
        assert {k: p for k, p in got.items() if p} == {k: p for k, p in want.items() if p}


def test_search_by_parts(spark):
    r = random.Random(5)
    names = ["".join(r.choice("ab \u00c9") for _ in range(r.randint(1, 9))).strip() or "a" for _ in range(150)]
    nodes = spark.createDataFrame([(f"n{k:03}", "A", x, f"alias {x[::-1]}" if k % 3 else None) for k, x in enumerate(names)], "id string, entity_type string, canonical_name string, aliases string")
    nodes = nodes.withColumns({c: F.lit(None).cast("string") for c in ("identifiers", "ticker", "tickers")})
    asked = sorted({"".join(r.choice("abA \u00e9") for _ in range(r.randint(1, 5))).strip() for _ in range(400)} | {"", "alias", "zz", "  "})
    want = {}
    for q in {q.strip(" ") for q in asked} - {""}:
        scored = []
        for k, x in enumerate(names):
            text = " ".join((x, f"alias {x[::-1]}" if k % 3 else "", "", "", "")).lower()
            low = q.lower()
            score = 100 if x.lower() == low else 80 if x.lower().startswith(low) else 50 if low in text else 0
            if score:
                scored.append((-score, x.encode(), f"n{k:03}"))
        want |= {(q, rank + 1): (s[2], -s[0]) for rank, s in enumerate(sorted(scored)[:20])}
    index = G.search_index(nodes)
    found = G.search_entities(nodes, spark.createDataFrame([(q,) for q in asked], "query string"), index=index)
    assert {(x.query, x["rank"]): (x.id, x.score) for x in found.collect()} == want


def test_careers_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 7)
    r = random.Random(6)
    edges = [(f"e{k:04}", r.choice(["hot", "hot", "p1", "p2"]), "WORKED_AT", f"o{r.randrange(4)}" if k % 50 > 20 else "o0", f"20{r.randint(10, 20)}-01-01", None, None) for k in range(400)]
    nodes = spark.createDataFrame([(p, "PERSON") for p in ("hot", "p1", "p2")], "id string, entity_type string")
    want = set()
    for p in ("hot", "p1", "p2"):
        own = sorted((e for e in edges if e[1] == p), key=lambda e: (e[4], e[0]))
        for o in {e[3] for e in own}:
            last = max(k for k, e in enumerate(own) if e[3] == o)
            before = next((own[k][0] for k in range(last, -1, -1) if own[k][3] != o), None)
            after = next((own[k][0] for k in range(last, len(own)) if own[k][3] != o), None)
            want.add((p, o, own[last][0], sum(e[3] == o for e in own), before, after))
    assert {tuple(x) for x in G.career_transitions(nodes, spark.createDataFrame(edges, EDGE)).collect()} == want


def test_late_visits_land_in_order(spark, tmp_path):
    r = random.Random(7)
    visits = [(u, 60 * k, f"p{r.randrange(3)}") for u in range(3) for k in range(60)]
    late = sorted(visits, key=lambda v: v[1] + r.randint(0, 1500))  # by up to 25 minutes
    df = spark.createDataFrame([(k // 45, u, at, p) for k, (u, at, p) in enumerate(late)], "part int, user_id long, s long, place string").withColumn("at", F.timestamp_seconds("s"))
    folder = str(tmp_path / "in")
    for k in range(4):
        df.filter(F.col("part") == k).select("user_id", "at", "place").coalesce(1).write.mode("append").parquet(folder)
        stream = streams.stream_trail(spark.readStream.schema("user_id long, at timestamp, place string").parquet(folder), "30 minutes")
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    out = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out/batch=*").groupBy("user_id").agg(F.max_by("trail", "batch").alias("trail"))
    assert {x.user_id: x.trail for x in out.collect()} == {x.user_id: x.trail for x in G.traversal_trail(df.select("user_id", "at", "place")).collect()}

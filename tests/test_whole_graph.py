"""Traversal and paths on the whole graph of the smallest tables, against plain breadth-first code."""

from collections import defaultdict

from attestry.queries import QUERIES
from attestry.sources import binding as B

FOLDER = "/root/testdata/sf0.001"


def test_whole_graph(spark):
    nodes = {r.id for r in B.bind(spark, FOLDER, B.NODES).collect()}
    edges = [(r.id, r.subject_entity_id, r.object_entity_id, r.observed_at) for r in B.bind(spark, FOLDER, B.EDGES).collect()]
    edges.sort(key=lambda e: e[0])
    edges.sort(key=lambda e: e[3] or "", reverse=True)  # newest first, none last, then id
    near = defaultdict(list)
    for rank, (name, a, b, _) in enumerate(edges):
        near[a].append((rank, b, name))
        near[b].append((rank, a, name))
    reached, seen, best = set(), defaultdict(set), {}
    for root in (n for n in nodes if n.startswith("N")):
        at, paths = {root: 0}, {root: []}
        for step in range(1, 5):
            new = {}
            for x in [x for x, d in at.items() if d == step - 1]:
                for rank, y, name in near[x]:
                    if step <= 2:
                        seen[root].add(name)
                    if y in nodes and y not in at and (y not in new or paths[x] + [rank] < new[y]):
                        new[y] = paths[x] + [rank]
            at |= dict.fromkeys(new, step)
            paths |= new
        reached |= {(root, x, d) for x, d in at.items()}
        best[root] = {x: [edges[k][0] for k in p] for x, p in paths.items()}
    got = {tuple(r) for r in QUERIES["traverse"](spark, FOLDER).select("root", "id", "distance").collect()}
    assert got == reached and any(x.startswith("C") for _, x, _ in got)
    assert {r.root: r.n for r in QUERIES["traverse_edges_whole"](spark, FOLDER).collect()} == {k: len(v) for k, v in seen.items()}
    hops = defaultdict(list)
    for r in QUERIES["find_path_whole"](spark, FOLDER).orderBy("source", "target", "hop").collect():
        hops[r.source, r.target].append(r.edge_id)
    assert len(hops) == 100 and all(v == best[s].get(t, [None]) for (s, t), v in hops.items())

"""Questions to the graph: nodes (id, entity_type, canonical_name ...), edges (id, subject_entity_id, predicate,
object_entity_id, valid_from, valid_to, observed_at, source_document_id ...), events and participants.

Searches go one frontier at a time, for many roots at once. A traversal keeps for each node a bitmap of the roots that
have reached it, so that a node is expanded once per round for 64 roots; a path search goes from both ends and meets in
the middle. A hub's edges are dealt in parts, so that they do not stand in one task. Edges are staged once, each with
what a search needs of it, and types are asked of the nodes that are reached, not of all edges' ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import edge_in_date_range, edge_start, parse_participants
from ..functions.vocabulary import CAREER_PREDICATES
from ..sources.staging import BROADCAST_ROWS, dealt, in_order, n_parts, part_of, small, stage, stage_parts

#: A node with more edges than this is a hub; its edges are dealt in parts of about so many.
HUB = 50_000
#: Letters of a search index's longest parts, and rows of a block of numbers.
GRAM, BLOCK = 3, 200_000
#: Bounds of the questions.
MOST_DEPTH, MOST_RESULTS, TRAIL = 4, 50, 12
#: Roots in a bitmap.
ROOTS = 64


def merge_graphs(graphs: list[DataFrame], key: str = "id") -> DataFrame:
    """One section of several graphs; of equal ids the last graph's record stays."""
    each = [g.withColumn("_graph", F.lit(k)) for k, g in enumerate(graphs)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    columns = [c for c in rows.columns if c != "_graph"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_graph").alias("r")).select("r.*")


def filtered_edges(edges: DataFrame, predicates: list[str] | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """An empty list filters nothing."""
    rows = edges.filter(F.col("predicate").isin(*predicates)) if predicates else edges
    return rows.filter(edge_in_date_range(F.col("valid_from"), F.col("valid_to"), F.col("observed_at"), date_from, date_to))


def oriented(edges: DataFrame, direction: str = "both", *more: str) -> DataFrame:
    """(src, dst, way, edge_id, more columns): each edge as it is walked. A self-loop is walked once, outwards."""
    out = edges.select(F.col("subject_entity_id").alias("src"), F.col("object_entity_id").alias("dst"), F.lit("out").alias("way"), F.col("id").alias("edge_id"), *more)
    back = edges.select(F.col("object_entity_id").alias("src"), F.col("subject_entity_id").alias("dst"), F.lit("in").alias("way"), F.col("id").alias("edge_id"), *more)
    return out if direction == "out" else back if direction == "in" else out.unionByName(back.filter("src != dst"))


def depth_of(depth: int) -> int:
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be between 1 and {MOST_DEPTH}")
    return depth


def _typed(nodes: DataFrame, entity_types: list[str] | None) -> DataFrame:
    return (nodes.filter(F.col("entity_type").isin(*entity_types)) if entity_types else nodes).select(F.col("id").alias("dst"))


def hubs_of(steps: DataFrame) -> DataFrame:
    """(src, parts) of the sources with very many rows; fewer than rows / HUB, so they are broadcast."""
    return small(steps.groupBy("src").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).filter("parts > 1"), "hubs")


def in_parts(steps: DataFrame, hubs: DataFrame) -> DataFrame:
    """Steps (src, dst ...) with the part of their source."""
    return steps.join(hubs, "src", "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def to_parts(frontier: DataFrame, hubs: DataFrame) -> DataFrame:
    """Frontier rows (src ...), those at a hub once for each of its parts."""
    asked = frontier.join(hubs, "src", "left")
    return asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def traverse(
    nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 1, predicates: list[str] | None = None, entity_types: list[str] | None = None, direction: str = "both",
    date_from: str | None = None, date_to: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(root, id, distance) and (root, edge_id) for each root (a row with column root) that is a node.

    Nodes up to depth steps away; edges seen from a node nearer than depth whose other end passes the type filter.
    The root itself needs no matching type.
    """
    depth_of(depth)
    start = roots.select("root").distinct().join(nodes.select(F.col("id").alias("root")), "root", "left_semi")
    start = in_order(start, ["root"], "roots", "n").select("root", F.expr(f"n div {ROOTS}").alias("block"), F.expr(f"cast(n % {ROOTS} as int)").alias("bit"))
    start = stage(start.withColumn("mask", F.expr("shiftleft(1L, bit)")), "roots")
    plain = oriented(filtered_edges(edges, predicates, date_from, date_to), direction).select("src", "dst", "edge_id")
    if depth == 1:  # only edges at the roots count
        plain = plain.join(small(start.select(F.col("root").alias("src")), "root-ids"), "src", "left_semi")
        pairs = stage(plain.select("src", "dst"), "pairs")
    else:
        ends = stage(filtered_edges(edges, predicates, date_from, date_to).select(F.lit("").alias("id"), "subject_entity_id", "object_entity_id"), "pairs")
        pairs = oriented(ends, direction).select("src", "dst")
    hubs, n, typed = hubs_of(pairs), n_parts(pairs), _typed(nodes, entity_types)
    rounds = [stage(start.select("block", F.col("root").alias("id"), "mask"), "reached")]
    for _ in range(depth):
        frontier = rounds[-1].select("block", F.col("id").alias("src"), "mask")

        def stepped(k: int, n: int) -> DataFrame:
            """What part k of the frontier reaches."""
            steps = to_parts(part_of(frontier, "src", k, n), hubs).join(in_parts(part_of(pairs, "src", k, n), hubs), ["src", "part"])
            return steps.groupBy("block", "dst").agg(F.bit_or("mask").alias("mask"))

        few = frontier.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        if few:
            frontier = F.broadcast(frontier)
        near = stage_parts(stepped, 1 if few else n, "near").join(typed, "dst", "left_semi").groupBy("block", F.col("dst").alias("id")).agg(F.bit_or("mask").alias("mask"))
        had = masks_of(rounds).withColumnRenamed("mask", "had")
        new = near.join(had, ["block", "id"], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))))
        rounds.append(stage(new.filter("mask != 0").select("block", "id", "mask"), "reached"))
    inner = stage(masks_of(rounds[:-1]).withColumnRenamed("id", "src"), "inner")
    walk = plain.join(typed, "dst", "left_semi")
    seen = to_parts(inner, hubs).join(in_parts(walk, hubs), ["src", "part"]).select("block", "edge_id", "mask")
    if entity_types:  # an edge back to the root counts although the root may not match the type filter
        back = plain.join(small(start.select("block", F.col("root").alias("dst"), F.col("mask").alias("own")), "back"), "dst")
        home = back.join(inner, ["block", "src"]).filter(F.col("mask").bitwiseAND(F.col("own")) != 0).select("block", "edge_id", F.col("own").alias("mask"))
        seen = seen.unionByName(home)
    reached = reduce(DataFrame.unionByName, [r.withColumn("distance", F.lit(k)) for k, r in enumerate(rounds)])
    return rooted(reached, start).select("root", "id", "distance"), rooted(seen.groupBy("block", "edge_id").agg(F.bit_or("mask").alias("mask")), start).select("root", "edge_id")


def masks_of(rounds: list[DataFrame]) -> DataFrame:
    """(block, id, mask) over all rounds."""
    return reduce(DataFrame.unionByName, rounds).groupBy("block", "id").agg(F.bit_or("mask").alias("mask"))


def rooted(rows: DataFrame, start: DataFrame) -> DataFrame:
    """Rows (block, mask ...) once for each root in their mask."""
    each = rows.withColumn("bit", F.explode(F.expr(f"filter(sequence(0, {ROOTS - 1}), b -> (shiftrightunsigned(mask, b) & 1) = 1)"))).drop("mask")
    names = small(start.select("block", "bit", "root"), "root-names")
    return each.join(names, ["block", "bit"])


def neighbors(nodes: DataFrame, edges: DataFrame, roots: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    return traverse(nodes, edges, roots, 1, **options)


def edge_ranks(edges: DataFrame) -> DataFrame:
    """(edge_id, rank): newest observation first, then id. They hold for all searches of a graph, so compute them once."""
    return in_order(edges.select(F.col("id").alias("edge_id"), "observed_at"), [F.desc_nulls_last("observed_at"), "edge_id"], "ranks", "rank").select("edge_id", "rank")


def find_path(
    nodes: DataFrame, edges: DataFrame, pairs: DataFrame, depth: int = MOST_DEPTH, predicates: list[str] | None = None, entity_types: list[str] | None = None, direction: str = "both",
    date_from: str | None = None, date_to: str | None = None, ranks: DataFrame | None = None,
) -> DataFrame:
    """(source, target, depth, hop, from_id, to_id, way, edge_id): the hops of a shortest path per pair, or one row without a hop.

    Of equally short paths the one first in breadth-first order over edges by rank: the least array of ranks. depth is
    null where there is no path, 0 where both ends are one. ranks: edge_ranks of the graph, if they are at hand; else an
    edge's rank is that of its observation, then its id, which needs no order of all edges.

    The search goes two steps at most from each end, once per end whatever its number of pairs, and only for pairs
    without a shorter path. What is kept of a node is the least steps by which an end reaches it; a path's least steps
    are those of its halves. The second step is free on one side only, where fewer nodes are known; on the other it goes
    to nodes that are known from across.
    """
    depth_of(depth)
    kept = filtered_edges(edges, predicates, date_from, date_to)
    if ranks is None:
        days = small(in_order(edges.select("observed_at").distinct(), [F.desc_nulls_last("observed_at")], "days", "rank").select(F.col("observed_at").alias("_day"), "rank"), "days")
        kept = kept.join(days, F.col("observed_at").eqNullSafe(F.col("_day")))
    else:
        kept = kept.join(ranks.withColumnRenamed("edge_id", "id"), "id")
    lean = stage(kept.filter("subject_entity_id != object_entity_id").select("id", "subject_entity_id", "object_entity_id", "rank"), "lean")
    walk = oriented(lean, direction, "rank")
    step = F.struct("rank", "edge_id", "way", F.col("src").alias("from_id"), F.col("dst").alias("to_id"))
    typed = _typed(nodes, entity_types).withColumnRenamed("dst", "node")
    asked = stage(pairs.select("source", "target").distinct(), "pairs")
    left, found = asked.filter("source != target"), []

    def near(end: str, left: DataFrame, ahead: bool) -> DataFrame:
        """(end, node, ranks) one step from the ends of the pairs that are left, where both are of the types that count."""
        at, to = ("src", "dst") if ahead else ("dst", "src")
        ends = left.select(F.col(end).alias("node")).distinct()
        ends = small((ends if ahead else ends.join(typed, "node", "left_semi")).withColumnRenamed("node", at), "ends")
        steps = walk.join(ends, at).groupBy(F.col(at).alias(end), F.col(to).alias("node")).agg(F.min(F.array(step)).alias("ranks"))
        return stage(steps.join(typed, "node", "left_semi"), "near")

    def far(end: str, left: DataFrame, first: DataFrame, ahead: bool, across: DataFrame | None) -> DataFrame:
        """(end, node, ranks) two steps away, at nodes of across where it is given: the least steps, in the order of the path."""
        at, to = ("src", "dst") if ahead else ("dst", "src")
        open_ends = stage(first.join(small(left.select(end).distinct(), "ends"), end, "left_semi"), "open")
        steps = walk.join(small(open_ends.select(F.col("node").alias(at)).distinct(), "open-nodes"), at, "left_semi")
        if across is not None:
            steps = steps.join(small(across.select(F.col("node").alias(to)).distinct(), "across"), to, "left_semi")
        steps = stage(steps.select(F.col(at).alias("src"), F.col(to).alias("dst"), F.struct("rank", "edge_id", "way", F.col("src").alias("from_id"), F.col("dst").alias("to_id")).alias("step")), "steps")
        hubs, n = hubs_of(steps), n_parts(steps)
        ranks = F.concat("ranks", F.array("step")) if ahead else F.concat(F.array("step"), "ranks")

        def met(k: int, n: int) -> DataFrame:
            """What is reached at part k of the nodes."""
            both = to_parts(open_ends.withColumnRenamed("node", "src"), hubs).join(in_parts(part_of(steps, "dst", k, n), hubs), ["src", "part"]).filter(F.col("dst") != F.col(end))
            return both.groupBy(end, F.col("dst").alias("node")).agg(F.min(ranks).alias("ranks"))

        two = stage_parts(met, n, "far")
        return two.join(typed, "node", "left_semi") if ahead else two

    def settle(left: DataFrame, ahead: DataFrame, behind: DataFrame | None) -> DataFrame:
        """Pairs whose halves meet leave with their path; the others are left."""
        if behind is None:
            met = left.join(ahead.withColumnRenamed("node", "target"), ["source", "target"]).select("source", "target", "ranks")
        else:
            halves = left.join(behind.withColumnRenamed("ranks", "rest"), "target").join(ahead, ["source", "node"])
            met = halves.groupBy("source", "target").agg(F.min(F.concat("ranks", "rest")).alias("ranks"))
        met = small(met, "met")
        found.append(met)
        return stage(left.join(met.select("source", "target"), ["source", "target"], "left_anti"), "left")

    def rows_of(first: DataFrame, end: str) -> int:
        return first.join(left.select(end).distinct(), end, "left_semi").count()

    ahead = near("source", left, True)
    left = settle(left, ahead, None)
    if depth > 1:
        behind = near("target", left, False)
        left = settle(left, ahead, behind)
    if depth > 2:
        left = settle(left, far("source", left, ahead, True, behind), behind)
    if depth > 3 and not left.isEmpty():
        if rows_of(ahead, "source") <= rows_of(behind, "target"):
            ahead = far("source", left, ahead, True, None)
            behind = far("target", left, behind, False, ahead)
        else:
            behind = far("target", left, behind, False, None)
            ahead = far("source", left, ahead, True, behind)
        left = settle(left, ahead, behind)
    paths = reduce(DataFrame.unionByName, found).select("source", "target", F.size("ranks").alias("depth"), F.col("ranks").alias("hops"))
    same = asked.filter("source = target").select("source", "target", F.lit(0).alias("depth"), F.array().cast(paths.schema["hops"].dataType).alias("hops"))
    out = asked.join(paths.unionByName(same), ["source", "target"], "left").select("source", "target", "depth", F.posexplode_outer("hops").alias("hop", "h"))
    return out.select("source", "target", "depth", "hop", "h.from_id", "h.to_id", "h.way", "h.edge_id")


def timeline(edges: DataFrame, events: DataFrame, participants: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """(entity_id, kind, date, record_id) of every entity: its events and edges. ranked_timeline gives their order."""
    dated = events.select(F.col("id").alias("event_id"), F.col("event_date").alias("date"))
    if date_from:
        dated = dated.filter(F.col("date") >= date_from)
    if date_to:
        dated = dated.filter(F.col("date") <= date_to)
    own = participants.select("event_id", "entity_id").distinct().join(dated, "event_id").select("entity_id", F.lit("EVENT").alias("kind"), "date", F.col("event_id").alias("record_id"))
    near = edges.filter(edge_in_date_range(F.col("valid_from"), F.col("valid_to"), F.col("observed_at"), date_from, date_to))
    ends, start = F.array_distinct(F.array("subject_entity_id", "object_entity_id")), edge_start(F.col("valid_from"), F.col("observed_at"))
    return own.unionByName(near.select(F.explode(ends).alias("entity_id"), F.lit("RELATIONSHIP").alias("kind"), start.alias("date"), F.col("id").alias("record_id")))


def ranked_timeline(entries: DataFrame) -> DataFrame:
    """Timeline entries with their rank from 1 within the entity: newest first, a day's events before its edges, then by id.

    Entities are ranked whole, part by part. One with very many entries (over BLOCK) is not ranked in one task: all
    entries of such entities are numbered in one sort, dealt by range.
    """
    newest = F.desc(F.coalesce("date", F.lit("")))
    order = [newest, "kind", "record_id"]
    parts, out = dealt(entries, "entity_id", n_parts(entries), "entries"), []
    while parts:
        rows = parts.pop()
        many = small(rows.groupBy("entity_id").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("entity_id"), "many")
        light = rows.join(many, "entity_id", "left_anti").withColumn("rank", F.row_number().over(W.partitionBy("entity_id").orderBy(*order)).cast("long"))
        if not many.isEmpty():
            heavy = in_order(rows.join(many, "entity_id", "left_semi"), ["entity_id", *order], "timeline", "n")
            first = small(heavy.groupBy("entity_id").agg(F.min("n").alias("_first")), "firsts")
            light = light.unionByName(heavy.join(first, "entity_id").withColumn("rank", F.col("n") - F.col("_first") + 1).drop("n", "_first"))
        out.append(stage(light, "ranked"))
    return reduce(DataFrame.unionByName, out)


def career_transitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(person_id, organization_id, edge_id, n_assertions, previous_edge_id, next_edge_id) for every person and organization.

    A career is ordered by date and edge id; around the last edge at an organization, the nearest edges elsewhere.

    All careers are numbered in one order, dealt by range. Where a stay at an organization began is a running maximum,
    taken block by block of numbers with what came before as a carry; neighbours are found by their number. So a person
    with very many edges is no more work for one task than many persons.
    """
    people = nodes.filter("entity_type = 'PERSON'").select(F.col("id").alias("person_id"))
    career = edges.filter(F.col("predicate").isin(*CAREER_PREDICATES)).select(F.col("subject_entity_id").alias("person_id"), F.col("object_entity_id").alias("organization_id"), F.col("id").alias("edge_id"), F.coalesce("valid_from", "observed_at", F.lit("")).alias("at"))
    rows = in_order(career.join(people, "person_id", "left_semi"), ["person_id", "at", "edge_id"], "careers", "n").select("n", "person_id", "organization_id", "edge_id")
    rows = stage(rows, "careers")
    last = stage(rows.groupBy("person_id", "organization_id").agg(F.max_by(F.struct("n", "edge_id"), "n").alias("r"), F.count("*").alias("n_assertions")).select("person_id", "organization_id", "n_assertions", "r.*"), "last")
    before = rows.select((F.col("n") + 1).alias("n"), F.col("person_id").alias("_p"), F.col("organization_id").alias("_o"))
    moved = ~(F.col("_p").eqNullSafe(F.col("person_id")) & F.col("_o").eqNullSafe(F.col("organization_id")))
    began = rows.join(before, "n", "left").select("n", F.expr(f"n div {BLOCK}").alias("block"), F.when(moved, F.col("n")).alias("start"))
    began = stage(began, "stays")
    carry = began.groupBy("block").agg(F.max("start").alias("most"))  # one row for each block
    carry = small(carry.select("block", F.max("most").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carry")), "carries")
    so_far = F.max("start").over(W.partitionBy("block").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    starts = began.withColumn("start", so_far).join(carry, "block").select("n", F.coalesce("start", "carry").alias("start"))
    edge_at = lambda n, name: rows.select((F.col("n") + n).alias(f"_{name}"), "person_id", F.col("edge_id").alias(name))
    found = last.join(starts, "n").withColumns({"_previous_edge_id": F.col("start"), "_next_edge_id": F.col("n")})
    found = found.join(edge_at(1, "previous_edge_id"), ["_previous_edge_id", "person_id"], "left").join(edge_at(-1, "next_edge_id"), ["_next_edge_id", "person_id"], "left")
    return found.select("person_id", "organization_id", "edge_id", "n_assertions", "previous_edge_id", "next_edge_id")


def haystack(nodes: DataFrame) -> DataFrame:
    """Nodes with the text that a search looks into: name, aliases, identifiers, ticker, tickers."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("canonical_name", "aliases", "identifiers", "ticker", "tickers")]
    return nodes.select("id", "canonical_name", F.lower("canonical_name").alias("_name"), F.lower(F.concat_ws(" ", *parts)).alias("_text"))


def parts_of(c: Column, n: int) -> Column:
    """The distinct parts of n letters of a text."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def search_index(nodes: DataFrame) -> DataFrame:
    """(part, id): all parts of one to three letters of what a search looks into. Holds for all searches of a graph, so compute it once."""
    texts = haystack(nodes)
    return texts.select("id", F.explode(F.flatten(F.array(*[parts_of(F.col("_text"), n) for n in range(1, GRAM + 1)]))).alias("part"))


def search_entities(nodes: DataFrame, queries: DataFrame, limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """(query, rank, id, score) per query of a stated set: equal names 100, prefixes 80, parts 50; then by name.

    A query looks only at nodes that have its rarest part of three letters (a shorter one at those that have it), and
    then at their text. Each task keeps a query's best rows before they meet those of others. Blank queries find
    nothing. index: search_index of the graph, if it is at hand.
    """
    keep = max(1, min(limit, MOST_RESULTS))
    asked = stage(queries.select(F.trim("query").alias("query")).filter("query != ''").distinct().withColumn("_q", F.lower("query")), "queries")
    own = F.when(F.length("_q") < GRAM, F.array("_q")).otherwise(parts_of(F.col("_q"), GRAM))
    each = stage(asked.select("query", "_q", F.explode(own).alias("part")), "query-parts")
    wanted = small(each.select("part").distinct(), "wanted")
    postings = stage((search_index(nodes) if index is None else index).join(wanted, "part", "left_semi"), "postings")
    sizes = each.join(small(postings.groupBy("part").agg(F.count("*").alias("n")), "sizes"), "part", "left")
    rarest = sizes.groupBy("query", "_q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("part"))).alias("r")).filter("r.n > 0").select("query", "_q", F.col("r.part").alias("part"))
    near = postings.join(small(rarest, "rarest"), "part").select("id", "query", "_q")
    score = F.when(F.col("_name") == F.col("_q"), 100).when(F.startswith("_name", "_q"), 80).when(F.contains("_text", "_q"), 50)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "canonical_name", "id"))
    found = near.join(haystack(nodes), "id").filter(F.contains("_text", "_q")).withColumn("score", score)
    return found.withColumn("rank", rank).filter(F.col("rank") <= keep).select("query", "rank", "id", "score")


def traversal_trail(visits: DataFrame, keep: int = TRAIL) -> DataFrame:
    """(user_id, trail) of visits (user_id, at, place): repeats in a row once, the last few."""
    order = W.partitionBy("user_id").orderBy("at")
    moves = visits.withColumn("_last", F.lag("place").over(order)).filter(~F.col("place").eqNullSafe(F.col("_last")))
    recent = moves.withColumn("_n", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("at")))).filter(F.col("_n") <= keep)
    return recent.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "place"))), lambda x: x["place"]).alias("trail"))


def counts_of(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("statistic"), "value", "n")


def snapshot_stats(nodes: DataFrame, edges: DataFrame, events: DataFrame, facts: DataFrame, rejected: DataFrame, forms: DataFrame) -> DataFrame:
    """(statistic, value, n): totals, counts by kind, and how much came from deterministic extraction.

    Each table is read once, for its counts by kind; all statistics are sums of these few rows.
    """
    kind = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    model = F.coalesce(F.col("extraction_method") == "LLM_STRUCTURED", F.lit(False))
    read = [("entities", nodes, "entity_type", F.lit(False)), ("relationships", edges, "predicate", model), ("events", events, "event_type", F.lit(False)), ("facts", facts, None, F.lit(False)), ("rejected", rejected, None, F.lit(False)), ("forms", forms, "document_type", F.lit(False))]
    counted = reduce(DataFrame.unionByName, [df.groupBy(kind(c).alias("value"), m.alias("model")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "value", "model", "n") for name, df, c, m in read])
    counted = stage(counted, "counts")
    of = lambda *names: F.col("table").isin(*names)
    groups = {"people": ["PERSON"], "organizations": ["ORGANIZATION", "COMPANY"], "funds": ["FUND"], "securities": ["SECURITY"]}
    totals = {name: of(name) for name, *_ in read[:-1]} | {
        "llm": of("relationships") & F.col("model"), "deterministic": of("relationships", "events", "facts") & ~F.col("model"),
        **{name: of("entities") & F.col("value").isin(*kinds) for name, kinds in groups.items()}}
    sums = counted.agg(*[F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).alias(name) for name, which in totals.items()])
    names = {"entities": "entity_type", "relationships": "predicate", "events": "event_type", "forms": "form"}
    statistic = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("table")]
    by_kind = counted.filter(of(*names)).groupBy(statistic.alias("statistic"), "value").agg(F.sum("n").alias("n"))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(name).alias("statistic"), F.lit("").alias("value"), F.col(name).alias("n")) for name in totals]))).unionByName(by_kind)


def exclude_fixtures(sources: DataFrame, entities: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without sources of provider TEST_FIXTURE, records of these, and entities marked "fixture":true anywhere in their attributes."""
    real = sources.filter("provider != 'TEST_FIXTURE'")
    marked = F.to_json("attributes") if dict(entities.dtypes)["attributes"].startswith("map") else F.col("attributes")
    kept = entities.filter(~F.coalesce(marked.ilike('%"fixture":true%'), F.lit(False)))
    return real, kept, records.join(real.select(F.col("id").alias("source_document_id")), "source_document_id", "left_semi")


def close_over_nodes(nodes: DataFrame, edges: DataFrame, events: DataFrame, participants: DataFrame, claims: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """Edges with both ends among the nodes, events with all participants, claims and facts with their subject (or none, for claims)."""
    ids = nodes.select("id")
    whole = edges.join(ids.withColumnRenamed("id", "subject_entity_id"), "subject_entity_id", "left_semi").join(ids.withColumnRenamed("id", "object_entity_id"), "object_entity_id", "left_semi")
    stray = participants.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti").select(F.col("event_id").alias("id"))
    said = claims.join(ids.select(F.col("id").alias("_n")), F.col("subject_entity_id") == F.col("_n"), "left").filter("subject_entity_id is null or _n is not null").drop("_n")
    return {"edges": whole, "events": events.join(stray, "id", "left_anti"), "claims": said, "facts": facts.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")}


def packed(rows: DataFrame, key: str, value: Column, name: str, mark: str = "|") -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), mark).alias(name))


def pack_identity(entities: DataFrame, identifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with 'scheme:value|...' and 'alias|...' texts, sorted."""
    ids = packed(identifiers.select(F.col("entity_id").alias("id"), "scheme", "value"), "id", F.concat_ws(":", "scheme", "value"), "identifiers")
    names = packed(aliases.select(F.col("entity_id").alias("id"), "alias"), "id", F.col("alias"), "aliases")
    return entities.join(ids, "id", "left").join(names, "id", "left")


def participants_of(events: DataFrame) -> DataFrame:
    """(event_id, entity_id, role) of events with packed participants."""
    return events.select(F.col("id").alias("event_id"), F.explode(parse_participants(F.col("participants"))).alias("p")).select("event_id", "p.*")

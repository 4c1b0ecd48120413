"""The institutional graph as two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lupaspark.functions import columns as C
from lupaspark.session import checkpointed


def derive_edges(nodes: DataFrame, explicit: DataFrame) -> DataFrame:
    """(edge_id, type, from, to, note): edges that node attributes state, and the explicit list; each once, by a stable id.

    nodes(id, parent, head_of, appointed_by, confirmed_by, nominated_by).
    """
    def edge(kind: str, frm: str, to: str) -> Column:
        return F.when(F.col(frm).isNotNull() & F.col(to).isNotNull(), F.struct(F.lit(kind).alias("type"), F.col(frm).alias("from"), F.col(to).alias("to"), F.lit("").alias("note")))

    all_ = F.array_compact(F.array(edge("heads", "id", "head_of"), edge("appoints", "appointed_by", "id"), edge("confirms", "confirmed_by", "id"), edge("nominates", "nominated_by", "id"), edge("supervises", "parent", "id")))
    edges = nodes.select(F.explode(all_).alias("e")).select("e.*").unionByName(explicit.select("type", "from", "to", F.coalesce("note", F.lit("")).alias("note")))
    return edges.distinct().select(C.hash_id(F.col("type"), F.col("from"), F.col("to"), F.col("note")).alias("edge_id"), "type", "from", "to", "note")


def closure(nodes: DataFrame, max_depth: int = 8) -> DataFrame:
    """(node, ancestor, depth) up to max_depth; a walk that comes back to its node ends there. nodes(id, parent)."""
    step = nodes.select(F.col("id").alias("_id"), F.col("parent").alias("_up")).where("_up is not null")
    level = step.select(F.col("_id").alias("node"), F.col("_up").alias("ancestor"), F.lit(1).alias("depth"))
    out = level
    for d in range(2, max_depth + 1):  # a fixed number of joins: depth is a property of institutions, not of the data's size
        level = level.join(step, F.col("ancestor") == F.col("_id")).where(F.col("_up") != F.col("node")).select("node", F.col("_up").alias("ancestor"), F.lit(d).alias("depth"))
        out = out.union(level)
    return out.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, out, in): sorted distinct neighbours."""
    both = edges.select(F.col("from").alias("id"), F.col("to").alias("o"), F.lit(None).cast("string").alias("i")).union(edges.select("to", F.lit(None).cast("string"), "from"))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("o")).alias("out"), F.array_sort(F.collect_set("i")).alias("in"))


def pages_of_neighbours(edges: DataFrame, size: int = 1000) -> DataFrame:
    """(id, way, page, neighbours): sorted distinct neighbours, about `size` on a page; way is 'out' or 'in'. edges(from, to); edges with a null end count for nothing.

    A page is a hash of the neighbour among as many as the node's degree asks for, so that a hub is many rows, put together in many tasks; most nodes have page 0 alone.
    """
    both = edges.select(F.col("from").alias("id"), F.lit("out").alias("way"), F.col("to").alias("other")).unionByName(edges.select(F.col("to").alias("id"), F.lit("in").alias("way"), F.col("from").alias("other")))
    both = both.where("id is not null and other is not null").distinct()
    hubs = both.groupBy("id", "way").agg(F.count("*").alias("n")).where(F.col("n") > size).select("id", "way", F.ceil(F.col("n") / size).cast("int").alias("pages"))
    paged = both.join(hubs, ["id", "way"], "left").withColumn("page", F.when(F.col("pages").isNull(), 0).otherwise(F.pmod(F.xxhash64("other"), F.col("pages")).cast("int")))
    return paged.groupBy("id", "way", "page").agg(F.array_sort(F.collect_list("other")).alias("neighbours"))


def _doubled(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(id, up, steps, ring): pointers after as many doublings as reach every root, and how many those were.

    A pointer joins itself: after n rounds it has gone 2^n steps up, or stands at a root. Pointers that still move once 2^n is past the number of nodes are on a cycle or hang below one.
    Each round is a join on ids and is written, so that a lost executor costs a round's task.
    """
    now = nodes.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("ring").cast("long").alias("ring"), F.col("ring").cast("long").alias("up_ring"))
    known = nodes.select(F.col("id").alias("_p"), F.col("ring").cast("long").alias("_r"))
    # A parent that is no node ends the walk, as its own root.
    now = now.join(known, F.col("up") == F.col("_p"), "left").select("id", F.when(F.col("_p").isNotNull(), F.col("up")).alias("up"), F.when(F.col("_p").isNotNull(), F.col("steps")).otherwise(0).alias("steps"), F.greatest("ring", F.col("_r") + 1).alias("ring"))
    now, left, rounds = checkpointed(now), nodes.count(), 0
    while True:
        moving = now.where("up is not null").count()
        if moving == 0 or (1 << rounds) > left:
            return now, moving
        far = now.select(F.col("id").alias("_i"), F.col("up").alias("_u"), F.col("steps").alias("_s"), F.col("ring").alias("_r"))
        now = checkpointed(now.join(far, F.col("up") == F.col("_i"), "left").select("id", F.col("_u").alias("up"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), F.greatest("ring", F.col("_r") + F.col("steps")).alias("ring")))
        rounds += 1


def depths(nodes: DataFrame, top: int = 4) -> DataFrame:
    """N2, N4 to any depth: (id, depth, ring, cyclic): steps to the root; the ring, at least each ancestor's and one more for each step between, at most `top`; whether the walk up never ends.

    nodes(id, parent, ring), ids unique. The number of joins is the logarithm of the depth. Depth is null and the ring `top` where the walk never ends; a parent that is no node ends it; a null ring counts as 0.
    """
    out, _ = _doubled(nodes.select("id", "parent", F.coalesce("ring", F.lit(0)).alias("ring")))
    cyclic = F.col("up").isNotNull()
    return out.select("id", F.when(~cyclic, F.col("steps")).alias("depth"), F.when(cyclic, top).otherwise(F.least("ring", F.lit(top))).cast("int").alias("ring"), cyclic.alias("cyclic"))


def full_closure(nodes: DataFrame) -> DataFrame:
    """N2 to any depth: (node, ancestor, depth), each pair once at its least depth; on a cycle a node is not its own ancestor. nodes(id, parent).

    Doubling: pairs up to 2^n steps joined with themselves give those up to 2^(n+1), so that joins are few though chains are long. The result has a row for each pair, as closures do.
    """
    now = checkpointed(nodes.where("parent is not null").select(F.col("id").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")).distinct())
    size = now.count()
    while True:
        a, b = now.alias("a"), now.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth")).where("node <> ancestor")
        after = checkpointed(now.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        grown = after.count()
        if grown == size:
            return after.where("node <> ancestor")
        now, size = after, grown


def propagate_ring(nodes: DataFrame, passes: int = 4, top: int = 4) -> DataFrame:
    """A child's ring is at least its parent's plus one, at most `top`. nodes(id, parent, ring)."""
    out = nodes.select("id", "parent", "ring")
    for _ in range(passes):
        up = out.select(F.col("id").alias("_p"), F.col("ring").alias("_r"))
        out = out.join(up, F.col("parent") == F.col("_p"), "left").select("id", "parent", F.least(F.greatest("ring", F.coalesce(F.col("_r") + 1, F.col("ring"))), F.lit(top)).alias("ring"))
    return out


def inherit(posts: DataFrame, nodes: DataFrame, cols: list[str]) -> DataFrame:
    """Posts take the columns of the organ that they head."""
    return posts.drop(*cols).join(nodes.select(F.col("id").alias("head_of"), *cols), "head_of", "left")


def subgraph(edges: DataFrame, ids: DataFrame, types: list[str]) -> DataFrame:
    """Edges of the types whose both ends are among ids(id)."""
    return edges.where(F.col("type").isin(types)).join(ids.select(F.col("id").alias("from")), "from", "left_semi").join(ids.select(F.col("id").alias("to")), "to", "left_semi")


def relations(edges: DataFrame, node: str) -> DataFrame:
    """Edges of one node, either way."""
    return edges.where(F.col("from") == node).select("type", F.lit("out").alias("way"), F.col("to").alias("other")).union(edges.where(F.col("to") == node).select("type", F.lit("in"), F.col("from")))


def resolve_parent(units: DataFrame, orgs: DataFrame) -> DataFrame:
    """The parent organ of a unit, directly or through the unit above it. units(id, above), orgs(id)."""
    own = orgs.select(F.col("id").alias("_o"))
    via = units.select(F.col("id").alias("_v"), F.col("above").alias("_va"))
    direct = units.join(own, F.col("above") == F.col("_o"), "left").join(via, F.col("above") == F.col("_v"), "left")
    return direct.join(own.withColumnRenamed("_o", "_o2"), F.col("_va") == F.col("_o2"), "left").select("id", "above", F.coalesce("_o", "_o2").alias("parent"), F.when(F.col("_o").isNotNull(), "direct").when(F.col("_o2").isNotNull(), "through unit").alias("how"))


def assign_ring(nodes: DataFrame, nature: str, rules: dict[str, int], default: int = 3) -> DataFrame:
    """Ring by legal nature."""
    ring = F.lit(default)
    for pattern, r in reversed(list(rules.items())):
        ring = F.when(C.fold(F.col(nature)).rlike(pattern), r).otherwise(ring)
    return nodes.withColumn("ring", ring)


def vacancy(posts: DataFrame, occupants: DataFrame) -> DataFrame:
    """Seats, those filled (never above the seats) and vacant. posts(id, seats), occupants(post)."""
    n = occupants.groupBy(F.col("post").alias("id")).agg(F.count("*").alias("_n"))
    filled = F.least(F.coalesce("_n", F.lit(0)), F.col("seats"))
    return posts.join(n, "id", "left").select("id", "seats", filled.alias("filled"), (F.col("seats") - filled).alias("vacant"))


def composition(seats: DataFrame, occupants: DataFrame) -> DataFrame:
    """(body, post, holder, position): each seat's post with its present holder; who acts for another comes last. seats(body, post), occupants(post, name, acting)."""
    first = occupants.withColumn("_n", F.row_number().over(Window.partitionBy("post").orderBy("acting", "name"))).where("_n = 1").select("post", F.col("name").alias("holder"), "acting")
    return seats.join(first, "post", "left").withColumn("position", F.row_number().over(Window.partitionBy("body").orderBy(F.col("acting").asc_nulls_last(), "post"))).select("body", "post", "holder", "position")


def search(entities: DataFrame, text: str, kind: str | None = None, k: int = 20) -> DataFrame:
    """Entities whose folded names hold all of the text's words, shortest name first. entities(id, kind, name, aliases)."""
    target = C.fold(F.concat_ws(" ", "name", "aliases"))
    words = C.tokens(F.lit(text))
    rows = entities if kind is None else entities.where(F.col("kind") == kind)
    return rows.where(F.forall(words, lambda t: F.contains(target, t))).orderBy(F.length("name"), "id").limit(k)


def size_scale(df: DataFrame, col: str, part: str) -> DataFrame:
    """1 + 1.8 * sqrt(value / the largest of its group)."""
    top = F.max(F.col(col).cast("double")).over(Window.partitionBy(part))
    return df.withColumn("size", F.round(1 + 1.8 * F.sqrt(F.try_divide(F.col(col).cast("double"), top)), 4))

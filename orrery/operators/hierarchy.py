"""Parent-child links to full hierarchies.

Nodes whose hash falls in a fixed residue class are splitters, and so are roots. Every node walks up to its next
splitter (a bounded number of steps whatever the depth of the tree), the graph reduced to splitters is solved by pointer
doubling, and each node's answer is put together from its own walk and its splitter's. Walks that no longer end belong
to loops without a splitter; those, and the loops of the reduced graph, are solved by ``_solve_loops``.

Every step is an equi-join on a node id. Nothing is collected but counts, and no stage holds the rows of one root or one
parent in one task: a hot parent is only ever on the unique side of a join, where the optimizer may split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import cut, sort_join

SPLITTER_RATE = 4
#: Steps of a walk, and doublings of jumps, between two checkpoints.
STEPS, DOUBLINGS = 4, 2


def id_key(c: Column) -> Column:
    """The form in which ids written differently agree: letters in upper case, the number without leading zeros.

    Null, blank and placeholder texts, which hold no number, give null."""
    t = F.upper(F.trim(F.regexp_replace(c, r"[\s_\-]+", "")))
    key = F.regexp_replace(t, r"^([^\d]*)0+(?=\d)", "$1")
    return F.when(key.rlike(r"\d"), key)


def stated_links(df: DataFrame, node: str = "entity_id", child_of: str = "childof", parent_of: str = "parentof") -> DataFrame:
    """The distinct (child, parent) links that the rows of df state, between ids found as ``node`` of some row.

    ``child_of`` names one or more parents of the row's node, ``parent_of`` its children; ids are compared by id_key and
    come out as written in ``node``. Links to ids of no row, and null or placeholder cells, don't count."""
    one = F.col(node)
    # One node may be written in two ways; the smallest then stands for it.
    nodes = df.select(id_key(one).alias("key"), one.alias("node")).where("key is not null").groupBy("key").agg(F.min("node").alias("node"))

    def pieces(c: str) -> Column:
        return F.regexp_extract_all(F.col(c).cast("string"), F.lit(r"([A-Za-z]+[-_ ]?\d+|\d+)"))

    up = df.where(F.col(child_of).isNotNull()).select(id_key(one).alias("child"), F.explode(pieces(child_of)).alias("p")).select("child", id_key(F.col("p")).alias("parent"))
    down = df.where(F.col(parent_of).isNotNull()).select(id_key(one).alias("parent"), F.explode(pieces(parent_of)).alias("c")).select(id_key(F.col("c")).alias("child"), "parent")
    links = up.select("child", "parent").unionByName(down.select("child", "parent")).where("child is not null and parent is not null").distinct()
    c, p = nodes.select(F.col("key").alias("child"), F.col("node").alias("c")), nodes.select(F.col("key").alias("parent"), F.col("node").alias("p"))
    return sort_join(sort_join(links, c, "child"), p, "parent").select(F.col("c").alias("child"), F.col("p").alias("parent"))


def _is_splitter(c: Column) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(11)), F.lit(SPLITTER_RATE)) == 0


def _doubled(state: DataFrame, times: int = DOUBLINGS) -> DataFrame:
    """state(node, jump, low) with each jump twice as long, ``times`` times over, and low the smallest over the way gone."""
    for _ in range(times):
        other = state.select(F.col("node").alias("jump"), F.col("jump").alias("j2"), F.col("low").alias("l2"))
        state = sort_join(state, other, "jump").select("node", F.col("j2").alias("jump"), F.least("low", "l2").alias("low"))
    return state


def _solve_loops(ptr: DataFrame) -> DataFrame:
    """(node, loop) for ptr(node, next, low), in which every way ends in a loop: the smallest low on that loop.

    The images of longer and longer jumps shrink to the nodes on loops; then the smallest low is spread round them."""
    state, image = ptr.select("node", F.col("next").alias("jump"), "low"), -1
    while True:
        state = cut(_doubled(state))
        now = state.select("jump").distinct().count()
        if now == image:
            break
        image = now
    entry = state.select("node", "jump")
    on = cut(sort_join(ptr, entry.select(F.col("jump").alias("node")).distinct(), "node", "left_semi").select("node", F.col("next").alias("jump"), "low"))
    total = None
    while True:
        on = cut(_doubled(on))
        # The lows only fall; ids are texts, so that a sum of hashes tells whether any did.
        now = on.agg(F.sum(F.xxhash64("low").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    return sort_join(entry, on.select(F.col("node").alias("jump"), F.col("low").alias("loop")), "jump").select("node", "loop")


def _walk(state: DataFrame, step: DataFrame, with_paths: bool) -> DataFrame:
    """state(node, at, hops, low, seg, done) after one step up for each walk that isn't done, or its end at a splitter.

    Walks that are done look for a key that no node has, each its own, so that they stay spread over the partitions."""
    key = F.when(F.col("done"), F.concat(F.lit("\0"), "node")).otherwise(F.col("at"))
    met = sort_join(state.withColumn("key", key), step, "key", "left")
    ends = F.col("done") | F.col("stop")
    seg = F.when(ends, F.col("seg")).otherwise(F.concat("seg", F.array("at"))) if with_paths else F.col("seg")
    return met.select("node", F.when(ends, F.col("at")).otherwise(F.col("up")).alias("at"), F.when(ends, F.col("hops")).otherwise(F.col("hops") + 1).alias("hops"), F.when(ends, F.col("low")).otherwise(F.least("low", "at")).alias("low"), seg.alias("seg"), ends.alias("done"))


def resolve_hierarchy(links: DataFrame, child: str = "child", parent: str = "parent", with_paths: bool = True) -> DataFrame:
    """One row (node_id, root_id, depth[, parent_id, path]) for each node of the links.

    ``path`` runs from the root down to the node. A root is its own root with depth 0. A node on a loop, or below one,
    has the smallest id on the loop as root_id, depth -1 and a null path; a link to itself is a loop. Where a node has
    several parents, its tree is that of the smallest (``multiple_parents`` reports the others). Null ends are ignored;
    repeated links count once; no links give no rows; other columns of ``links`` are not looked at."""
    edges = links.select(F.col(child).alias("node"), F.col(parent).alias("parent")).where("node is not null and parent is not null")
    parents = edges.groupBy("node").agg(F.min("parent").alias("parent"))
    roots = edges.select(F.col("parent").alias("node")).distinct().join(parents.select("node"), "node", "left_anti").select("node", F.lit(None).cast("string").alias("parent"))
    ptr = cut(parents.select("node", F.col("parent").cast("string").alias("parent")).unionByName(roots).withColumn("stop", F.col("parent").isNull() | _is_splitter(F.col("node"))))

    # Walk every node up to its next splitter. seg holds the nodes gone through, itself first, without the splitter.
    step = ptr.select(F.col("node").alias("key"), F.col("parent").alias("up"), "stop")
    none = F.lit(None).cast("array<string>")
    walking = ptr.where("parent is not null").select("node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("hops"), F.col("node").alias("low"), (F.array("node") if with_paths else none).alias("seg"), F.lit(False).alias("done"))
    ended, left = walking.limit(0).drop("done"), -1
    while True:
        for _ in range(STEPS):
            walking = _walk(walking, step, with_paths)
        walking = cut(walking)
        ended = ended.unionByName(walking.where("done").drop("done"))
        walking = walking.where("not done")
        now = walking.count()
        if now == 0 or now == left:
            left = now
            break
        left = now
    ended = cut(ended)

    empty = ptr.limit(0).select("node", F.lit("").alias("loop"))
    stuck = empty
    if left:
        # Loops without any splitter, and what leads into them (splitters too, whose way up holds no other).
        stuck = cut(_solve_loops(sort_join(ptr, walking.select("node"), "node", "left_semi").select("node", F.col("parent").alias("next"), F.col("node").alias("low"))))

    # The reduced graph: splitters and roots only.
    jump = sort_join(ended, ptr.where("stop").select("node"), "node", "left_semi")
    tops = ptr.where("parent is null").select(F.col("node"), F.col("node").alias("root_id"), F.lit(0).cast("long").alias("depth"), (F.array("node") if with_paths else F.lit(None).cast("array<string>")).alias("path"))
    # seg of a way is kept from its lower end upwards and turned round when it is complete.
    live = cut(jump.select("node", F.col("at").alias("to"), "hops", "seg"))
    # Splitters above which there is only a loop without one count as solved, with a null depth.
    solved = tops.unionByName(sort_join(stuck, ptr.where("stop").select("node"), "node", "left_semi").select("node", F.col("loop").alias("root_id"), F.lit(None).cast("long").alias("depth"), none.alias("path")))
    while True:
        both = cut(sort_join(live, solved.select(F.col("node").alias("to"), "root_id", "depth", "path"), "to", "left"))
        n = both.agg(F.count("root_id").alias("new"), F.count("*").alias("all")).first()
        solved = solved.unionByName(both.where("root_id is not null").select("node", "root_id", (F.col("depth") + F.col("hops")).alias("depth"), (F.concat("path", F.reverse("seg")) if with_paths else F.col("path")).alias("path")))
        rest = both.where("root_id is null").select("node", "to", "hops", "seg") if n["all"] > n["new"] else None
        if rest is None or not n["new"]:
            break
        # Jumps double over what is still open; a jump to a solved node stays for the next round's join.
        other = rest.select(F.col("node").alias("to"), F.col("to").alias("t2"), F.col("hops").alias("h2"), F.col("seg").alias("s2"))
        live = sort_join(rest, other, "to", "left").select("node", F.coalesce("t2", "to").alias("to"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"), F.when(F.col("s2").isNotNull(), F.concat("seg", "s2")).otherwise(F.col("seg")).alias("seg"))

    loops = empty
    if rest is not None:
        # Ways between splitters that never reach a root.
        open_ = sort_join(jump, rest.select("node"), "node", "left_semi").select("node", F.col("at").alias("next"), "low")
        loops = _solve_loops(open_)

    inner = sort_join(ended, ptr.where("not stop").select("node"), "node", "left_semi")
    below = sort_join(inner, solved.select(F.col("node").alias("at"), "root_id", "depth", "path"), "at").select("node", "root_id", (F.col("depth") + F.col("hops")).alias("depth"), (F.concat("path", F.reverse("seg")) if with_paths else F.col("path")).alias("path"))
    looped = loops.unionByName(sort_join(inner, loops.select(F.col("node").alias("at"), "loop"), "at").select("node", "loop"))
    looped = looped.unionByName(sort_join(stuck, ptr.where("not stop").select("node"), "node", "left_semi"))
    out = solved.unionByName(below).unionByName(looped.select("node", F.col("loop").alias("root_id"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path")))
    out = out.withColumn("depth", F.coalesce("depth", F.lit(-1).cast("long")))
    if not with_paths:
        return out.select(F.col("node").alias("node_id"), "root_id", "depth")
    return sort_join(out, ptr.select("node", F.col("parent").alias("parent_id")), "node").select(F.col("node").alias("node_id"), "root_id", "depth", "parent_id", "path")


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for each node and each of its ancestors, from resolve_hierarchy's paths.

    One row a pair, so that a root with a third of all nodes below it stays spread over tasks. Nodes on loops have none."""
    return (
        resolved.where("path is not null")
        .select("node_id", F.size("path").alias("n"), F.posexplode("path").alias("i", "ancestor_id"))
        .where("ancestor_id <> node_id")
        .select("ancestor_id", "node_id", (F.col("n") - 1 - F.col("i")).cast("long").alias("distance"))
    )


def multiple_parents(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node_id, parent_id, followed) for each link of a node with several stated parents."""
    e = links.select(F.col(child).alias("node_id"), F.col(parent).alias("parent_id")).where("node_id is not null and parent_id is not null").distinct()
    many = e.groupBy("node_id").agg(F.count("*").alias("n"), F.min("parent_id").alias("least")).where("n > 1")
    return sort_join(e, many, "node_id").select("node_id", "parent_id", (F.col("parent_id") == F.col("least")).alias("followed"))

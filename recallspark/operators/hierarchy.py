"""Parent-child rows to full hierarchies by Euler tours and parallel list ranking.

Each tree edge becomes two arcs, one down into the node and one up out of it. The arcs of a tree, ordered by its Euler
tour, are a linked list: after going down into v comes its first child, else the way up; after going up out of v comes
its next sibling, else the way up out of its parent. Pointer jumping ranks all lists at once in log2(longest list)
rounds, each one equi-join on arc ids with no hot key, as every arc has one successor. The signed sum of the arcs still to
come gives depth, the ranks give entry and exit. Arcs that never reach an end belong to components with a cycle: a node
all of whose children are peeled off never becomes free there. The jumping finds them without one round per leaf layer,
which chains hundreds deep would need: as soon as a round ends no further arc, all that are left are cyclic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.operators.dewey import explode_path
from recallspark.session import materialize, scratch_path

#: Siblings that one task orders, about.
SIBLINGS_PER_TASK = 200_000


def _number(df: DataFrame) -> DataFrame:
    """Adds a unique long n. It is written before use, as ids drawn at run time may change when a task runs again."""
    return materialize(df.withColumn("n", F.monotonically_increasing_id()), "hierarchy-nodes")


def forest(nodes: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """Result, one row per distinct (tree, node): tree, node, parent, root, depth, entry, exit, descendants.

    A node without a parent, or whose parent isn't a node of the same tree, is a root of depth 0 and its own root.
    Where the chain of parents never ends: root '', depth -1, entry, exit and descendants null.
    Between entry and exit (both within one root) lie the entries of exactly the node's descendants.
    Rows with a null node are left out; a null tree is a tree of its own. Rows that repeat count once; among rows of one
    node that name several parents the smallest parent counts. Other columns of the input are not carried.
    """
    distinct = nodes.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent")).filter(F.col("node").isNotNull())
    distinct = distinct.groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    numbered = _number(distinct)
    ids = numbered.select(F.col("tree").alias("_t"), F.col("node").alias("_p"), F.col("n").alias("up"))
    joined = numbered.join(ids, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_p")), "left").drop("_t", "_p")
    linked = materialize(joined, "hierarchy-links")

    inner = linked.filter(F.col("up").isNotNull()).select("n", "up")
    ordered, first_child = _siblings(inner, max(1, inner.count() // SIBLINGS_PER_TASK))
    # Arc 2n goes down into n, arc 2n + 1 up out of n.
    down = linked.select("n").join(first_child, "n", "left").select((F.col("n") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("n") * 2 + 1).alias("succ"))
    up = linked.select("n").join(ordered, "n", "left").select((F.col("n") * 2 + 1).alias("arc"), F.coalesce(F.col("next") * 2, F.col("up") * 2 + 1).alias("succ"))
    ranked = _rank(down.unionByName(up))

    # steps and gain count the arcs after an arc up to the list's end, which is the root's up arc.
    into = ranked.filter(F.col("arc") % 2 == 0).select((F.col("arc") / 2).cast("bigint").alias("n"), F.col("steps").alias("a"), "gain", ((F.col("last") - 1) / 2).cast("bigint").alias("root_n"))
    outof = ranked.filter(F.col("arc") % 2 == 1).select(((F.col("arc") - 1) / 2).cast("bigint").alias("n"), F.col("steps").alias("b"))
    ranks = into.join(outof, "n")
    lengths = ranks.filter(F.col("n") == F.col("root_n")).select("root_n", F.col("a").alias("_length"))
    names = linked.select(F.col("n").alias("root_n"), F.col("node").alias("root"))
    roots = lengths.join(names, "root_n")
    placed = linked.join(ranks, "n", "left").join(roots, "root_n", "left")
    return placed.select(
        "tree", "node", "parent",
        F.coalesce("root", F.lit("")).alias("root"),
        # After the arc into v the tour goes up once more than down, and once again for each level v lies below the root.
        F.coalesce(F.col("gain") - 1, F.lit(-1)).cast("int").alias("depth"),
        (F.col("_length") - F.col("a")).alias("entry"),
        (F.col("_length") - F.col("b")).alias("exit"),
        F.floor((F.col("a") - F.col("b") - 1) / 2).cast("bigint").alias("descendants"),
    )


def _siblings(inner: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(n, up, next) and (n, child): each child's next sibling and each parent's first child.

    Siblings are ordered within buckets and the buckets of a parent are then chained, so that a node whose children are a
    third of all rows is spread over tasks.
    """
    bucketed = inner.withColumn("bucket", F.pmod(F.xxhash64("n"), F.lit(buckets)))
    within = bucketed.withColumn("next", F.lead("n").over(Window.partitionBy("up", "bucket").orderBy("n")))
    heads = bucketed.groupBy("up", "bucket").agg(F.min("n").alias("head"), F.max("n").alias("tail"))
    first_child = heads.groupBy("up").agg(F.min(F.struct("bucket", "head")).alias("first")).select(F.col("up").alias("n"), F.col("first.head").alias("child"))
    if buckets == 1:
        return within.select("n", "up", "next"), first_child
    chained = heads.select(F.col("tail").alias("n"), F.lead("head").over(Window.partitionBy("up").orderBy("bucket")).alias("following"))
    return within.join(chained, "n", "left").select("n", "up", F.coalesce("next", "following").alias("next")), first_child


def _rank(arcs: DataFrame) -> DataFrame:
    """Pointer jumping over (arc, succ). Result: arc, steps, gain, last, of the arcs whose list ends.

    steps: arcs still to come; gain: ups minus downs among them; last: the list's last arc. The state is one row of five
    longs per arc; only arcs that haven't ended are stepped. Lineage is cut by a written table per round.
    """
    weight = F.when(F.col("succ") % 2 == 1, 1).when(F.col("succ") % 2 == 0, -1).otherwise(0)
    ends = F.col("succ").isNull()
    state = arcs.select("arc", "succ", F.when(ends, 0).otherwise(1).cast("bigint").alias("steps"), weight.cast("bigint").alias("gain"), F.when(ends, F.col("arc")).alias("last"))
    spark, schema = arcs.sparkSession, state.schema
    path = scratch_path(spark, "hierarchy-jump-0")
    state.write.parquet(path)
    ended = [spark.read.schema(schema).parquet(path).filter(ends)]
    open_ = spark.read.schema(schema).parquet(path).filter(~ends)
    left, rounds = open_.count(), 0
    while left:
        rounds += 1
        target = open_
        for part in ended:
            target = target.unionByName(part)
        target = target.select(F.col("arc").alias("succ"), F.col("succ").alias("to"), F.col("steps").alias("more_steps"), F.col("gain").alias("more_gain"), F.col("last").alias("to_last"))
        jumped = open_.drop("last").join(target, "succ").select("arc", F.col("to").alias("succ"), (F.col("steps") + F.col("more_steps")).alias("steps"), (F.col("gain") + F.col("more_gain")).alias("gain"), F.col("to_last").alias("last"))
        jumped = materialize(jumped, f"hierarchy-jump-{rounds}")
        ended.append(jumped.filter(ends))
        open_ = jumped.filter(~ends)
        still = open_.count()
        if still == left:  # no list ended in this round: all that is left runs in circles
            break
        left = still
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out.select("arc", "steps", "gain", "last")


def found(branches: DataFrame, backups: DataFrame) -> DataFrame:
    """(src, tree_id, node_id, root_id, depth) of all branches, and of the leaf at which each backed-up conversation stands.

    A tree is a conversation_id of the branches, or one conversation within one backup.
    """
    path = branches.select(F.struct(F.lit("branch_path").alias("src"), F.lit(None).cast("bigint").alias("row"), F.col("conversation_id").alias("id")).alias("tree"), F.col("branch_id").alias("node"), F.col("parent_branch_id").alias("parent"), F.lit(True).alias("asked"))
    leaf = explode_path(backups, "backup_id", "data", ["conversations"]).select("backup_id", F.col("node.id").alias("cid"), F.col("node.currentLeafSourceMessageId").alias("leaf")).filter(F.col("leaf").isNotNull()).distinct()
    said = explode_path(backups, "backup_id", "data", ["messages"]).select("backup_id", F.col("node.conversationId").alias("cid"), F.col("node.sourceMessageId").alias("node"), F.col("node.parentSourceMessageId").alias("parent"))
    # Only conversations that have an entry leaf need their tree.
    said = said.join(leaf.select("backup_id", "cid").distinct(), ["backup_id", "cid"], "left_semi")
    message = said.select(F.struct(F.lit("room_ferry_backup_v1").alias("src"), F.col("backup_id").alias("row"), F.col("cid").alias("id")).alias("tree"), "node", "parent", F.lit(False).alias("asked"))
    placed = forest(path.unionByName(message), "tree", "node", "parent")
    flat = placed.select(F.col("tree.src").alias("src"), F.col("tree.row").alias("row"), F.col("tree.id").alias("tree_id"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")
    asked = leaf.select(F.lit("room_ferry_backup_v1").alias("src"), F.col("backup_id").alias("row"), F.col("cid").alias("tree_id"), F.col("leaf").alias("node_id"))
    columns = ["src", "tree_id", "node_id", "root_id", "depth"]
    leaves = flat.filter(F.col("src") == "room_ferry_backup_v1").join(asked, ["src", "row", "tree_id", "node_id"], "left_semi").select(columns)
    return flat.filter(F.col("src") == "branch_path").select(columns).unionByName(leaves).distinct()


def ancestor_pairs(placed: DataFrame) -> DataFrame:
    """(tree, ancestor, node, distance) for every node and each of its ancestors, of a forest() result.

    Doubling over the parent links: log2(deepest) joins. Nodes of depth -1 give no rows. The rows are the sum of all
    depths; ask for them only where they are wanted, since entry and exit answer ancestor tests without them.
    """
    edges = placed.filter(F.col("depth") > 0).select("tree", F.col("parent").alias("ancestor"), "node", F.lit(1).alias("distance"))
    pairs, reach = materialize(edges, "hierarchy-pairs"), 1
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    while reach < deepest:
        # Of a node's ancestors up to reach the farthest one's own list goes on from there.
        farthest = pairs.filter(F.col("distance") == reach).select("tree", F.col("ancestor").alias("via"), "node")
        longer = farthest.join(pairs.select("tree", F.col("node").alias("via"), "ancestor", F.col("distance").alias("beyond")), ["tree", "via"]).select("tree", "ancestor", "node", (F.col("beyond") + reach).alias("distance"))
        pairs, reach = materialize(pairs.unionByName(longer), "hierarchy-pairs"), reach * 2
    return pairs


def paths(placed: DataFrame, separator: str = "/") -> DataFrame:
    """(tree, node, path) with the ids from the root down to the node; null for nodes of depth -1."""
    up = ancestor_pairs(placed).groupBy("tree", "node").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("k"), F.col("ancestor").alias("id")))).alias("chain"))
    named = placed.select("tree", "node", "depth").join(up, ["tree", "node"], "left")
    chain = F.concat(F.coalesce(F.transform("chain", lambda x: x["id"]), F.array().cast("array<string>")), F.array("node"))
    return named.select("tree", "node", F.when(F.col("depth") >= 0, F.array_join(chain, separator)).alias("path"))

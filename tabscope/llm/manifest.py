"""Merkle manifest of a table: leaves, one tree per group of rows, one tree over the groups.

Every row is a leaf.  A group's leaves stand in order; 16 consecutive nodes (the last run may be
shorter) become one node until a single one remains, the group's *subroot*; the subroots, in the
order of the groups, become the *root* likewise.

Numbering needs no group in one task: narrow rows (id, group, digest) are range-partitioned once
and numbered inside partitions; one summary row per partition carries positions and group numbers
onward, so a group may hold any share of the rows.

Proofs come by *pointer jumping*.  Each inner node holds a pointer to its parent and the siblings
on the way, as one (left, right) pair per level.  A self-join replaces every pointer by the
pointer of the node it points to and concatenates the siblings; the distance doubles in each
round, so a tree of depth ``d`` takes ``log2(d)`` rounds.  Leaves of one run share everything above
their run, so pointers begin at runs and the leaves join last.  As pointers climb, many nodes
point to few: they meet in blocks of ``BLOCK`` positions, so that no key holds more rows than that
for each level, and each block fetches the ancestor's row once.

Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabscope.llm import common as C

ARITY = 16
#: Rows of a range partition.
PART_ROWS = 1 << 18
#: Positions of a level that fetch an ancestor together.
BLOCK = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field for hashing: ``-`` if null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return digest(*[field(c) for c in fields.values()])


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _parted(digests: Column, at: Column) -> Column:
    """The siblings of place ``at`` (from 0) in a run."""
    return F.struct(_joined(F.slice(digests, 1, at)).alias("left"), _joined(F.slice(digests, at + 2, ARITY)).alias("right"))


def _number(leaves: DataFrame, room: str) -> DataFrame:
    """``g, pos`` and the columns of ``leaves`` (``doc_id, label, leaf, altered``): the group's place
    among the groups and the leaf's place in its group, both from 0."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // PART_ROWS))
    label = F.col("label").asc_nulls_first()
    # Equal rows may trade places; a number of their own lets them lie in several partitions.
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("tie").asc()]
    placed = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, label, *order).withColumn("part", F.spark_partition_id())
    placed = C.stored(placed, f"{room}/placed")
    held = F.struct(F.col("label").isNotNull().alias("known"), "label", "n")
    ends = (placed.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("part")
            .agg(F.min(held).alias("first"), F.max(held).alias("last"), F.count(F.lit(1)).alias("groups")))
    lifts, began, open_rows, before = [], 0, 0, None
    for e in sorted(ends.collect(), key=lambda e: e["part"]):  # one row per range partition
        goes_on = before is not None and (e["first"]["known"], e["first"]["label"]) == before
        lifts.append((e["part"], began - goes_on, open_rows if goes_on else 0))
        open_rows = (open_rows if goes_on and e["groups"] == 1 else 0) + e["last"]["n"]
        began += e["groups"] - goes_on
        before = (e["last"]["known"], e["last"]["label"])
    lift = F.broadcast(spark.createDataFrame(lifts, "part int, base bigint, offset bigint"))  # as many rows
    ranked = placed.withColumn("_g", F.dense_rank().over(Window.partitionBy("part").orderBy(label)))
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("part", "label").orderBy(*order))).join(lift, "part")
    return ranked.select((F.col("base") + F.col("_g") - 1).alias("g"), (F.when(F.col("_g") == 1, F.col("offset")).otherwise(0) + F.col("_n") - 1).alias("pos"),
                         "doc_id", "label", "leaf", "altered")


def _runs(nodes: DataFrame, *extra: str) -> DataFrame:
    """``g, run, members, lone, above``: runs of at most 16 nodes in order, whether a run is its
    group's only node, and the digest of what stands above it."""
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *extra)))
    runs = nodes.groupBy("g", F.expr(f"pos div {ARITY}").alias("run")).agg(members.alias("members"))
    lone = (F.col("run") == 0) & (F.size("members") == 1)
    return runs.withColumn("lone", lone).withColumn("above", F.when(lone, F.col("members")[0]["digest"]).otherwise(digest(_joined(F.col("members")["digest"]))))


def _name(tier: int, level: int, g: Column, pos: Column) -> Column:
    return F.concat_ws(".", F.lit(str(tier)), F.lit(str(level)), g.cast("string"), pos.cast("string"))


def _up(tier: int, level: int) -> Column:
    """The name of what stands above a run: its parent, or the top tier's node for a lone one."""
    over = _name(1, 0, F.lit(0), F.col("g")) if tier == 0 else F.lit(None).cast("string")
    return F.when(F.col("lone"), over).otherwise(_name(tier, level + 1, F.col("g"), F.col("run")))


def _pointers(runs: DataFrame, tier: int, level: int) -> DataFrame:
    """``node, block, up, siblings, subroot`` of a level's nodes."""
    each = runs.select("g", "run", "lone", _up(tier, level).alias("up"), F.col("members")["digest"].alias("digests"), F.posexplode("members").alias("at", "m"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    return each.select(_name(tier, level, F.col("g"), F.col("m.pos")).alias("node"), F.expr(f"m.pos div {BLOCK}").alias("block"), "up",
                       F.when(F.col("lone"), none).otherwise(F.array(_parted(F.col("digests"), F.col("at")))).alias("siblings"),
                       (F.col("m.digest") if tier == 1 and level == 0 else F.lit(None).cast("string")).alias("subroot"))


def _climb(nodes: DataFrame, tier: int, level: int, room: str, pointers: list[DataFrame]) -> DataFrame:
    """Builds the levels above ``nodes`` (``g, pos, digest``), adds their pointers and returns the lone ends (``g, above``)."""
    ends = None
    while True:
        runs = C.stored(_runs(nodes), f"{room}/runs{tier}_{level}")
        pointers.append(_pointers(runs, tier, level))
        done = runs.filter("lone").select("g", "above")
        ends = done if ends is None else ends.unionByName(done)
        if runs.filter("not lone").isEmpty():
            return ends
        nodes = runs.filter("not lone").select("g", F.col("run").alias("pos"), F.col("above").alias("digest"))
        level += 1


def _jump(table: DataFrame, room: str) -> DataFrame:
    """Pointers (``node, block, up, siblings, subroot``) followed up to the root."""
    turn = 0
    while True:
        climbing = table.filter("up is not null")
        if climbing.isEmpty():
            return table
        ahead = table.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("siblings").alias("_siblings"), F.col("subroot").alias("_subroot"))
        fetched = climbing.select("up", "block").distinct().join(ahead, "up")
        jumped = climbing.join(fetched, ["up", "block"]).select(
            "node", "block", F.col("_up").alias("up"), F.concat("siblings", "_siblings").alias("siblings"), F.coalesce("subroot", "_subroot").alias("subroot"))
        table = C.stored(jumped.unionByName(table.filter("up is null")), f"{room}/jump{turn}")
        if turn:
            C.discard(table.sparkSession, f"{room}/jump{turn - 1}")
        turn += 1


def audit(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", group: str = "source", text: str = "text", tampered: Column | None = None) -> DataFrame:
    """Build the manifest of ``docs`` and check every row against it.

    A leaf is the digest of ``fields``; trees stand per ``group`` (null first, then by bytes) with
    leaves by ``doc_id`` (null first).  Where ``tampered`` holds, the row is checked with its
    ``text`` lower-cased (A-Z) in place of what the manifest recorded.  One row per row of ``docs``:

    * ``doc_id, leaf, subroot, root``;
    * ``proof``: the siblings' digests level by level from the leaf to the root, left to right;
    * ``folded_root``: what the (tampered or original) leaf and the siblings fold to, and
      ``verified``: whether that is the root.

    Nulls in any column are hashed as such; a text of any length is hashed where it is read and never
    shuffled; rows that repeat an id stand by their digest, equal rows next to each other.  A group
    of one row is its own subroot, a table of one row its own root with an empty proof.  An empty
    table gives no rows.  Other columns are not read.
    """
    room = C.workroom(docs.sparkSession, "manifest")
    values = {f: docs[f"`{f}`"] for f in fields}
    changed = leaf_digest({**values, text: F.translate(values[text], UPPER, LOWER)})
    altered = F.when(tampered, changed) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(docs[f"`{doc_id}`"].cast("bigint").alias("doc_id"), docs[f"`{group}`"].cast("string").alias("label"), leaf_digest(values).alias("leaf"), altered.alias("altered"))
    numbered = _number(C.stored(leaves, f"{room}/leaves"), room)
    runs = C.stored(_runs(numbered.withColumnRenamed("leaf", "digest"), "doc_id", "altered"), f"{room}/runs")
    C.discard(docs.sparkSession, f"{room}/leaves", f"{room}/placed")
    pointers: list[DataFrame] = []
    subroots = _climb(runs.filter("not lone").select("g", F.col("run").alias("pos"), F.col("above").alias("digest")), 0, 1, room, pointers)
    subroots = subroots.unionByName(runs.filter("lone").select("g", "above"))
    tops = _climb(subroots.select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("pos"), F.col("above").alias("digest")), 1, 0, room, pointers)
    root = tops.first()
    table = pointers[0]
    for more in pointers[1:]:
        table = table.unionByName(more)
    paths = _jump(C.stored(table, f"{room}/pointers"), room)
    # Runs and the nodes above them are one to one, but for runs of one row.
    joined = runs.withColumn("node", _up(0, 0)).join(paths.select("node", "siblings", "subroot"), "node")
    above = _joined(F.transform("siblings", lambda s: F.concat(s["left"], s["right"])))
    each = joined.select("lone", "subroot", "siblings", above.alias("above"), F.col("members")["digest"].alias("digests"), F.posexplode("members").alias("at", "m"))
    each = each.withColumn("own", _parted(F.col("digests"), F.col("at")))
    start = F.coalesce("m.altered", "m.digest")
    start = F.when(F.col("lone"), start).otherwise(digest(F.col("own.left"), start, F.col("own.right")))
    folded = F.aggregate("siblings", start, lambda acc, s: digest(s["left"], acc, s["right"]))
    out = each.select(F.col("m.doc_id").alias("doc_id"), F.col("m.digest").alias("leaf"), "subroot", F.lit(root["above"] if root else None).cast("string").alias("root"),
                      F.concat("own.left", "own.right", "above").alias("proof"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

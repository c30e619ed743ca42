"""Merkle manifest of a document table, proofs by pointer jumping.

Every row is a leaf, the digest of its columns. The leaves of a language, in
the order of their ids, are joined two by two until one node remains; these
subroots are joined in the same way to the root. A leaf's proof is the list of
the siblings on its way up.

Places are found without a window over a language: rows are range-partitioned
and sorted, and a small table of each partition's runs gives the offsets. The
trees are built ``step`` levels at a time, 2 ** step consecutive nodes a group,
so a group is bounded and a pass shrinks the nodes by its size. Each node also
gets its segment there: the siblings up to its ancestor ``step`` levels
higher. Then pointers jump: nodes are joined with the segments of the
ancestors they point to, which doubles the distance, until every leaf reaches
its subroot. Before a jump over d levels only ancestors at heights divisible
by d are pointed to, so the joined table shrinks to its own 2 ** d-th part
from jump to jump: it is either small, and Spark sends it to the tasks after
checking its size, or has so many keys that no key is hot.

Defined cases: null columns are leaves like any other (null id first, never
tampered); equal ids are ordered by digest, equal rows in any order, each a
leaf of its own; a null language is one language, first in order; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels built in one pass; a group holds 2 ** STEP nodes.
STEP = 6
#: Rows whose id's checksum this divides are tampered with.
TAMPER = 7
# A step of a path: one of these bytes and the sibling's digest, or nothing where a node is alone.
LEFT, RIGHT = "X'00'", "X'01'"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest(text: Column) -> Column:
    """The text's sha256, 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def field(value: Column) -> Column:
    """Byte count, colon and value; a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """``(key, digest, item)`` of every row: key orders languages bytewise,
    null first; item holds doc_id, the tampered leaf (null if the row is left
    as it is) and a number of the row."""
    def leaf(n_chars: Column) -> Column:
        return digest(F.concat(*(field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS)))
    chosen = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0)
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    item = F.struct(F.col("doc_id"), F.when(chosen, leaf(more)).alias("tampered"),
                    F.monotonically_increasing_id().alias("nr"))
    docs = docs.select(F.col("doc_id").cast("bigint"), "source", "lang", F.col("n_chars").cast("bigint"), "text")
    return docs.select(F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("key"),
                       leaf(F.col("n_chars")).alias("digest"), item.alias("item"))


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with pos, a node's place (from 0) among those of its key, and
    size, their number. Ties of ``order`` must be broken by its last column."""
    order = ("key", *order)
    t = cut_lineage(nodes.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("place", F.monotonically_increasing_id())
                    .withColumn("part", F.expr("shiftright(place, 33)")), "merkle-ranked")
    runs = t.groupBy("key", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut_lineage(runs.select("key", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
                                   F.sum("n").over(Window.partitionBy("key")).alias("size")), "merkle-runs")
    return t.join(runs, ["key", "part"]).select(
        *nodes.columns, (F.col("place") - F.col("first") + F.col("offset")).alias("pos"), "size")


def parents(level: Column) -> Column:
    """The digests above a level's, two by two."""
    def one(i: Column) -> Column:
        return digest(F.concat(hexed(F.get(level, 2 * i)), F.coalesce(hexed(F.get(level, 2 * i + 1)), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), ((F.size(level) - 1) / 2).cast("int")), one)


def sibling(level: Column, i: Column) -> Column:
    """The step of a path beside node ``i`` of a level."""
    return (F.when(i % 2 == 1, F.concat(F.expr(LEFT), F.get(level, i - 1)))
            .otherwise(F.coalesce(F.concat(F.expr(RIGHT), F.get(level, i + 1)), F.expr("X''"))))


def grouped(nodes: DataFrame, height: int, step: int) -> DataFrame:
    """One row for each 2 ** step consecutive nodes of a key at ``height``:
    its members in order, and the levels above them up to ``height + step`` or
    the key's last."""
    blocks = (nodes.groupBy("key", "size", F.expr(f"shiftright(pos, {step})").alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "item"))).alias("members")))
    up = F.least(F.lit(step), F.col("depth") - height)
    blocks = blocks.withColumn("depth", F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0))
    ground = F.array(F.transform("members", lambda m: m["digest"]))
    tree = F.when(up > 0, F.aggregate(F.sequence(F.lit(1), up), ground,
                                      lambda acc, _: F.concat(acc, F.array(parents(F.element_at(acc, -1))))))
    return cut_lineage(blocks.withColumn("up", up).withColumn("tree", tree.otherwise(ground)), "merkle-levels")


def tops(blocks: DataFrame) -> DataFrame:
    """The one node above each block."""
    return blocks.select("key", "size", "depth", F.col("block").alias("pos"),
                         F.get(F.element_at("tree", -1), F.lit(0)).alias("digest"), "up")


def segments(blocks: DataFrame, height: int, step: int) -> DataFrame:
    """Every member with its path to its block's top, and where that stands:
    ``(key, pos, digest, item, height, depth, reach, at, path)``."""
    rows = blocks.select("key", "depth", "up", "tree", F.col("block").alias("at"), F.posexplode("members").alias("i", "m"))
    path = F.when(F.col("up") > 0, F.transform(
        F.sequence(F.lit(0), F.col("up") - 1),
        lambda k: sibling(F.get("tree", k), F.call_function("shiftright", F.col("i"), k))))
    return rows.select("key", "m.pos", "m.digest", "m.item", F.lit(height).alias("height"), "depth",
                       (F.lit(height) + F.col("up")).alias("reach"), "at",
                       path.otherwise(F.expr("cast(array() as array<binary>)")).alias("path"))


def jump(rows: DataFrame, above: DataFrame) -> DataFrame:
    """``rows`` whose paths go on with those of the ancestors they reach. Rows
    that have arrived get a place of their own, which no ancestor has: they all
    stand at one node, and it must not become a hot key."""
    rows = rows.withColumn("at", F.when(F.col("reach") >= F.col("depth"), -1 - F.col("pos")).otherwise(F.col("at")))
    a = above.select("key", F.col("height").alias("reach"), F.col("pos").alias("at"), F.col("reach").alias("reach_"),
                     F.col("at").alias("at_"), F.col("path").alias("path_"))
    joined = rows.join(a, ["key", "reach", "at"], "left")
    return joined.select("key", "pos", "digest", "item", "height", "depth", F.coalesce("reach_", "reach").alias("reach"),
                         F.coalesce("at_", "at").alias("at"),
                         F.when(F.col("path_").isNull(), F.col("path")).otherwise(F.concat("path", "path_")).alias("path"))


def proofs(nodes: DataFrame, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """For the leaves ``nodes(key, digest, item, pos, size)``: each with the
    path to its key's last node, ``(key, digest, item, path)``, and that node,
    ``(key, digest)``. The path's steps are the siblings, lowest first."""
    blocks = grouped(nodes, 0, step)
    low = segments(blocks, 0, step)
    most = blocks.agg(F.max("depth")).first()[0] or 0
    roots, inner, height = None, None, 0
    while True:
        top = tops(blocks)
        last = top.where(F.col("depth") == height + F.col("up")).select("key", "digest")
        roots = last if roots is None else roots.union(last)
        height += step
        if height >= most:
            break
        item = F.lit(None).cast("string").alias("item")
        blocks = grouped(top.where(F.col("depth") > height).select("key", "size", "pos", "digest", item), height, step)
        more = segments(blocks, height, step)
        inner = more if inner is None else inner.union(more)
    reach = step
    while reach < most:
        inner = cut_lineage(inner.where(F.col("height") % reach == 0), "merkle-inner")
        low = jump(low, inner)
        inner = jump(inner.where(F.col("height") % (2 * reach) == 0), inner)
        reach *= 2
    return low.select("key", "digest", "item", "path"), roots


def folded(start: Column, path: Column) -> Column:
    """The last node's digest, as hex text, recomputed from a leaf and its path."""
    def up(acc: Column, s: Column) -> Column:
        other = hexed(F.substring(s, 2, 32))
        both = F.when(F.length(s) == 0, acc).when(F.substring(s, 1, 1) == F.expr(LEFT), F.concat(other, acc))
        return F.sha2(both.otherwise(F.concat(acc, other)).cast("binary"), 256)
    return F.aggregate(path, hexed(start), up)


def manifest(docs: DataFrame, step: int = STEP) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``
    of every row of ``docs``."""
    numbered = cut_lineage(leaves(docs).withColumn("nr", F.col("item.nr")).withColumn("doc_id", F.col("item.doc_id")), "merkle-leaves")
    numbered = ranked(numbered, "doc_id", "digest", "nr").drop("doc_id", "nr")
    rows, subroots = proofs(numbered, step)
    subroots = cut_lineage(subroots, "merkle-subroots")
    langs = subroots.select(F.lit("").alias("key"), "digest", F.col("key").alias("item"))
    upper, root = proofs(ranked(langs, "item"), step)
    upper = cut_lineage(upper.join(root.select("key", F.col("digest").alias("root")), "key")
                        .select(F.col("item").alias("key"), F.col("digest").alias("subroot"), "root",
                                F.col("path").alias("beyond")), "merkle-languages")
    path = F.concat("path", "beyond")
    out = rows.join(upper, "key").select("item", "digest", "subroot", "root", path.alias("path"))
    siblings = F.array_join(F.transform("path", lambda s: hexed(F.substring(s, 2, 32))), "")
    out = out.select(F.col("item.doc_id").alias("doc_id"), hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"),
                     hexed(F.col("root")).alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
                     folded(F.coalesce("item.tampered", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Conversation prefix trie, built level by level.

Turns are numbered within their conversation by ranges, so a conversation of any length is never one task. Conversations with the
same turns throughout are one class (least conv_id, number of members), told apart by two 64-bit sums over turns' digests: copies
meet once, before the levels. Then, for each depth, the classes that are still live are grouped by (parent node, next turn), and a
group is a node named by its least conv_id. A group of one class is closed: the rest of its conversation is a chain, written at
once at the end, so that rounds go on only as deep as different conversations agree. Going back from the deepest level to the
root, leaves and savings are summed up by joins of children with parents.

Turns go by turn, null first; rows of one turn number in the order of their digests. Null roles and texts are empty. Rows without
conv_id are left out. Repeated rows are turns of their own. An empty table gives no rows, not even a root. Very long texts are
hashed where they are read and never shuffled. Columns other than conv_id, turn, role and text are not read.

The digest of the members that end at a node is one sequential hash by definition; their ids come to it in sorted blocks of up to
4096, streamed, so its task holds one block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findgrid.llm.common import n_words, released, save, small_batches

#: Bits of a conv_id that its block of the members' digest leaves out.
BLOCK_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d, key, w, before): d from 1, key the digest of role and text, w the text's words, before the words of earlier
    turns; and conversations (conv_id, len, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), n_words(text).alias("w"))
    by = ["conv_id", "turn", "key"]
    ranges = slim.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ranges = save(ranges.select("conv_id", F.shiftright("at", 33).alias("part"), "at", "key", "w"), "turns")
    here = Window.partitionBy("part", "conv_id").orderBy("at")
    placed = ranges.withColumn("place", F.row_number().over(here)).withColumn("upto", F.sum("w").over(here))
    groups = ranges.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.sum("w").alias("sum_w"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    groups = save(groups.select("part", "conv_id", "n", "sum_w", none("n").alias("n_before"), none("sum_w").alias("w_before")), "ranges")
    turns = placed.join(groups, ["part", "conv_id"]).select("conv_id", (F.col("n_before") + F.col("place")).alias("d"), "key", "w", (F.col("w_before") + F.col("upto") - F.col("w")).alias("before"))
    return save(turns, "turns"), groups.groupBy("conv_id").agg(F.sum("n").alias("len"), F.sum("sum_w").alias("words"))


def rebuilt(turns: DataFrame, convs: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Both tables of ordered() with branches: conversation c starts with the first h turns of conversation c - c % every instead of
    its own first h, h being the crc32 of its decimal number modulo `heads`. A branch may have no turn left."""
    few = turns.filter(F.col("d") < heads)
    upto = F.array(F.lit(0).cast("long"), *(F.sum(F.when(F.col("d") <= k, F.col("w")).otherwise(0)) for k in range(1, heads)))
    first = save(few.groupBy("conv_id").agg(F.count("*").alias("n"), upto.alias("upto")), "first-turns")
    base = first.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("upto").alias("base_upto"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    plan = convs.join(first.select("conv_id", "upto"), "conv_id", "left").withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(base, "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)).cast("int"))).withColumn("skip", F.least("h", F.col("len").cast("int")))
    shift = F.coalesce(F.element_at("base_upto", F.col("taken") + 1), F.lit(0)) - F.coalesce(F.element_at("upto", F.col("skip") + 1), F.lit(0))
    plan = save(plan.withColumn("shift", shift), "branches")
    own = turns.join(plan, "conv_id").filter(F.col("d") > F.col("h")).select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "key", "w", (F.col("before") + F.col("shift")).alias("before"))
    source = few.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), "d", "key", "w", "before")
    head = plan.filter("taken > 0").select("conv_id", "base", "taken").join(source, "base").filter("d <= taken").select("conv_id", "d", "key", "w", "before")
    lens = plan.select("conv_id", (F.col("taken") + F.col("len") - F.col("skip")).alias("len"), (F.col("words") + F.col("shift")).alias("words"))
    return save(own.unionByName(head), "rebuilt"), lens


def _digests(members: DataFrame) -> DataFrame:
    """Rows (rep, digest) of members (rep, conv_id): SHA-256 of the decimal ids, ascending, with commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep = digest = None
        for b in batches:
            done = []
            for r, ids in zip(b.column("rep").to_pylist(), b.column("ids").to_pylist(), strict=True):
                text = ",".join(map(str, ids)).encode()
                if digest is not None and r == rep:
                    digest.update(b"," + text)
                    continue
                if digest is not None:
                    done.append((rep, digest.hexdigest()))
                rep, digest = r, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["rep", "digest"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["rep", "digest"])

    blocks = members.groupBy("rep", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return small_batches(blocks).repartition("rep").sortWithinPartitions("rep", "block").select("rep", "ids").mapInArrow(released(run), "rep long, digest string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of both tables of ordered() or rebuilt(), with the columns COLUMNS.

    n_convs counts conversations that start with the node's turns, n_leaves the childless nodes below or at it, saved_tokens sums
    (n_convs - 1) * words of the last turn over its subtree, ends_sha256 stands for the conversations that end there."""
    mark = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("key", "d")).alias("m1"), F.bit_xor(F.xxhash64("d", "key")).alias("m2"))
    whole = save(convs.join(mark, "conv_id", "left").select("conv_id", "len", "words", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("m1", "m2"))), "conversations")
    classes = save(whole.groupBy("len", "m1", "m2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"), F.max("words").alias("words")), "classes")
    root = classes.agg(F.min("rep")).first()[0]
    if root is None:
        return classes.select(*(F.lit(None).cast("string" if c == "ends_sha256" else "long").alias(c) for c in COLUMNS)).limit(0)
    copies = whole.join(classes.filter("weight > 1").select("len", "m1", "m2", "rep"), ["len", "m1", "m2"]).select("rep", "conv_id")
    digests = save(_digests(copies), "digests")

    of_class = turns.join(classes.select(F.col("rep").alias("conv_id"), "weight", "len", "words"), "conv_id")
    of_class = of_class.select(F.col("conv_id").alias("rep"), "weight", "len", "d", "key", "w", (F.col("words") - F.col("before")).alias("after"))
    of_class = save(of_class.repartitionByRange("d", "rep").sortWithinPartitions("d", "rep"), "levels")  # a level is read by its own files

    live = classes.select("rep", F.lit(root).alias("node"))
    ended = [classes.filter("len = 0").select(F.lit(root).alias("conv_id"), F.lit(0).cast("long").alias("depth"), "rep", "weight")]
    levels: list[DataFrame] = []  # groups of depth 1, 2, ...
    while True:
        d = len(levels) + 1
        rows = save(of_class.filter(F.col("d") == d).join(live, "rep"), "live-turns")
        groups = rows.groupBy("node", "key").agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("*").alias("c"), F.max("w").alias("w"), F.max("after").alias("after"))
        levels.append(save(groups, "groups"))
        shared = levels[-1].filter("c > 1")
        if shared.isEmpty():
            break
        moved = save(rows.select("rep", "node", "key", "len", "weight").join(shared.select("node", "key", "conv_id"), ["node", "key"]).select("rep", F.col("conv_id").alias("node"), "len", "weight"), "live")
        ended.append(moved.filter(F.col("len") == d).select(F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("depth"), "rep", "weight"))
        live = moved.filter(F.col("len") > d).select("rep", "node")

    # chains of classes that are alone from some depth on
    closed = levels[0].filter("c = 1").select(F.col("conv_id").alias("rep"), F.col("node").alias("above"), F.lit(1).cast("long").alias("since"))
    for k, g in enumerate(levels[1:], 2):
        closed = closed.unionByName(g.filter("c = 1").select(F.col("conv_id").alias("rep"), F.col("node").alias("above"), F.lit(k).cast("long").alias("since")))
    last = F.col("d") == F.col("len")
    chains = of_class.join(closed, "rep").filter("d >= since").select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("since"), F.col("above")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * F.col("after")).alias("saved_tokens"), F.when(last, F.col("rep")).alias("ends"),
    )

    # back to the root: what the children of a level's shared nodes sum up to
    below, opened = None, []
    for k in range(len(levels), -1, -1):
        if k == 0:
            own = classes.agg(F.lit(root).alias("conv_id"), F.lit(None).cast("long").alias("node"), F.sum("weight").alias("n_convs"), F.lit(0).cast("long").alias("w"))
        else:
            own = levels[k - 1].filter("c > 1").select("conv_id", "node", "n_convs", "w")
        if below is not None:
            sums = below.groupBy(F.col("node").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
            own = own.join(sums, "conv_id", "left").select("conv_id", "node", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("w") + F.coalesce("below", F.lit(0))).alias("saved"))
            own = save(own, "nodes")
            opened.append(own.select("conv_id", F.lit(k).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens")))
            below = own.select("node", "n_leaves", "saved")
        if k:
            single = levels[k - 1].filter("c = 1").select("node", F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("after")).alias("saved"))
            below = single if below is None else below.unionByName(single)
    shared = opened[0]
    for o in opened[1:]:
        shared = shared.unionByName(o)
    at_ends = ended[0]
    for e in ended[1:]:
        at_ends = at_ends.unionByName(e)
    shared = shared.join(at_ends.select("conv_id", "depth", F.col("rep").alias("ends")), ["conv_id", "depth"], "left")
    nodes = shared.unionByName(chains).withColumnRenamed("ends", "rep")
    single = classes.filter("weight = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("digest"))
    found = nodes.join(digests.unionByName(single), "rep", "left")
    return found.withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY))).select(*COLUMNS)


_BIT = [1996959894, 3993919788, 124634137, 249268274, 498536548, 997073096, 1994146192, 3988292384]  # crc32 of the byte 1 << i alone


def sql_crc32(codes: str) -> str:
    """DuckDB expression for the unsigned crc32 of a list of bytes."""
    byte = "0::UBIGINT"
    for i, t in enumerate(_BIT):
        byte = f"xor({byte}, ((xor(a, x) >> {i}) & 1) * {t}::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda a, x: xor(a >> 8, {byte})), 4294967295::UBIGINT)"


#: The query's rows in DuckDB; prefixes are lists, so it suits small tables only.
ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS l FROM t GROUP BY conv_id),
h AS (SELECT *, ({sql_crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)")} % 4)::BIGINT AS h FROM own),
r AS (SELECT h.conv_id, list_concat(CASE WHEN b.l IS NULL OR h.h = 0 THEN [] ELSE b.l[1:h.h] END, h.l[h.h + 1:]) AS l FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, l[1:d] AS pre, len(l) = d AS ends FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY pre, d),
w AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(pre[d].text, '[^\\x20\\x09-\\x0D]+')) END AS own_saved FROM n),
k AS (SELECT c.pre[1:c.d - 1] AS pre, count(*) AS n_children FROM w c WHERE c.d > 0 GROUP BY 1),
z AS (SELECT w.*, coalesce(k.n_children, 0) AS n_children FROM w LEFT JOIN k ON k.pre = w.pre),
up AS (SELECT pre[1:e] AS pre, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own_saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM z) GROUP BY 1)
SELECT z.conv_id, z.d AS depth, q.conv_id AS parent_conv_id, z.n_convs, z.n_children, CAST(up.n_leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, z.ends_sha256
FROM z JOIN up ON up.pre = z.pre LEFT JOIN n q ON z.d > 0 AND q.d = z.d - 1 AND q.pre = z.pre[1:z.d - 1]
"""

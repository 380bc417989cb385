"""Merkle manifest of a dataset: a tree of SHA-256 digests per group, one tree over the groups, and a proof for every row.

H(inputs) is the lower-case hex SHA-256 of the inputs one after the other: a value is `-` if null, else its UTF-8 byte count, `:` and the
value; a digest is its hex text. Leaves of a group ascend by the order column; while a tree has several nodes, every `arity`
consecutive ones become their H. The tops of the groups, ordered by group (null first, then by bytes), become the leaves of the last tree.

1. Leaves are hashed in one pass over the rows and stored; texts go no further. Places are dealt by range slices of (group, order, digest),
   so that a group with a third of all rows is spread over slices.
2. A level is a sibling-shift self-join: a node at place p with slot s = p mod arity computes the place of its slot-zero sibling (p XOR s
   in a binary tree, p - s otherwise) and meets it by an equi-join; slot-zero rows emit the parents, with their children. Every level is stored.
   A level has a sixteenth of the rows of the one below, whatever the groups' sizes; trees that have shrunk to one node leave.
3. Going down, the children of a node get its path and put their own siblings before it: (digests to the left, digests to the right) from
   leaf to root. A join has a row per node, so a leaf is met once.

Defined results: rows that repeat an order value, null too (nulls come first), are ordered by their digest, and equal rows each have a
leaf; a null group is a group; an empty table gives no rows; a group of one row has its leaf as top, and a single group's top is the root; texts of any
length are one leaf; columns that are neither fields, order, group nor in `carried` are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise as _materialise
from .common import table

ARITY = 16
#: What a leaf of the documents holds, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEP = "struct<left string, right string>"
#: Nodes of a level in one file at least.
FILE_ROWS = 50_000


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Stored as it is, since digests do not compress; a table of at most `rows` rows in no more files than it needs."""
    return _materialise(df if rows is None else df.coalesce(-(-rows // FILE_ROWS) or 1), label, "uncompressed")


def value(x: Column) -> Column:
    """A value as H takes it."""
    s = x.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[value(x) for x in values]), 256)


def placed(rows: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, int, int, int]:
    """Rows with `g` and `item`: pos, the place within g (from 0), and n, the rows of g; the largest n, all rows, and the groups. No group is ever in one task."""
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    slices = materialise(dealt.withColumns({"_slice": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), label)
    per = slices.groupBy("g", "_slice").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy("g")  # a row per slice
    before = F.sum("_c").over(own.orderBy("_slice")) - F.col("_c")
    per = materialise(per.select("g", "_slice", "_first", "_c", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(own).alias("n")), f"{label}-counts")
    most, total, groups = per.agg(F.max("n"), F.sum("_c"), F.count_if(F.col("_shift") + F.col("_first") == 0)).first()
    at = slices.join(per, ["g", "_slice"]).select("g", (F.col("_row") + F.col("_shift")).alias("pos"), "n", "item")
    return at, most or 0, total or 0, groups


def _digests(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x["digest"]), "")


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """Parents of one level: g, pos, n (of the parents' level), items (the children in order)."""
    slot = F.pmod("pos", F.lit(arity))
    zero = F.col("pos").bitwiseXOR(slot) if arity == 2 else F.col("pos") - slot
    first = nodes.where(slot == 0).select("g", F.col("pos").alias("zero"), "n", F.col("item").alias("_own"))
    others = nodes.where(slot != 0).select("g", zero.alias("zero"), F.struct(slot.alias("slot"), "item").alias("_other"))
    met = first.join(others, ["g", "zero"], "left").groupBy("g", "zero").agg(F.first("n").alias("n"), F.first("_own").alias("_own"), F.array_sort(F.collect_list("_other")).alias("_others"))
    items = F.concat(F.array("_own"), F.transform("_others", lambda x: x["item"]))
    return met.select("g", F.floor(F.col("zero") / arity).alias("pos"), F.ceil(F.col("n") / arity).alias("n"), items.alias("items"))


def _climb(nodes: DataFrame, most: int, total: int, groups: int, arity: int, label: str) -> tuple[list[tuple[DataFrame, DataFrame | None]], DataFrame]:
    """Levels from the leaves up as (nodes that are alone in their tree, stored parents of the others), and the top of every tree: g, digest."""
    levels = []
    while True:
        total = total // arity + groups  # every group has one run at most that is not full
        runs = materialise(_runs(nodes.where(F.col("n") > 1), arity), label, total) if most > 1 else None
        levels.append((nodes.where(F.col("n") == 1), runs))
        if runs is None:
            break
        nodes = runs.select("g", "pos", "n", F.struct(F.sha2(_digests(F.col("items")), 256).alias("digest")).alias("item"))
        most = -(-most // arity)
    tops = [alone.select("g", F.col("item.digest").alias("digest")) for alone, _ in levels]
    return levels, materialise(reduce(DataFrame.unionByName, tops), f"{label}-tops", groups)


def _descend(levels: list[tuple[DataFrame, DataFrame | None]], tops: DataFrame, arity: int) -> DataFrame:
    """The item of every leaf with the path of its tree's top (`top`: a struct with `path`) behind its own."""
    above = None
    for alone, runs in reversed(levels):
        here = alone.join(tops, "g").select("g", "pos", "item", "top", F.col("top.path").alias("path"))
        if runs is not None:
            at = runs.join(above.select("g", "pos", "top", "path"), ["g", "pos"])
            each = at.select("g", "top", "path", "items", F.posexplode("items").alias("slot", "item"), F.size("items").alias("k"), F.col("pos").alias("_p"))
            own = F.struct(_digests(F.slice("items", 1, F.col("slot"))).alias("left"), _digests(F.slice("items", F.col("slot") + 2, F.col("k"))).alias("right"))
            here = here.unionByName(each.select("g", (F.col("_p") * arity + F.col("slot")).alias("pos"), "item", "top", F.concat(F.array(own), F.col("path")).alias("path")))
        above = here
    return above


def leaves(rows: DataFrame, group: str, order: str, fields: list[str], carried: dict[str, Column] | None = None) -> DataFrame:
    """g (sort key of the group), item (digest, order value and carried columns): one pass over the rows, stored."""
    g = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("g"), F.col(group).cast("string")))
    item = F.struct(leaf_digest([F.col(c) for c in fields]).alias("digest"), F.col(order).alias("id"), *[c.alias(n) for n, c in (carried or {}).items()])
    return materialise(rows.select(g.alias("g"), item.alias("item")), "leaves")


def manifest(rows: DataFrame, group: str, order: str, fields: list[str], carried: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """A row per input row: id (the order value), carried columns, leaf, subroot, root, path (array of left and right siblings' digests,
    from leaf to root)."""
    made = leaves(rows, group, order, fields, carried)
    low, *sizes = placed(made, [F.col("item.id").asc_nulls_first(), F.col("item.digest")], "places")
    levels, subroots = _climb(low, *sizes, arity, "level")
    groups, *sizes = placed(subroots.select(F.lit("").alias("g"), F.struct("digest", F.col("g").alias("id")).alias("item")), [F.col("item.id")], "groups")
    upper, roots = _climb(groups, *sizes, arity, "group-level")
    root = roots.select("g", F.struct(F.col("digest").alias("root"), F.array().cast(f"array<{_STEP}>").alias("path")).alias("top"))
    tops = _descend(upper, root, arity).select(F.col("item.id").alias("g"), F.struct("path", F.col("item.digest").alias("subroot"), "top.root").alias("top"))
    found = _descend(levels, materialise(tops, "group-paths", sizes[1]), arity)
    return found.select("item.id", *[f"item.{n}" for n in carried or {}], F.col("item.digest").alias("leaf"), "top.subroot", "top.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    lowered = F.translate("text", _CAPITALS, _CAPITALS.lower())
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    bad = F.when(chosen, leaf_digest([lowered if c == "text" else F.col(c) for c in FIELDS]))
    done = manifest(docs, "source", "doc_id", FIELDS, {"bad": bad})
    root = folded(F.coalesce("bad", "leaf"), F.col("path"))
    out = done.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6, upper: int = 4) -> str:
    """Levels written out: up to 16**6 rows of a source and 16**4 sources."""
    h = lambda text: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in (*FIELDS[:-1], text)) + ")"
    crc = """xor(4294967295, list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii((doc_id::VARCHAR)[i + 1])), lambda c, x:
        list_reduce(range(8), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(c, x)), 4294967295::BIGINT))"""
    lower = f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')"
    parts = [f"leaf AS (SELECT doc_id, source AS g, {h('text')} AS d, CASE WHEN {crc} % 5 = 0 THEN {h(lower)} END AS bad FROM documents)"]
    parts.append("low0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaf)")

    def climb(name: str, count: int) -> None:
        for k in range(count):
            parts.append(f"{name}run{k} AS (SELECT g, pos // 16 AS pos, any_value(n) AS n, list(d ORDER BY pos) AS ds FROM {name}{k} GROUP BY g, pos // 16)")
            parts.append(f"{name}{k + 1} AS (SELECT g, pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {name}run{k})")

    climb("low", levels)
    parts.append(f"up0 AS (SELECT 0 AS g, g AS source, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low{levels})")
    climb("up", upper)

    def fold(name: str, count: int, start: str, at: str, key: str) -> str:
        """A row per level: siblings on both sides, and the digest so far."""
        said = start
        for k in range(count):
            slot = f"((pos // {16**k}) % 16)"
            # a tree that has shrunk to one node has no more siblings
            said = f"""(SELECT w.* EXCLUDE (proof, f), CASE WHEN r.n > 1 THEN w.proof || array_to_string(ds[1:{slot}], '') || array_to_string(ds[{slot} + 2:], '') ELSE w.proof END AS proof,
              CASE WHEN r.n > 1 THEN sha256(array_to_string(ds[1:{slot}], '') || w.f || array_to_string(ds[{slot} + 2:], '')) ELSE w.f END AS f
              FROM {said} w JOIN {name}run{k} r ON r.g IS NOT DISTINCT FROM w.{key} AND r.pos = w.{at} // {16 ** (k + 1)})""".replace("(pos //", f"(w.{at} //")
        return said

    own = fold("low", levels, "(SELECT *, '' AS proof, coalesce(bad, d) AS f FROM low0)", "pos", "g")
    parts.append(f"own AS (SELECT w.*, u.pos AS upos, u.g AS ug, u.d AS subroot FROM {own} w JOIN up0 u ON u.source IS NOT DISTINCT FROM w.g)")
    whole = fold("up", upper, "(SELECT * FROM own)", "upos", "ug")
    parts.append(f"done AS {whole}")
    return f"WITH {', '.join(parts)} SELECT doc_id, done.d AS leaf, subroot, top.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = top.d AS verified FROM done, up{upper} top"


SQL = _sql()

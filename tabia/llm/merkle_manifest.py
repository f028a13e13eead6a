"""Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf; the leaves of a group are in a fixed order. A level is
joined with itself once for each other place of a run: a node looks up the node
whose index it computes (``idx XOR 1`` in a binary tree, ``base + (slot + shift)
% width`` otherwise). With its siblings at hand a node knows its step of the
proof, and the nodes of slot 0 emit the parents. The way back down hands each
node the steps above it, three children to a parent, so no join key is ever hot.

Digests are kept as bytes and hashed as lowercase hex text.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabia.llm.common import table, written
from tabia.llm.ordinals import numbered, salted

WIDTH = 3
STEPS = "array<struct<before:binary,after:binary>>"


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, ``:`` and itself; null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest_of(F.concat(*[field(v) for v in values]))


def group_key(name: str) -> Column:
    """A key that orders null before all texts and texts by their bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def with_siblings(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes (grp, idx, size, h, ...) with ``before`` and ``after``, the digests around them in their run."""
    slot = F.col("idx") % width
    rows = nodes
    for shift in range(1, width):
        wanted = F.col("idx").bitwiseXOR(1) if width == 2 else F.col("idx") - slot + (slot + shift) % width
        other = nodes.select(
            F.col("grp").alias("other_grp"), F.col("idx").alias("other_idx"), F.col("h").alias(f"h{shift}")
        )
        rows = rows.join(
            other, (F.col("grp") == F.col("other_grp")) & (wanted == F.col("other_idx")), "left"
        ).drop("other_grp", "other_idx")
    shifts = F.array(F.lit(None).cast("binary"), *[F.col(f"h{s}") for s in range(1, width)])

    def run(wanted):
        places = [
            F.when(wanted(F.lit(p)), F.get(shifts, F.pmod(F.lit(p) - slot, F.lit(width)).cast("int")))
            for p in range(width)
        ]
        return F.concat(*[F.coalesce(p, F.lit(b"")) for p in places])

    return rows.select(
        *nodes.columns,
        run(lambda p: p < slot).alias("before"),
        run(lambda p: p > slot).alias("after"),
    )


def climbed(nodes: DataFrame, width: int) -> tuple[list[DataFrame], DataFrame]:
    """(stored levels with the siblings of each node, the top digest of every group with its level)."""
    levels, tops = [], []
    current = nodes
    while True:
        tops.append(current.where("size = 1").select("grp", F.lit(len(levels)).alias("level"), "h"))
        current = current.where("size > 1")
        if current.isEmpty():
            return levels, reduce(DataFrame.unionByName, tops)
        level = written(with_siblings(current, width))
        levels.append(level)
        current = level.where(F.col("idx") % width == 0).select(
            "grp",
            F.expr(f"idx div {width}").alias("idx"),
            F.expr(f"(size + {width - 1}) div {width}").alias("size"),
            digest_of(text_of(F.concat("before", "h", "after"))).alias("h"),
        )


def descended(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, width: int) -> DataFrame:
    """``nodes`` with ``steps`` (their siblings, level by level upwards) and the columns of ``tops``.

    ``tops`` has one row a group: grp, level, the steps above the group and
    whatever else its nodes shall carry.
    """
    carried = [c for c in tops.columns if c not in ("grp", "level", "steps")]

    def at(level):
        return tops.where(F.col("level") == level).select(
            F.col("grp").alias("up_grp"), F.lit(0).cast("long").alias("up_idx"), F.col("steps").alias("up"), *carried
        )

    known = at(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        rows = levels[k].join(
            known,
            (F.col("grp") == F.col("up_grp")) & (F.expr(f"idx div {width}") == F.col("up_idx")),
        )
        steps = F.concat(F.array(F.struct("before", "after")), F.col("up"))
        if k == 0:
            rows = rows.withColumn("steps", steps)
            break
        known = rows.select(
            F.col("grp").alias("up_grp"), F.col("idx").alias("up_idx"), steps.alias("up"), *carried
        ).unionByName(at(k))
    alone = nodes.where("size = 1").join(at(0), F.col("grp") == F.col("up_grp")).withColumn("steps", F.col("up"))
    names = [*nodes.columns, "steps", *carried]
    return rows.select(*names).unionByName(alone.select(*names)) if levels else alone.select(*names)


def manifest(leaves: DataFrame, group: str, order: list[str], width: int = WIDTH) -> DataFrame:
    """The leaves with ``subroot``, ``root`` and ``steps``, their proof from leaf to root.

    ``leaves`` has a digest ``h``, the column ``group`` (as ``group_key`` makes
    it) and the columns of ``order``, whose nulls come first. Leaves equal in all
    of these are interchangeable. The top digests of the groups, in the order of
    the keys, are the leaves of one more tree, whose top is the root. An empty
    table gives an empty result.
    """
    rows = leaves.withColumnRenamed(group, "grp")
    nodes = written(numbered(salted(rows), "grp", [*order, "h", "salt"]).drop("salt"))
    levels, tops = climbed(nodes, width)
    groups = tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "level", "h")
    forest = written(numbered(salted(groups), "grp", ["name", "salt"]).drop("salt"))
    upper, top = climbed(forest, width)
    crown = top.select("grp", "level", F.array().cast(STEPS).alias("steps"), F.col("h").alias("root"))
    rooted = written(
        descended(forest, upper, crown, width).select(
            F.col("name").alias("grp"), "level", "steps", F.col("h").alias("subroot"), "root"
        )
    )
    return descended(nodes, levels, rooted, width).drop("idx", "size").withColumnRenamed("grp", group)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest_of(text_of(F.concat(s["before"], h, s["after"]))))


def proof_text(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: text_of(F.concat(s["before"], s["after"]))), "")


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without its line feeds where 2 divides the crc32 of the id, a null one as it is."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def document_manifest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, ``h``, ``changed`` (the leaf after tampering), ``subroot``, ``root``, ``steps``.

    Nulls in any column have a form of their own (``-``), the empty text another
    (``0:``). Rows without source are a group of their own, before all others;
    rows without doc_id come first in their group and are never tampered with.
    Rows of one doc_id are ordered by their digest. Other columns are ignored.
    A text is read once, for its two digests; all later steps carry digests only.
    """
    head = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    leaves = docs.select(
        "doc_id",
        group_key("source").alias("source_key"),
        leaf_of(*head, F.col("text")).alias("h"),
        leaf_of(*head, tampered(F.col("text"), F.col("doc_id"))).alias("changed"),
    )
    return manifest(leaves, "source_key", ["doc_id"], width)


def op11_merkle_manifest(spark, sf_dir):
    rows = document_manifest(table(spark, sf_dir, "documents"))
    found = rows.withColumn("found", folded(F.col("changed"), F.col("steps")))
    return found.select(
        "doc_id",
        text_of(F.col("h")).alias("leaf"),
        text_of(F.col("subroot")).alias("subroot"),
        text_of(F.col("root")).alias("root"),
        F.sha2(proof_text(F.col("steps")).cast("binary"), 256).alias("proof_sha256"),
        text_of(F.col("found")).alias("folded_root"),
        (F.col("found") == F.col("root")).alias("verified"),
    )


ORACLE_OP11 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
    text,
    CASE WHEN xor(4294967295, list_reduce(
        list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT),
        lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[],
          lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
        4294967295::BIGINT)) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents
), leaves AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS bent FROM docs
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
         count(*) OVER (PARTITION BY grp) AS n FROM leaves
), tree(grp, lvl, idx, n, h) AS (
  SELECT grp, 0, idx, n, h FROM numbered
  UNION ALL
  SELECT grp, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM tree
  WHERE n > 1 GROUP BY grp, lvl, idx // 3, n
), subroots AS (
  SELECT grp, lvl AS depth, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), forest(lvl, idx, n, h) AS (
  SELECT 0, idx, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM forest
  WHERE n > 1 GROUP BY lvl, idx // 3, n
), places AS (
  SELECT l.grp, l.idx AS leaf_idx, t.lvl AS step, t.idx AS at, t.lvl
  FROM numbered l JOIN tree t ON t.grp = l.grp AND t.n > 1 AND t.idx = l.idx // (3 ** t.lvl)::BIGINT
), steps AS (
  SELECT p.grp, p.leaf_idx, p.step,
         coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (WHERE t.idx < p.at), '') AS bef,
         coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (WHERE t.idx > p.at), '') AS aft
  FROM places p JOIN tree t ON t.grp = p.grp AND t.lvl = p.lvl AND t.idx // 3 = p.at // 3
  GROUP BY p.grp, p.leaf_idx, p.step
), upper_steps AS (
  SELECT s.grp, s.depth + f.lvl AS step,
         coalesce(string_agg(f.h, '' ORDER BY f.idx) FILTER (WHERE f.idx < s.idx // (3 ** f.lvl)::BIGINT), '') AS bef,
         coalesce(string_agg(f.h, '' ORDER BY f.idx) FILTER (WHERE f.idx > s.idx // (3 ** f.lvl)::BIGINT), '') AS aft
  FROM subroots s JOIN forest f ON f.n > 1 AND f.idx // 3 = (s.idx // (3 ** f.lvl)::BIGINT) // 3
  GROUP BY s.grp, s.depth, f.lvl
), whole AS (
  SELECT grp, leaf_idx, step, bef, aft FROM steps
  UNION ALL
  SELECT l.grp, l.idx, u.step, u.bef, u.aft FROM numbered l JOIN upper_steps u ON u.grp = l.grp
), proofs AS (
  SELECT grp, leaf_idx, sha256(string_agg(bef || aft, '' ORDER BY step)) AS proof, count(*) AS n_steps
  FROM whole GROUP BY grp, leaf_idx
), fold(grp, leaf_idx, step, h) AS (
  SELECT grp, idx, 0, bent FROM numbered
  UNION ALL
  SELECT f.grp, f.leaf_idx, f.step + 1, sha256(w.bef || f.h || w.aft)
  FROM fold f JOIN whole w ON w.grp = f.grp AND w.leaf_idx = f.leaf_idx AND w.step = f.step
), top AS (SELECT h AS root FROM forest WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, top.root, coalesce(p.proof, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = top.root AS verified
FROM numbered l JOIN subroots s ON s.grp = l.grp CROSS JOIN top
LEFT JOIN proofs p ON p.grp = l.grp AND p.leaf_idx = l.idx
JOIN fold f ON f.grp = l.grp AND f.leaf_idx = l.idx AND f.step = coalesce(p.n_steps, 0)
"""

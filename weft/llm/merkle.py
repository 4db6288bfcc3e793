"""A Merkle manifest of a table: a hash tree for each group of rows, and one over the groups' roots. Native expressions only.

1. Leaves are hashed and stored without their texts, ordered by ranges, and numbered within their group: a
   partition's rows are numbered as they stand, and sums over (group, partition) say where each partition begins.
2. ``arity ** LEVELS`` consecutive leaves are one block, an ordered array, whose levels collapse by higher-order
   functions in one row. A block's root is a node of the next round, until every group is one block; a block of
   fewer leaves (the last of its group) goes up as many levels as its neighbours, as the tree's rule has it.
3. Proofs go the other way: a block gets the siblings above its root by one join on (group, block), and deals them
   to its members with their own. No row is joined by its group alone, so a hot group is as many blocks as it needs.

The rule: while a group has several nodes, each run of ``arity`` consecutive ones (the last may be fewer, even one)
becomes the hash of their digests' hex text, one after the other. The groups' roots are joined likewise, in order.

Edge cases: nulls are hashed as "-", an empty text as "0:"; a null group comes first; equal keys are ordered by their
leaves' digests, and repeated rows are leaves each; texts are hashed whole where they lie and go nowhere; an empty table
has no rows and no root; other columns are ignored, but those named in ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm._store import written

ARITY = 2
#: Levels that one block collapses: arity ** LEVELS leaves of some 200 bytes are in one row.
LEVELS = 10
#: Rows that one task orders: few for small tables, at most these for large ones.
LEAST_ROWS, MOST_ROWS = 20_000, 1_000_000


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, each with its length in bytes, so that no two rows give the same input."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda at, level: F.sha2(F.concat(level["left"], at, level["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


def _parts(rows: DataFrame, n: int) -> int:
    shuffle = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(shuffle, -(-n // LEAST_ROWS)), -(-n // MOST_ROWS))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join on columns whose nulls are equal; the right side's columns of these names go."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    on = F.lit(True)
    for c in columns:
        on &= left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, on).drop(*(f"_r_{c}" for c in columns))


def _numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows, stored already, with pos (from 0) in their group by the order, and n, the group's rows.

    Rows that are equal in all of these are dealt over ranges by their place in the input: any order of them gives the same tree.
    """
    parts = _parts(rows, rows.count())
    keys = [*group, *order, "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    stored = written(ranged.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "merkle-ranged")
    placed = stored.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_own"))  # as many as partitions and groups
    within = W.partitionBy(*group)
    before = F.sum("_own").over(within.orderBy("_part")) - F.col("_own") - F.col("_low")
    firsts = counts.select(*group, "_part", before.alias("_shift"), F.sum("_own").over(within).alias("n"))
    return _same(placed, firsts, [*group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _collapsed(leaves: Column, n: Column, arity: int) -> Column:
    """The levels of a block from its leaves to its root, as an array of arrays."""
    whole = F.least(n, F.lit(arity**LEVELS))
    steps = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.pow(F.lit(arity), i) < whole)
    runs = lambda nodes: F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    up = lambda nodes: F.transform(runs(nodes), lambda i: F.sha2(F.array_join(F.slice(nodes, i * arity + 1, arity), ""), 256))
    return F.aggregate(steps, F.array(leaves), lambda levels, _: F.concat(levels, F.array(up(F.element_at(levels, -1)))))


def _blocks(rows: DataFrame, group: Sequence[str], keep: Sequence[str], arity: int) -> DataFrame:
    """rows (group, pos, n, node and what is kept) as one row a block, stored: members in order, and levels."""
    size = arity**LEVELS
    blocked = rows.withColumn("block", F.floor(F.col("pos") / size)).repartition(_parts(rows, rows.count()), *group, "block")
    members = F.array_sort(F.collect_list(F.struct("pos", "node", *keep))) if not keep else F.array_sort(F.collect_list(F.struct("pos", "node", F.struct(*keep).alias("kept"))))
    found = blocked.groupBy(*group, "block").agg(F.max("n").alias("n"), members.alias("members"))  # pos differs, so nothing after it is compared
    return written(found.withColumn("levels", _collapsed(F.transform("members", lambda m: m["node"]), F.col("n"), arity)), "merkle-blocks")


def _root() -> Column:
    return F.element_at(F.element_at(F.col("levels"), -1), 1)


def _grown(rows: DataFrame, group: Sequence[str], keep: Sequence[str], arity: int) -> list[DataFrame]:
    """The block tables of all rounds, from the leaves to one block a group."""
    tables = [_blocks(rows, group, keep, arity)]
    size = arity**LEVELS
    most = tables[0].agg(F.max("n")).first()[0] or 0
    while most > size:
        up = tables[-1].select(*group, F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), _root().alias("node"))
        tables.append(_blocks(up, group, [], arity))
        most = -(-most // size)
    return tables


def _own_path(place: Column, arity: int) -> Column:
    """The siblings of the member at a place of its block, level by level up to the block's root."""

    def level(i: Column) -> Column:
        nodes, j = F.get(F.col("levels"), i), F.floor(place / F.pow(F.lit(arity), i)).cast("int")
        k = j % arity
        return F.struct(F.array_join(F.slice(nodes, j - k + 1, k), "").alias("left"), F.array_join(F.slice(nodes, j + 2, arity - 1 - k), "").alias("right"))

    below = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: i < F.size("levels") - 1)
    return F.transform(below, level)


def _proved(tables: list[DataFrame], above: DataFrame, group: Sequence[str], carried: Sequence[str], arity: int) -> DataFrame:
    """Members of the first table with the path to the root that ``above`` (group, path, carried columns) tells of."""
    at = above.withColumn("block", F.lit(0).cast("long"))
    for table in reversed(tables):
        joined = _same(table, at, [*group, "block"])
        own = F.transform("members", lambda m, i: F.struct(m.alias("member"), F.concat(_own_path(i, arity), F.col("path")).alias("path")))
        each = joined.select(*group, *carried, F.explode(own).alias("x"))
        found = each.select(*group, *carried, "x.member", "x.path")
        at = found.select(*group, *carried, F.col("member.pos").alias("block"), "path")
    return found


def manifest(rows: DataFrame, group: Sequence[str], order: Sequence[str], node: str = "leaf", keep: Sequence[str] = (), arity: int = ARITY) -> DataFrame:
    """One row a leaf of rows (group and order columns, a digest in ``node``): the kept columns, leaf, pos in its group,
    path (its siblings up to the root, each level as left and right of it), subroot (of the group) and root (of all)."""
    group, order = list(group), list(order)
    names = {c: f"k{i}" for i, c in enumerate(keep)}
    given = rows.select(
        *(F.col(c).alias(f"g{i}") for i, c in enumerate(group)), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)),
        F.col(node).alias("node"), *(F.col(c).alias(k) for c, k in names.items()),
    )
    own = [f"g{i}" for i in range(len(group))]
    numbered = _numbered(written(given, "merkle-leaves"), own, [*(f"o{i}" for i in range(len(order))), "node"])
    tables = _grown(numbered.select(*own, "pos", "n", "node", *names.values()), own, list(names.values()), arity)
    roots = written(tables[-1].select(F.lit(0).alias("all"), *own, _root().alias("node")), "merkle-roots")
    tops = _grown(_numbered(roots, ["all"], own).select("all", "pos", "n", "node", *own), ["all"], own, arity)
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    top = _proved(tops, tops[-1].select("all", no_path.alias("path"), _root().alias("root")), ["all"], ["root"], arity)
    above = top.select(*(F.col(f"member.kept.{g}").alias(g) for g in own), "path", "root", F.col("member.node").alias("subroot"))
    found = _proved(tables, written(above, "merkle-tops"), own, ["subroot", "root"], arity)
    kept = [F.col(f"member.kept.{k}").alias(c) for c, k in names.items()]
    return found.select(*kept, F.col("member.node").alias("leaf"), F.col("member.pos").alias("pos"), "path", "subroot", "root")


def document_leaf(more_chars: Column | None = None) -> Column:
    """The leaf of a row of documents; more_chars: how many characters it is said to have beyond n_chars."""
    count = F.col("n_chars").cast("decimal(38,0)")
    return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), count if more_chars is None else count + more_chars, F.col("text"))


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of documents, by language and id, and what it says of a copy of which every seventh checksum was tampered with.

    A row is tampered with where 7 divides the crc32 of its id: its n_chars is greater by 1 (nulls, of id too, stay).
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    shown = F.when(hit, document_leaf(F.lit(1).cast("decimal(38,0)"))).otherwise(F.col("leaf"))
    leaves = docs.withColumn("leaf", document_leaf()).withColumn("shown", shown).select("doc_id", "lang", "leaf", "shown")
    made = manifest(leaves, ["lang"], ["doc_id"], keep=["doc_id", "shown"])
    found = made.withColumn("folded_root", folded(F.col("shown"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def changed(before: DataFrame, after: DataFrame, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or altered between two manifests that keep group and key columns.

    Only groups whose subroots differ are compared row by row. Keys of a group must be distinct.
    """
    nothing = F.lit(None).cast("string")
    old = before.select(*group, *key, F.col("leaf").alias("old"), nothing.alias("new"), "subroot")
    rows = old.unionByName(after.select(*group, *key, nothing.alias("old"), F.col("leaf").alias("new"), "subroot"))
    roots = rows.groupBy(*group).agg(F.min("subroot").alias("a"), F.max("subroot").alias("b"), F.count("old").alias("n"), F.count("new").alias("m"))
    differ = _same(rows, roots.where("a <> b or n = 0 or m = 0").select(*group), group)
    both = differ.groupBy(*group, *key).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("altered")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*group, *key, state.alias("state"))


def brute_force(rows: list[tuple[str | None, object, str]], arity: int = ARITY) -> dict[tuple, tuple[str, str, str]]:
    """(group, order) to (subroot, root, all siblings as one text) of (group, order, leaf), level by level."""
    import hashlib

    def grown(nodes: list[str]) -> tuple[str, list[str]]:
        paths, owners = ["" for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            ups, groups = [], []
            for a in range(0, len(nodes), arity):
                run = nodes[a : a + arity]
                for k in range(len(run)):
                    for i in owners[a + k]:
                        paths[i] += "".join(run[:k] + run[k + 1 :])
                ups.append(hashlib.sha256("".join(run).encode()).hexdigest())
                groups.append([i for o in owners[a : a + arity] for i in o])
            nodes, owners = ups, groups
        return nodes[0], paths

    least = lambda x: (x is not None, x or 0)
    by: dict = {}
    for g, o, x in sorted(rows, key=lambda r: (least(r[1]), r[2])):
        by.setdefault(g, []).append((o, x))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: grown([x for _, x in by[g]]) for g in groups}
    root, tops = grown([subs[g][0] for g in groups]) if groups else ("", [])
    return {(g, o, x): (subs[g][0], root, own + top) for g, top in zip(groups, tops, strict=True) for (o, x), own in zip(by[g], subs[g][1], strict=True)}


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{}", "text")) + ")"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF.replace("{}", "n_chars")} AS leaf,
  CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, z: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 7 = 0
    THEN {_LEAF.replace("{}", "(n_chars + 1)")} ELSE {_LEAF.replace("{}", "n_chars")} END AS shown FROM documents),
leaves AS (SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
node AS (SELECT g, 0 AS lvl, pos, leaf AS h, n FROM leaves
  UNION ALL SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM node WHERE n > 1 GROUP BY g, lvl, pos // 2),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM subs
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY lvl, pos // 2),
own AS (SELECT x.g, x.pos, list((CASE WHEN (x.pos >> v.lvl) & 1 = 1 THEN 'L' ELSE 'R' END) || coalesce(s.h, '') ORDER BY v.lvl) AS path
  FROM leaves x JOIN (SELECT DISTINCT g, lvl FROM node WHERE n > 1) v ON v.g = x.g LEFT JOIN node s ON s.g = x.g AND s.lvl = v.lvl AND s.pos = xor(x.pos >> v.lvl, 1) GROUP BY x.g, x.pos),
high AS (SELECT x.g, list((CASE WHEN (x.pos >> v.lvl) & 1 = 1 THEN 'L' ELSE 'R' END) || coalesce(s.h, '') ORDER BY v.lvl) AS path
  FROM subs x JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) v ON true LEFT JOIN top s ON s.lvl = v.lvl AND s.pos = xor(x.pos >> v.lvl, 1) GROUP BY x.g),
proved AS (SELECT x.doc_id, x.leaf, x.shown, u.subroot, (SELECT h FROM top WHERE n = 1) AS root, list_concat(coalesce(o.path, []), coalesce(h.path, [])) AS path
  FROM leaves x JOIN subs u ON u.g = x.g LEFT JOIN own o ON o.g = x.g AND o.pos = x.pos LEFT JOIN high h ON h.g = x.g),
closed AS (SELECT *, list_reduce(list_prepend(shown, path), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM proved)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM closed
"""

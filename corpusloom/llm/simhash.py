"""Operator 6: near duplicates by SimHash and a binary trie self-join.

Fingerprints are the nodes at the bottom of a binary trie.  Pairs of nodes are walked down together, the differing bits
so far add up, and a pair is given up once they exceed the budget.  Two fingerprints within b bits agree on one of b + 1
blocks, so the trie is walked once for each block, with that block first: on its levels only a node and itself can be a
pair, which deals the work out by the block's value.  Node pairs that hold too many fingerprints are walked further by
Spark, some levels at a time, before a task takes them.  A task emits a spanning forest of the links that it finds, so
output grows with the fingerprints and no component is lost; components then come from repeated joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, saved

#: Differing bits allowed, words of a shingle, seed of the hash.
BUDGET, SHINGLE, SEED = 2, 3, 42
#: Keys whose rows are not dealt out by key are fewer than this, and have so many rows at least.
HOT_KEYS, HOT_ROWS = 1000, 50
#: Fingerprints that one task may hold of a node pair, and levels that Spark walks at a time beyond that.
MOST, LEVELS = 4096, 8
_NONE = (1 << 63) - 1


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text; 0 without words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = len(words) - SHINGLE + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, row, fp): one row per row, fp as a signed long; row is the named column, or 0."""

    def rows(columns):
        for k, n, t in zip(*columns, strict=True):
            yield k, n, _signed(fingerprint(t))

    number = F.col(row) if row else F.lit(0)
    return map_batches(docs.select(F.col(key).cast("long"), number.cast("long").alias("row"), F.col(text)), rows, "doc_id long, row long, fp long")


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``table``, which has each key once, with rows of frequent keys left where they are.

    Keys of more than 1 / HOT_KEYS of the rows, and HOT_ROWS at least, are fewer than HOT_KEYS: their part of the table is
    broadcast, and only the rows of all other keys are dealt out by key.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = saved(counts.where(F.col("n") > max(HOT_ROWS, total / HOT_KEYS)).select(key))
    if hot.isEmpty():
        return rows.join(table, key)
    few = saved(table.join(F.broadcast(hot), key, "left_semi"))
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(table, key)
    return rest.unionByName(rows.join(F.broadcast(few), key).select(*rest.columns))


def block_bits(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, bits) of each of budget + 1 blocks."""
    edges = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def trie_pairs(
    values: np.ndarray, starts: np.ndarray, cross: np.ndarray, depth: int, differ: np.ndarray, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walks node pairs from ``depth`` to the bottom.

    ``values`` are uint64 and sorted inside each node.  Node pair g is (starts[g], starts[g + 1]) with itself, or, where
    cross[g] >= 0, its two parts before and from that position.  Gives index arrays of linked leaves.
    """
    self_lo, self_hi, self_d = starts[:-1][cross < 0], starts[1:][cross < 0], differ[cross < 0]
    c = cross >= 0
    alo, ahi, blo, bhi, d = starts[:-1][c], cross[c], cross[c], starts[1:][c], differ[c]
    for level in range(depth, 64):
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - level)) & np.uint64(1), dtype=np.int64)])
        mid = lambda lo, hi: hi - (ones[hi] - ones[lo])
        keep = self_hi - self_lo > 1
        self_lo, self_hi, self_d = self_lo[keep], self_hi[keep], self_d[keep]
        if not len(self_lo) and not len(alo):
            return
        m, am, bm = mid(self_lo, self_hi), mid(alo, ahi), mid(blo, bhi)
        alo, ahi, blo, bhi, d = (
            np.concatenate(x)
            for x in (
                (alo, am, alo, am, self_lo),
                (am, ahi, am, ahi, m),
                (blo, bm, bm, blo, m),
                (bm, bhi, bhi, bm, self_hi),
                (d, d, d + 1, d + 1, self_d + 1),
            )
        )
        keep = (ahi > alo) & (bhi > blo) & (d <= budget)
        alo, ahi, blo, bhi, d = alo[keep], ahi[keep], blo[keep], bhi[keep], d[keep]
        self_lo, self_hi, self_d = np.concatenate([self_lo, m]), np.concatenate([m, self_hi]), np.concatenate([self_d, self_d])
    yield alo, blo


def _forest(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """The pairs that join two parts not joined before."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for x, y in zip(a, b, strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            yield x, y


def _links(groups: DataFrame, budget: int) -> DataFrame:
    """(a, b) links inside node pairs: rows of (turn, depth, differ, sides, left, right)."""

    def rows(columns):
        turn, depth, differ, left, right = columns
        by_depth: dict[int, list[int]] = {}
        for k, x in enumerate(depth):
            by_depth.setdefault(x, []).append(k)
        for at, ks in by_depth.items():
            parts, starts, cross, turns = [], [0], [], []
            for k in ks:
                t = np.uint64(turn[k])
                sides = []
                for side in (left[k], right[k]):
                    v = np.array(side, dtype=np.int64).view(np.uint64)
                    v = (v << t) | (v >> (np.uint64(64) - t)) if turn[k] else v
                    sides.append(np.sort(v))
                parts += sides
                cross.append(starts[-1] + len(sides[0]) if len(sides[1]) else -1)
                starts.append(starts[-1] + len(sides[0]) + len(sides[1]))
                turns.append(turn[k])
            values = np.concatenate(parts)
            marks = np.array(starts, dtype=np.int64)
            back = np.repeat(np.array(turns, dtype=np.uint64), np.diff(marks))
            plain = np.where(back > 0, (values >> back) | (values << ((np.uint64(64) - back) & np.uint64(63))), values).view(np.int64)
            walk = trie_pairs(values, marks, np.array(cross, dtype=np.int64), at, np.array([differ[k] for k in ks], dtype=np.int64), budget)
            for a, b in walk:
                yield from _forest(plain[a].tolist(), plain[b].tolist())

    return map_batches(groups.select("turn", "depth", "differ", "left", "right"), rows, "a long, b long")


def links(prints: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (column fp) to join all that are within the budget."""
    turns = F.explode(
        F.array(*[
            F.struct(
                F.lit(first).alias("turn"),
                F.lit(bits).alias("depth"),
                F.shiftrightunsigned(F.shiftleft("fp", first), 64 - bits).cast("string").alias("path"),
            )
            for first, bits in block_bits(budget)
        ])
    )
    nodes = prints.select("fp", turns.alias("t")).select(
        "fp", "t.turn", "t.depth", F.concat_ws(":", "t.turn", "t.path").alias("path"), F.lit(0).alias("differ"), F.lit(0).alias("side"), F.lit(False).alias("two")
    )
    near = [w for w in range(1 << LEVELS) if w.bit_count() <= budget]
    found = None
    while True:
        sizes = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        hot = saved(sizes.where(F.col("n") > most).select("path"))
        n_hot = hot.count()
        small = hot if n_hot > 10_000 else F.broadcast(hot)
        cold = nodes.join(small, "path", "left_anti") if n_hot else nodes
        groups = cold.groupBy("path").agg(
            F.first("turn").alias("turn"), F.first("depth").alias("depth"), F.first("differ").alias("differ"), F.first("two").alias("two"),
            F.collect_list(F.when(F.col("side") == 0, F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("side") == 1, F.col("fp"))).alias("right"),
        ).where("(two and size(left) > 0 and size(right) > 0) or (not two and size(left) > 1)")
        part = _links(groups, budget)
        found = part if found is None else found.unionByName(part)
        if not n_hot:
            return found
        # node pairs that are too large go down some levels: each fingerprint joins the pairs that its next bits allow
        step = nodes.join(small, "path", "left_semi")
        step = step.withColumn("rolled", F.expr("shiftleft(fp, turn) | shiftrightunsigned(shiftrightunsigned(fp, 63 - turn), 1)"))
        step = step.withColumn("own", F.expr(f"shiftrightunsigned(shiftleft(rolled, depth), {64 - LEVELS})"))
        step = step.withColumn("other", F.explode(F.array(*[F.lit(w).cast("long") for w in near]))).withColumn("other", F.col("own").bitwiseXOR(F.col("other")))
        step = step.withColumn("differ", F.col("differ") + F.bit_count(F.col("own").bitwiseXOR(F.col("other")))).where(F.col("differ") <= budget)
        first = F.when(F.col("two"), F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).otherwise(F.least("own", "other"))
        second = F.when(F.col("two"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))).otherwise(F.greatest("own", "other"))
        step = step.withColumn("x", first).withColumn("y", second)
        nodes = saved(
            step.select(
                "fp", "turn", (F.col("depth") + LEVELS).alias("depth"), F.concat_ws(".", "path", F.concat_ws("-", "x", "y")).alias("path"), "differ",
                F.when(F.col("two"), F.col("side")).when(F.col("own") == F.col("x"), 0).otherwise(1).alias("side"),
                (F.col("two") | (F.col("x") != F.col("y"))).alias("two"),
            )
        )


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, label): the least (doc, fp) of each vertex's component, for vertices that have an edge.

    ``vertices`` has fp and doc.  Labels spread along edges and then jump to their label's label, so the rounds grow
    with the logarithm of a chain's length.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    own = both.select(F.col("a").alias("fp")).distinct().join(vertices, "fp")
    labels = saved(own.select("fp", F.struct("doc", "fp").alias("label")))
    while True:
        heard = looked_up(both, labels.withColumnRenamed("fp", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        spread = labels.join(heard.withColumnRenamed("a", "fp"), "fp").select("fp", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        spread = saved(spread)
        if spread.where("old != label").isEmpty():
            return labels
        jump = spread.select(F.col("fp").alias("at"), F.col("label").alias("next"))
        here = spread.select("fp", "label", F.col("label.fp").alias("at"))
        labels = saved(looked_up(here, jump, "at").select("fp", F.least("label", "next").alias("label")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least id of the component).

    Null, empty and blank texts have fingerprint zero and are linked like any other.  Rows without an id take part; they
    never name a component, and one without any id has a null component_id.  Repeated rows stay.
    """
    prints = saved(fingerprints(docs, key, text).select("doc_id", "fp"))
    named = saved(_named(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(_NONE))).alias("doc")), budget, most))
    return looked_up(prints, named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc") != _NONE, F.col("doc")).alias("component_id"),
    )


def _named(vertices: DataFrame, budget: int, most: int) -> DataFrame:
    """(fp, doc): each fingerprint with the least ``doc`` of its component."""
    vertices = saved(vertices)
    edges = saved(links(vertices.select("fp"), budget, most))
    if edges.isEmpty():
        return vertices
    labels = components(vertices, edges).select("fp", F.col("label.doc").alias("least"))
    return vertices.join(labels, "fp", "left").select("fp", F.coalesce("least", "doc").alias("doc"))


def one_of_each(docs: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """``docs`` with one row of each component: that of the least id (nulls last), and of rows with that id one.

    Rows are numbered in a table that is written once, and judged by number, so rows of one id with different texts, rows
    without an id and repeated rows are like any other.  Columns and their names stay as they are; an empty table stays empty.
    """
    # columns go by number meanwhile, so that no name can clash
    columns = [f"c{k}" for k in range(len(docs.columns))]
    numbered = saved(docs.toDF(*columns).withColumn("loom_row", F.monotonically_increasing_id()))
    key, text = (columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    prints = fingerprints(numbered, key, text, "loom_row")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(_NONE)).alias("doc_id"), "row"))
    kept = _named(prints.groupBy("fp").agg(first.alias("doc")), budget, most).select(F.col("doc.row").alias("loom_row")).distinct()
    return numbered.join(kept, "loom_row", "left_semi").select(*columns).toDF(*docs.columns)

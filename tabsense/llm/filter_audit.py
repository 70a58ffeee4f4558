"""Filter interaction audit by count-weighted decision diagrams.

Every document becomes a mask of the filters it fails; masks are counted per part with combined aggregates, and each
part's counts become one small reduced decision diagram: a level a filter, leaves that hold the counts, a node that
knows the sum below it, equal nodes shared.  Swapping two neighbouring levels touches only their nodes; a sequence of
such swaps visits every order of the filters, and in each order the path on which every filter so far passes gives the
steps: the counts kept, and the counts of the branch that leaves the path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import ship_package, stored

Counts = tuple[int, ...]


class Diagram:
    """A reduced diagram over ``len(order)`` filters; a node is (passing child, failing child, sums below)."""

    def __init__(self, filters: int, leaves: dict[int, Counts], width: int):
        """``leaves``: counts by mask (bit f set: filter f fails); absent masks count nothing."""
        self.order = list(range(filters))
        self._shared: dict[tuple, tuple] = {}
        self._zero = (0,) * width
        self.root = self._build(0, 0, leaves)

    def _build(self, level: int, mask: int, leaves: dict[int, Counts]) -> tuple:
        if level == len(self.order):
            return self._node(None, None, leaves.get(mask, self._zero))
        return self._node(self._build(level + 1, mask, leaves), self._build(level + 1, mask | 1 << level, leaves))

    def _node(self, low: tuple | None, high: tuple | None, counts: Counts | None = None) -> tuple:
        """The one node with these children (or this leaf)."""
        key = (id(low), id(high)) if counts is None else counts
        if key not in self._shared:
            self._shared[key] = (low, high, counts if counts is not None else tuple(a + b for a, b in zip(low[2], high[2])))
        return self._shared[key]

    def swap(self, level: int) -> None:
        """Exchange a level with the next one."""
        done: dict[int, tuple] = {}

        def moved(node: tuple, depth: int) -> tuple:
            if id(node) not in done:
                low, high, _ = node
                done[id(node)] = (self._node(moved(low, depth - 1), moved(high, depth - 1)) if depth else
                                  self._node(self._node(low[0], high[0]), self._node(low[1], high[1])))
            return done[id(node)]

        self.root = moved(self.root, level)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> list[tuple[int, Counts, Counts]]:
        """(filter, counts kept after it, counts removed by it) along the path on which all pass."""
        out, node = [], self.root
        for f in self.order:
            low, high, _ = node
            out.append((f, low[2], high[2]))
            node = low
        return out

    def failing(self, f: int) -> Counts:
        """Counts that fail a filter, whatever the others say."""
        level, nodes = self.order.index(f), [self.root]
        for _ in range(level):
            nodes = [child for node in nodes for child in node[:2]]
        return tuple(map(sum, zip(*[node[1][2] for node in nodes])))

    def only(self, f: int) -> Counts:
        """Counts that fail a filter and no other."""
        node = self.root
        for g in self.order:
            node = node[1 if g == f else 0]
        return node[2]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, so that all orders of ``n`` filters are met once: the largest filter runs to
    and fro through every order of the others."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + (1 if down else 0)  # the largest stands at the front after running down
        down = not down


def steps(filters: str, leaves: dict[int, Counts], width: int) -> Iterator[tuple]:
    """Rows (order, step, kept, removed, redundant, only, shapley) with counts each, but shapley, a whole number."""
    diagram, found = Diagram(len(filters), leaves, width), []
    fails, alone = [diagram.failing(f) for f in range(len(filters))], [diagram.only(f) for f in range(len(filters))]
    shapley = [0] * len(filters)
    for swap in [None, *adjacent_swaps(len(filters))]:
        if swap is not None:
            diagram.swap(swap)
        name = "".join(filters[f] for f in diagram.order)
        for step, (f, kept, removed) in enumerate(diagram.path(), 1):
            shapley[f] += removed[0]
            found.append((name, step, f, kept, removed))
    for name, step, f, kept, removed in found:
        yield name, step, kept, removed, tuple(a - b for a, b in zip(fails[f], removed)), alone[f], shapley[f]


def audit(masks: DataFrame, filters: str) -> DataFrame:
    """Steps of every order of ``filters`` in every part.

    ``masks``: rows (part, mask, n, good, toxic), any number a mask; bit f of ``mask`` is set where filter f fails.
    Result: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; all zeros
    included.  A part is at most 2^filters rows after a combined aggregate, and only that goes to one task.
    """
    ship_package(masks.sparkSession)
    cells = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        leaves = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in frame.itertuples()}
        part = frame["part"].iloc[0]
        return pd.DataFrame([(part, name, step, kept[0], gone[0], redundant[0], alone[0], gone[1], gone[2], shapley)
                             for name, step, kept, gone, redundant, alone, shapley in steps(filters, leaves, 3)],
                            columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    return cells.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                                    "unique_fails long, good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at a text only, by letter: conditions of failure."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    count = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": count < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * count, "C": 100 * capitals > 3 * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def document_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Rows (part, mask, n, good, toxic) of filters A to D on the text and E: an equal text has a smaller key.

    A null text is empty, a null part the empty string; a null key is neither smaller nor larger than any and has no
    label.  Keys may repeat: each row counts, rows of the smallest key all pass E.  Of several labels of a key the
    highest counts.  Texts are compared by SHA-256; copies are combined before they meet, so no join on texts is
    needed: of the rows with one text all but those of the smallest key fail E.  Empty tables give no rows.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(body).values())]
    rows = stored(docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                              F.unhex(F.sha2(body, 256)).alias("digest"), sum(bits[1:], bits[0]).cast("int").alias("mask")), "filter-masks")
    known = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(
        (F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    unknown = F.lit(None).cast("boolean")
    labelled = (rows.where("key IS NOT NULL").join(known, "key", "left")
                .unionByName(rows.where("key IS NULL").select("*", unknown.alias("good"), unknown.alias("toxic"))))
    kind = ["digest", "mask", "part", "good", "toxic"]
    one_key = labelled.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).groupBy(*kind, "key").agg(F.count(F.lit(1)).alias("n"))
    # rows of one text, part and label: their number, how many have no key, and the smallest key with its number
    kinds = one_key.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("free"),
                                       F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("least"))
    smallest = kinds.groupBy("digest").agg(F.min("least.key").alias("smallest"))
    first = F.col("free") + F.when(F.col("least.key") == F.col("smallest"), F.col("least.n")).otherwise(0)
    both = kinds.join(smallest, "digest").select("mask", "part", "good", "toxic", first.alias("first"), (F.col("n") - first).alias("again"))
    split = both.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("first").alias("n")),
                                                                   F.struct((F.col("mask") + (1 << len(bits))).alias("mask"), F.col("again").alias("n")))).alias("s"))
    counted = split.select("part", "s.mask", "s.n", F.when(F.col("good"), F.col("s.n")).otherwise(0).alias("good"),
                           F.when(F.col("toxic"), F.col("s.n")).otherwise(0).alias("toxic"))
    return counted

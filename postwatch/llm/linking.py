"""From buckets of similar texts to groups: candidate components, verified links, components of the links.

Texts that share a bucket are candidates. They are joined to their bucket's least member, which keeps the table linear in
the buckets and connects the same texts as all pairs would; the components of that table hold every pair of candidates. The
texts of a component go to one task, which compares each text with the ones it shares a bucket with until all that are
alike are connected: once two texts are in one group, no further pair between their groups is looked at. An operator may
give each text keys of which two that are alike share one at least; where that leaves fewer pairs, a text is compared with
those that share a key as well as a bucket.

A component of more than ``group_bytes`` of text does not go to one task. It is dealt into parts; their groups are found,
then those of the parts' first members, and in the end every text outside the component's largest group is compared with
all the texts of the component, part by part. So no link is lost, whatever the size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postwatch.llm import anchors, common

GROUP_BYTES = 16 << 20
_LINKS = "a long, b long"


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root: the least node that each node of the edges (a, b) is connected with; alternating stars until nothing moves."""
    spark = edges.sparkSession
    now = common.staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    mark = None
    while True:
        both = now.unionAll(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        before, now = now, common.staged(moved.unionAll(small.select("a", F.col("m").alias("b"))).distinct(), name)
        common.discard(before)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def stars(bands: DataFrame) -> DataFrame:
    """Edges (a, b) between each member x of a bucket and the bucket's least member; ``bands``: x, band."""
    heads = bands.groupBy("band").agg(F.min("x").alias("b"), F.max("x").alias("top")).where("b <> top").drop("top")
    return bands.join(heads, "band").where("x <> b").select(F.col("x").alias("a"), "b").distinct()


class _Groups:
    """Union by least member over the texts of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


class _Shelf:
    """Places of members by the values that they list, for each value by group."""

    def __init__(self, groups: _Groups):
        self.groups = groups
        self.held: dict[int, dict[int, list[int]]] = {}
        self.sizes: dict[int, int] = {}

    def size(self, listed: list[int]) -> int:
        return sum(self.sizes.get(value, 0) for value in listed)

    def others(self, k: int, value: int) -> Iterator[list[int]]:
        """The members of each group but that of k that list the value."""
        by_root = self.held.get(value, {})
        for root in list(by_root):
            if (now := self.groups.root(root)) != root:  # groups that have become one since
                by_root.setdefault(now, []).extend(by_root.pop(root))
        for root in list(by_root):
            if self.groups.root(root) != self.groups.root(k):
                yield by_root[root]

    def put(self, k: int, listed: list[int]) -> None:
        root = self.groups.root(k)
        for value in listed:
            self.held.setdefault(value, {}).setdefault(root, []).append(k)
            self.sizes[value] = self.sizes.get(value, 0) + 1


_DEARER = 8  # a comparison of two texts, counted in looks at a pair


def linked(
    members: list[tuple[int, int, list[int]]], alike: Callable[[int, int], bool], keys: list[list[int]] | None = None
) -> Iterator[tuple[int, int]]:
    """Links (x, x) that connect all members that are alike and share a bucket; members: x, the group it is known to be in, its bands.

    ``keys``, if given: for each member values of which two that are alike share one at least.
    """
    groups = _Groups()
    for k, (_, root, _) in enumerate(members):
        groups.up[k] = k
    first: dict[int, int] = {}
    for k, (_, root, _) in enumerate(members):
        groups.join(k, first.setdefault(root, k))
    by_band, by_key = _Shelf(groups), _Shelf(groups)
    for k, (x, _, bands) in enumerate(members):
        few = keys is not None and by_key.size(keys[k]) < _DEARER * by_band.size(bands)
        shelf, listed = (by_key, keys[k]) if few else (by_band, bands)
        own, failed = set(bands), set()
        for value in listed:
            for held in shelf.others(k, value):
                for other in held:
                    if other in failed:
                        continue
                    if (not few or not own.isdisjoint(members[other][2])) and alike(k, other):
                        yield x, members[other][0]
                        groups.join(k, other)
                        break
                    failed.add(other)
        by_band.put(k, bands)
        if keys is not None:
            by_key.put(k, keys[k])


def _task(bands_of, measure):
    """Rows sorted by group to links; ``bands_of`` gives each text's bands, ``measure`` the likeness test of a group's texts and their keys."""

    def links(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        rows = list({x: (x, root, text) for x, root, text in sorted(rows)}.values())
        texts = [text for _, _, text in rows]
        pairs = list(linked([(x, root, bands) for (x, root, _), bands in zip(rows, bands_of(texts))], *measure(texts)))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for comp, part, x, root, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (comp, part) != last and held:
                    yield links(held)
                    held = []
                last = (comp, part)
                held.append((x, root, text))
        if held:
            yield links(held)

    return run


def groups(
    texts_of: Callable[[DataFrame], DataFrame], bands: DataFrame, bands_of, measure, name: str, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """x, root of every text that is alike to another one.

    ``texts_of`` adds the text to rows of x; bands: x, band; ``bands_of(texts)`` and ``measure(texts)`` run in the tasks: the bands of
    each text; a function that tells whether two of the texts (by their places) are alike, and their keys or None (:func:`linked`).
    """
    candidates = components(stars(bands), name)
    rows = common.staged(texts_of(candidates.select(F.col("node").alias("x"), F.col("root").alias("comp"))).select("comp", "x", "text"), name)
    sizes = rows.groupBy("comp").agg(F.sum(F.octet_length("text") + 64).alias("size"))
    large = common.staged(
        sizes.where(F.col("size") > group_bytes).select("comp", F.ceil(F.col("size") / group_bytes).cast("int").alias("parts")), name
    )

    def link(frame: DataFrame) -> DataFrame:
        dealt = frame.select("comp", "part", "x", "root", "text").repartition("comp", "part").sortWithinPartitions("comp", "part")
        return dealt.mapInArrow(_task(bands_of, measure), _LINKS)

    part = F.coalesce(F.pmod(F.xxhash64("x"), F.col("parts")), F.lit(0)).cast("long")
    whole = rows.join(large, "comp", "left").withColumn("part", part).withColumn("root", F.col("x"))
    links = common.staged(link(whole), name)
    if not large.isEmpty():
        inside = rows.join(large, "comp")

        def rooted() -> DataFrame:
            known = components(links, name).withColumnRenamed("node", "x")
            return inside.join(known, "x", "left").withColumn("root", F.coalesce("root", "x"))

        # first members of the groups, fewer and fewer to a part until one part holds them
        before = None
        while True:
            heads = rooted().where("x = root")
            shares = heads.groupBy("comp").agg(F.sum(F.octet_length("text") + 64).alias("size"), F.count("*").alias("n"))
            left = shares.agg(F.sum("n"), F.max("size")).first()
            if left[0] == before:
                break
            before = left[0]
            again = heads.join(shares.select("comp", F.ceil(F.col("size") / group_bytes).alias("k")), "comp")
            found = link(again.withColumn("part", F.pmod(F.xxhash64("x", F.lit(before)), F.col("k"))))
            links = common.staged(links.unionAll(found), name)
            if left[1] <= group_bytes:
                break
        # texts outside the largest group of a component against all of it
        everyone = common.staged(rooted(), name)
        counted = everyone.groupBy("comp", "root").agg(F.count("*").alias("n"))
        most = counted.groupBy("comp").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
        others = everyone.join(most, "comp").where("root <> most").drop("most")
        shares = others.groupBy("comp").agg(F.ceil(F.sum(F.octet_length("text") + 64) / group_bytes).cast("int").alias("queries"))
        asked = others.join(shares, "comp").withColumn("query", F.pmod(F.xxhash64("x"), F.col("queries")))
        cells = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        against = everyone.join(shares, "comp").withColumn("query", F.explode(F.sequence(F.lit(0), F.col("queries") - 1)))
        against = against.withColumn("cell", F.pmod(F.xxhash64("x"), F.col("parts")))
        columns = ["comp", (F.col("query") * F.col("parts") + F.col("cell")).cast("long").alias("part"), "x", "root", "text"]
        links = common.staged(links.unionAll(link(cells.select(*columns).unionAll(against.select(*columns)))), name)
    found = components(links, name).withColumnRenamed("node", "x")
    return common.staged(found, name)


def classes(docs: DataFrame, summary: DataFrame, bands_of, measure, name: str, group_bytes: int = GROUP_BYTES, carrying=None) -> DataFrame:
    """Per row of ``docs`` (:func:`anchors.keyed`): id, x, class_id (the least id of its group), kept: the row's text is the one that stays.

    ``summary``: id, x, cls, bands of each row. Copies of a text are one member. ``carrying``, if given, changes the text of rows of id,
    x, text to what ``bands_of`` and ``measure`` are to get.
    """
    firsts = common.staged(summary.groupBy("cls").agg(F.min("id").alias("id"), F.min("x").alias("x")), name)
    own = summary.join(firsts.select("id", "x"), ["id", "x"], "left_semi").dropDuplicates(["x"])
    # texts are joined by a shuffle at every size: which side is small is not known beforehand
    texts_of = lambda rows: docs.drop("cls").join(rows.join(firsts.select("id", "x"), "x").hint("merge"), ["id", "x"])
    bodies_of = (lambda rows: carrying(texts_of(rows))) if carrying else texts_of
    found = groups(bodies_of, own.select("x", F.explode("bands").alias("band")), bands_of, measure, name, group_bytes)
    rooted = firsts.join(found, "x", "left").select("x", "id", F.coalesce("root", "x").alias("root"))
    stays = rooted.groupBy("root").agg(F.min(F.struct("id", "x")).alias("first"))
    members = rooted.join(stays, "root").select("x", F.col("first.id").alias("class_id"), F.col("first.x").alias("first_x"))
    kept = ((F.col("id") == F.col("class_id")) & (F.col("x") == F.col("first_x"))).alias("kept")
    return summary.select("id", "x").join(members, "x").select("id", "x", "class_id", kept)


def public(found: DataFrame) -> DataFrame:
    """doc_id, class_id, kept of the rows of :func:`classes`."""
    return found.select(anchors.public_id(), F.nullif(F.col("class_id"), F.lit(anchors.NO_ID)).alias("class_id"), "kept")

"""MinHash near-duplicate detection by a signature-coordinate inverted join.

A document's set holds its distinct shingles of consecutive words. Documents with equal sets form a
class. Each class has a MinHash signature and is posted under each of its (coordinate, value) pairs:
links are classes that collide in at least `matches` of the lists. These collisions are counted with

* prefix merging: of a class's lists that hold another class too, shortest first, all but the last
  matches - 1 are merged; two classes that collide often enough meet in one of these. A class that
  has fewer than `matches` such lists has no link. What many documents share lies in long lists, which
  come last and so are merged only for classes that have little else.
* skip merging: the lists that aren't merged are skipped; for a pair that met, their collisions are
  counted by looking up the one's values in the other's signature. A pair counts in the first list
  that both merge. Lists whose classes are by now in one component are skipped as well: first, in each
  list, all classes are compared with the one that shares most (the star pass), which joins most copies.

Lists that then still hold several components are merged in blocks: the classes of a list's largest
component meet those of the others, not each other. Where more than a block are outside the largest
component, the list's classes are first posted once more, under the necessary prefix of their shingles,
rarest first (an exact filter that needs no luck), which parts all but those that are nearly alike. Pairs with enough collisions are confirmed on
the full sets, in their block, where only links that join components come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.words import mix, shingle_set, slices
from strataforge.operators.bitmap import may_be_in
from strataforge.operators.components import components
from strataforge.storage import drop_kept, keep

COORDINATES = 64
#: Standard deviations below the mean number of matches at the threshold: about 1 link in 50,000 at the very threshold is missed, far fewer above it.
SIGMAS = 4.4
#: Classes of a list that is merged in one task; longer lists are split.
BLOCK = 1024
_SEEDS = np.random.default_rng(7).integers(1, 2**63, (2, COORDINATES), dtype=np.uint64)
_XOR, _ODD = _SEEDS[0], _SEEDS[1] | np.uint64(1)
_PRINTS = ("n_shingles", "print_a", "print_b")


def least_matches(percent: int) -> int:
    """The collisions that a link has for certain, but for SIGMAS."""
    p = percent / 100
    return max(1, math.floor(COORDINATES * p - SIGMAS * math.sqrt(COORDINATES * p * (1 - p))))


def recall(percent: int, similarity: float) -> float:
    """The share of links of a similarity that have enough collisions to be found by their own signatures."""
    least = least_matches(percent)
    return sum(math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(least, COORDINATES + 1))


def signature(shingle: np.ndarray) -> np.ndarray:
    """The high 32 bits of the least value under each of the hash functions, of a set that is not empty."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingle), 2048):
        np.minimum(least, ((shingle[k : k + 2048, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _prints(found: np.ndarray) -> tuple[int, int, int]:
    """A set's size and two hashes of it."""
    return len(found), int(found.sum(dtype=np.uint64)), int(mix(found + np.uint64(1)).sum(dtype=np.uint64))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(3), lower=True):
                prints, signs = [], []
                for a, b in zip(part.first[:-1], part.first[1:]):
                    found = shingle_set(part.hash[a:b], width)
                    prints.append(_prints(found))
                    signs.append(signature(found) if len(found) else None)
                same = [batch.column(k).slice(part.rows.start, len(part.rows)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*same, *(_signed([p[k] for p in prints]) for k in range(3)), pa.array(signs, pa.list_(pa.int32()))], names=["doc_id", "key", "print", *_PRINTS, "signature"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0), lower=True):
                found = [shingle_set(part.hash[a:b], width) for a, b in zip(part.first[:-1], part.first[1:])]
                prints = [_prints(x) for x in found]
                yield pa.RecordBatch.from_arrays([*(_signed([p[k] for p in prints]) for k in range(3)), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=[*_PRINTS, "shingles"])

    return run


def _set_of(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy().view(np.uint64)


def _linked_sets(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(one, two, assume_unique=True).size
    return 100 * both >= percent * (len(one) + len(two) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [_linked_sets(_set_of(x), _set_of(y), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hits, pa.bool_()))

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups (key, i, j) of rows that are sorted by them, wherever batches end."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        ids = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
        limits = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1)]
        for low, high in zip(limits[:-1], limits[1:]):
            yield table.slice(low, high - low)
        rest = table.slice(limits[-1])
    if rest is not None:
        yield rest


def _earlier(merged: pa.ChunkedArray, key: int) -> np.ndarray:
    """For each row's lists (in the order in which all rows have them) which of those before key it has; lists that only one row has are left out."""
    lists = merged.combine_chunks()
    values, start = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    row = np.repeat(np.arange(len(lists)), np.diff(start))
    place = np.arange(len(values)) - start[row]
    at = np.full(len(lists), np.iinfo(np.int64).max)
    at[row[values == key]] = place[values == key]
    first = place < at[row]
    keys, which, counts = np.unique(values[first], return_inverse=True, return_counts=True)
    out = np.zeros((len(lists), len(keys)), dtype=bool)
    out[row[first], which] = True
    return out[:, counts > 1]


def _alike(percent: int, matches: int):
    """For each group of classes: those that collide with classes of other components often enough, and with which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            if table.num_rows < 2:
                continue
            key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
            sign = table.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            node, label, n, block = (table.column(c).to_numpy() for c in ("node", "label", "n", "block"))
            before = _earlier(table.column("merged"), key)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if i == j:
                # pairs inside the largest component need no look: its classes come last and only meet those before them
                names, counts = np.unique(label, return_counts=True)
                main = label == names[counts.argmax()]
                left = right = np.r_[np.flatnonzero(~main), np.flatnonzero(main)]
                looked = int((~main).sum())
            else:
                left, right = sorted((left, right), key=len)
                looked = len(left)
            found: dict[int, list[int]] = {}
            for place, a in enumerate(left[:looked]):
                other = right[place + 1 :] if i == j else right
                other = other[(label[other] != label[a]) & (100 * np.minimum(n[other], n[a]) >= percent * np.maximum(n[other], n[a]))]
                # a pair that also meets in a list before this one counts there
                shared = np.flatnonzero(before[a])
                other = other[~before[np.ix_(other, shared)].any(axis=1)] if len(shared) else other
                for b in other[(sign[other] == sign[a]).sum(axis=1) >= matches]:
                    found.setdefault(int(a), []).append(int(node[b]))
                    found.setdefault(int(b), [])
            if found:
                rows, same = list(found), [pa.array([x] * len(found), pa.int64()) for x in (key, i, j)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(node[rows]), pa.array(label[rows]), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["key", "i", "j", "node", "label", "partners"])

    return run


def _joining(percent: int):
    """Of groups of classes with their sets: links that join different components, no more than join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            node, partners = table.column("node").to_pylist(), table.column("partners").to_pylist()
            label = dict(zip(node, table.column("label").to_pylist()))
            sets = dict(zip(node, map(_set_of, table.column("shingles"))))
            root = {x: x for x in label.values()}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            links = []
            for a, others in zip(node, partners):
                for b in others:
                    one, two = find(label[a]), find(label[b])
                    if one != two and _linked_sets(sets[a], sets[b], percent):
                        root[one] = two
                        links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _prefixes(postings: DataFrame, least: Column) -> DataFrame:
    """(node, merged, weight): of each node's lists with other nodes, shortest first, all but least - 1, and their sizes' sum; nodes with fewer than least are left out.

    postings: node, key, n. A node's lists, a row each, are no more than its coordinates or shingles.
    """
    # written first: the join then has two plain exchanges below it, and Spark can split a very common list
    shared = keep(postings.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    held = postings.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("size", "key"))).alias("lists"), F.first("n").alias("n"))
    few = held.filter(F.size("lists") >= least).select("node", F.slice("lists", F.lit(1), F.size("lists") - least + 1).alias("first"))
    out = keep(few.select("node", F.col("first")["key"].alias("merged"), F.aggregate("first", F.lit(0).cast("long"), lambda total, x: total + x["size"]).alias("weight")), "merged")
    drop_kept(shared)
    return out


class _Merge:
    """The links found so far between some nodes (node, n, signature, key), and how more are found."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, width: int, percent: int):
        self.nodes, self.texts, self.width, self.percent, self.matches = nodes, texts, width, percent, least_matches(percent)
        self.labels: DataFrame | None = None

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in wanted (node)."""
        names = keep(self.nodes.select("node", "key").join(wanted.select("node").distinct(), "node", "left_semi").select("key"), "names")
        few = self.texts.filter(may_be_in(names, "key")).join(names, "key", "left_semi")
        found = few.select("text").mapInArrow(_sets(self.width), "n_shingles long, print_a long, print_b long, shingles array<long>")
        out = keep(found.select(F.xxhash64(*_PRINTS).alias("node"), "shingles").dropDuplicates(["node"]), "sets")
        drop_kept(names)
        return out

    def add(self, links: DataFrame) -> None:
        """Labels with these links too; of the labels so far only those that the new links join are gone through again."""
        if self.labels is None:
            self.labels = components(links)
            return
        was, label = self.labels, lambda name, x: self.labels.select(F.col("node").alias(name), F.col("component").alias(x))
        named = links.join(label("a", "x"), "a", "left").join(label("b", "y"), "b", "left")
        joined = keep(components(named.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))).withColumnRenamed("component", "to"), "joined")
        moved = was.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        fresh = joined.join(was, "node", "left_anti").select("node", F.col("to").alias("component"))
        self.labels = keep(moved.union(fresh).distinct(), "labels")
        drop_kept(was, joined)

    def several(self, merged: DataFrame) -> DataFrame:
        """Of all lists, those that hold more than one component: key, node and label, whether the label is the one that most of the list's nodes have, and how many have it and others."""
        lists = merged.select("node", F.explode("merged").alias("key"))
        named = lists.select("node", "key", F.col("node").alias("label")) if self.labels is None else lists.join(self.labels, "node", "left").select("node", "key", F.coalesce("component", "node").alias("label"))
        counts = named.groupBy("key", "label").agg(F.count("*").alias("size"))
        ends = counts.groupBy("key").agg(F.count("*").alias("labels"), F.sum("size").alias("size"), F.max(F.struct("size", "label")).alias("most"))
        # written first, so that a very common list is split over tasks
        ends = keep(ends.filter("labels > 1").select("key", F.col("most.label").alias("most"), F.col("most.size").alias("n_main"), (F.col("size") - F.col("most.size")).alias("n_other")), "ends")
        out = keep(named.join(ends, "key").select("key", "node", "label", (F.col("label") == F.col("most")).alias("main"), "n_main", "n_other"), "several")
        drop_kept(ends)
        return out

    def stars(self, merged: DataFrame) -> None:
        """Compares all nodes of a list with the one whose lists are longest together."""
        lists = merged.select("node", "weight", F.explode("merged").alias("key"))
        centre = keep(lists.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"), F.count("*").alias("size")).filter("size > 1").drop("size"), "centres")
        star = lists.join(centre, "key").filter("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        signs = self.nodes.select("node", "n", "signature")
        equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same)) >= self.matches
        close = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        seen = keep(star.join(signs.toDF("a", "na", "sa"), "a").join(signs.toDF("b", "nb", "sb"), "b").filter(close).filter(equal).select("a", "b"), "seen")
        sets = self.sets(seen.select(F.col("a").alias("node")).union(seen.select("b")))
        full = seen.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        self.add(keep(full.mapInArrow(_confirm(self.percent), "a long, b long"), "links"))
        drop_kept(centre, seen, sets)

    def compare(self, blocked: DataFrame, merged: DataFrame) -> None:
        """Compares the nodes of each group (key, i, j; node, label, block) with those of other labels, block i with block j."""
        ids = ["key", "i", "j"]
        rows = blocked.join(self.nodes.select("node", "n", "signature"), "node").join(merged, "node")
        if blocked.isEmpty():
            return
        alike = keep(rows.repartition(*ids).sortWithinPartitions(*ids).mapInArrow(_alike(self.percent, self.matches), "key long, i long, j long, node long, label long, partners array<long>"), "alike")
        sets = self.sets(alike)
        full = alike.join(sets, "node").select(*ids, "node", "label", "partners", "shingles")
        found = keep(full.repartition(*ids).sortWithinPartitions(*ids).mapInArrow(_joining(self.percent), "a long, b long"), "more")
        drop_kept(alike, sets)
        if not found.isEmpty():
            self.add(found)

    def merge(self, merged: DataFrame) -> DataFrame:
        """The star pass, and the merging of lists with no more than BLOCK nodes outside their largest component; returns the lists that are left."""
        self.stars(merged)
        rest = self.several(merged)
        self.compare(self.blocks(rest.filter(F.col("n_other") <= BLOCK)), merged)
        return rest.filter(F.col("n_other") > BLOCK)

    def blocks(self, rest: DataFrame) -> DataFrame:
        """The groups (key, i, j) of nodes that are compared. A list of BLOCK nodes is one group; else nodes of its largest component meet the others' blocks but not each other, and the others' blocks meet each other."""
        short = F.col("n_main") + F.col("n_other") <= BLOCK
        mains, others = (F.when(short, 0 if c == "n_main" else 1).otherwise(F.ceil(F.col(c) / BLOCK)).cast("long") for c in ("n_main", "n_other"))
        rest = rest.withColumns({"mains": mains, "others": others, "main": F.col("main") & ~short})
        block = F.when(F.col("main"), F.pmod(F.xxhash64("node"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), "others"))
        first = F.when(F.col("main"), F.col("mains")).otherwise(F.lit(0).cast("long"))
        each = rest.select("key", "node", "label", block.alias("block"), F.explode(F.sequence(first, F.col("mains") + F.col("others") - 1)).alias("other"))
        return each.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "block")

    def exact(self, long: DataFrame) -> DataFrame:
        """(node, merged) for the nodes of long, by the necessary prefixes of their shingles."""
        sets = self.sets(long)
        postings = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
        # a link's sets share this many of a set's shingles
        out = _prefixes(postings, F.ceil(F.lit(self.percent) * F.col("n") / 100).cast("int"))
        drop_kept(sets)
        return out


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id of each row, with names of the row (key, print) and of the row that stands for its component (keep_key, keep_print)."""
    print_of = F.xxhash64("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), print_of).alias("key"), print_of.alias("print"), "text")
    sketch = keep(texts.mapInArrow(_sketch(width), "doc_id long, key long, print long, n_shingles long, print_a long, print_b long, signature array<int>"), "sketch")
    full = sketch.filter("n_shingles > 0")
    # of a class's rows the one with the least id; those without come last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "print")).alias("least")
    classes = keep(full.groupBy(*_PRINTS).agg(least, F.any_value("signature").alias("signature")).withColumn("node", F.xxhash64(*_PRINTS)), "classes")
    nodes = classes.select("node", F.col("n_shingles").alias("n"), "signature", F.col("least.key").alias("key"))

    merge = _Merge(nodes, texts.select("key", "text"), width, percent)
    value = F.get("signature", F.col("c")).cast("long").bitwiseAND(F.lit((1 << 32) - 1))
    postings = nodes.select("node", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(COORDINATES - 1))).alias("c")).select("node", "n", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(value).alias("key"))
    merged = _prefixes(postings, F.lit(merge.matches))
    long = merge.merge(merged)
    if not long.isEmpty():
        again = merge.exact(long)
        rest = merge.merge(again)
        if not rest.isEmpty():
            merge.compare(merge.blocks(rest), again)

    member = classes.drop("signature") if merge.labels is None else classes.drop("signature").join(merge.labels, "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    member = keep(member.select(*_PRINTS, "node", "least"), "member")
    stands = member.groupBy("node").agg(F.count("*").alias("n"), F.min("least").alias("stands")).filter("n > 1").drop("n")
    member = keep(member.join(stands, "node", "left").select(*_PRINTS, F.coalesce("stands", "least").alias("of")), "named")
    drop_kept(classes, merged)
    out = sketch.drop("signature").join(member, list(_PRINTS), "left")
    own = lambda name, other: F.when(F.col("of").isNull(), F.col(name)).otherwise(F.col(f"of.{name}")).alias(other)
    return out.select("doc_id", "n_shingles", own("doc_id", "component_id"), "key", "print", own("key", "keep_key"), own("print", "keep_print"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    docs needs doc_id and text; other columns are ignored. Returns doc_id, n_shingles, component_id
    (least doc_id reachable over links, its own included) and kept (doc_id = component_id), one row
    for each input row. A null or blank text has an empty set, is linked with nothing and keeps its own
    id. Rows that repeat a doc_id are linked by their own texts. A row without doc_id gets the component
    of the rows it is linked with, is never kept, and has no component if none of these has a doc_id. An
    empty table gives an empty result.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be 1 to 100, not {percent}")
    found = _grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def survivors(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one stands for each component: that with the least doc_id, or where no row has one, with the least hash of its text.

    All rows without a word stay that differ in doc_id or text. Of rows that agree in doc_id and text one stays.
    """
    found = _grouped(docs, width, percent)
    names = keep(found.filter("key = keep_key and print = keep_print").select(F.col("key").alias("_key"), F.col("print").alias("_print")).distinct(), "survivors")
    print_of = F.xxhash64("text")
    named = docs.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), print_of), "_print": print_of})
    return named.join(names, ["_key", "_print"], "left_semi").dropDuplicates(["_key", "_print"]).drop("_key", "_print")

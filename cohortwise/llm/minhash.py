"""Near-duplicates by bottom-k sketches and exact verification.

One hash function is applied to all word shingles; a document's sketch is the k
least hash values of its set. Documents with the same set form one class first,
so copies are never paired.

Two sets with similarity s share at least ``least_overlap`` sketch values (five
standard deviations below the mean; exact for sets that fit in the sketch), hence
one of the rarest ``k - least_overlap + 1`` of either. Only these are put in
inverted lists, which keeps frequent shingles out of them. Lists with the same first member make one group,
in which a member stands once, however many of the lists it is in. Members that overlap with no other member in
enough sketch values leave their group. Every member then meets the
group's first member; pairs are filtered by size and by the estimate from the union
sketch, and verified on the full sets. Groups whose members
then lie in one component need nothing more. The members of the other groups are
compared in blocks inside tasks, across components only, and again verified on
full sets; a group of any size is split into pairs of small blocks. So no list is cut
short, no more links than members leave a block, and no task holds more than two blocks of a large group.

Sets are held as 64-bit hashes of shingles.

Defined results: a text without words (null, empty, white space) has no shingles
and stands alone; one with fewer words than a shingle has its whole word sequence
as the only one; a null id never names a component that has another id; repeated
rows are copies; an empty table gives an empty result. Columns besides id and text
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.common import cut_lineage, memory_returned, whole_text
from cohortwise.llm.components import connected_components
from cohortwise.llm.language_model import WordTable, _mix, words

_BLOCK_MEMBERS, _BLOCK_VALUES, _BUNDLE_MEMBERS, _COLUMNS = 512, 2_000_000, 512, 2048


@dataclass(frozen=True)
class NearDuplicates:
    """Words to a shingle, least similarity in hundredths, sketch size."""

    shingle: int = 5
    percent: int = 80
    k: int = 64

    @property
    def least_overlap(self) -> int:
        s = self.percent / 100
        return max(1, math.floor(self.k * s - 5 * math.sqrt(self.k * s * (1 - s))))

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        """On full sets."""
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)

    def plausible(self, a: np.ndarray, b: np.ndarray) -> bool:
        """By the union sketch: of the k least values of both sets, the share that lies in both."""
        union, times = np.unique(np.concatenate([a[: self.k], b[: self.k]]), return_counts=True)
        k = min(self.k, len(union))
        s = self.percent / 100
        margin = 5 * math.sqrt(s * (1 - s) / k) if len(a) > self.k or len(b) > self.k else 1e-9
        return times[:k].sum() / k - 1 >= s - margin


def shingle_set(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted different shingle hashes of a document's word hashes."""
    n = max(1, len(hashes) - shingle + 1) if len(hashes) else 0
    mixed = np.full(n, np.uint64(shingle), np.uint64)
    for i in range(min(shingle, len(hashes))):
        mixed = _mix(mixed * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n])
    return np.unique(mixed)


def _set_of(table: WordTable, text: str, shingle: int) -> np.ndarray:
    return shingle_set(table.column("hash", table.look_up(words(text))), shingle)


def _fingerprint(values: np.ndarray) -> bytes:
    return hashlib.sha256(values.tobytes()).digest()[:16]


def _sketches(documents: DataFrame, spec: NearDuplicates) -> DataFrame:
    """``(doc_id, key, n, set_id, sketch)`` of every document ``(doc_id, key, text)``."""

    @memory_returned
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in batches:
            sets = [_set_of(table, t.as_py(), spec.shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_fingerprint(s) for s in sets], pa.binary()),
                    pa.array([s[: spec.k].view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n", "set_id", "sketch"],
            )

    return documents.mapInArrow(sketched, "doc_id long, key string, n long, set_id binary, sketch array<long>")


def _lists(classes: DataFrame, spec: NearDuplicates) -> DataFrame:
    """Members ``(value, id, n, first)`` of the inverted lists that hold two classes or more.

    Values that a class shares with nobody are its rarest; its prefix goes on with
    the shared ones from rare to frequent. Lists with the same members count once.
    """
    postings = classes.select("id", "n", F.explode("sketch").alias("value"))
    shared = postings.groupBy("value").agg(F.count("*").alias("m")).where("m > 1")
    overlap = F.least(F.lit(spec.least_overlap), F.ceil(F.col("n") * spec.percent / 100))
    kept = F.least("n", F.lit(spec.k))
    by_class = Window.partitionBy("id")
    prefixes = (
        postings.join(shared, "value")
        .withColumn("rank", F.row_number().over(by_class.orderBy("m", "value")))
        .withColumn("alone", kept - F.count("*").over(by_class))
        .where(F.col("rank") <= kept - overlap + 1 - F.col("alone"))
        .select("value", "id", "n")
    )
    prefixes = cut_lineage(prefixes)
    summary = prefixes.groupBy("value").agg(
        F.count("*").alias("m"), F.min(F.struct("id", "n")).alias("first"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("s")
    )
    different = summary.where("m > 1").groupBy("m", "first", "x", "s").agg(F.min("value").alias("value")).select("value", "first")
    return cut_lineage(prefixes.join(different, "value"))


_LEAST_BITS, _MOST_BITS = 1 << 16, 1 << 27


def _marks(keys: DataFrame) -> np.ndarray:
    """Bytes of a bitmap in which the places of all ``key`` hashes are set; about 16 bits a key, 16 MB at most.

    It only keeps most other rows out: beyond its size more of them pass, and none that is wanted is ever lost.
    """
    wanted = keys.count()
    bits = min(_MOST_BITS, max(_LEAST_BITS, 1 << (16 * wanted).bit_length()))
    place = (F.pmod(F.xxhash64("key"), F.lit(bits)) + 1).alias("place")
    rows = keys.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    marks = np.zeros(bits // 8, np.uint8)
    for row in rows.collect():  # bits / 32768 rows
        part = np.frombuffer(row["bitmap"], np.uint8)
        first = (row["bucket"] - 1) * len(part)
        marks[first : first + len(part)] = part[: len(marks) - first]
    return marks


def _sets_of(documents: DataFrame, classes: DataFrame, spec: NearDuplicates) -> DataFrame:
    """``(id, values)``: the full sets of the given classes, from the texts of their first documents.

    Texts are not shuffled: a bitmap of the wanted documents goes to the tasks, and only sets leave them.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    wanted = cut_lineage(classes.select("id", "set_id", key))
    marks = _marks(wanted.select("key"))

    @memory_returned
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in batches:
            place = batch.column("place").to_numpy()
            texts = batch.column("text").filter(pa.array((marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            found = [_set_of(table, t.as_py(), spec.shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["set_id", "values"])

    texts = documents.select(F.pmod(F.xxhash64(key), F.lit(8 * len(marks))).alias("place"), "text")
    return texts.mapInArrow(sets, "set_id binary, values binary").join(wanted.select("id", "set_id"), "set_id").select("id", "values").dropDuplicates(["id"])


def _array(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_py(), np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, spec: NearDuplicates) -> DataFrame:
    """Those pairs ``(a, b)`` that are similar."""

    @memory_returned
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("va"), batch.column("vb")):
                a, b = _array(x), _array(y)
                keep.append(spec.plausible(a, b) and spec.similar(a, b))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = sets.withColumnsRenamed({"id": "a", "values": "va"}), sets.withColumnsRenamed({"id": "b", "values": "vb"})
    return pairs.join(one, "a").join(other, "b").select("a", "b", "va", "vb").mapInArrow(verify, "a long, b long")


def _overlaps(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many values each of the one side's sketches shares with each of the other's, some columns of values at a time."""
    sizes = [len(s) for s in (*one, *other)]
    member = np.repeat(np.arange(len(sizes)), sizes)
    _, column = np.unique(np.concatenate([*one, *other]), return_inverse=True)
    left = member < len(one)
    both = (np.bincount(column[left], minlength=column.max(initial=-1) + 1) > 0) & (np.bincount(column[~left], minlength=column.max(initial=-1) + 1) > 0)
    place = np.cumsum(both) - 1
    kept = both[column]
    member, column, left = member[kept], place[column[kept]], left[kept]
    overlap = np.zeros((len(one), len(other)), np.float32)
    for first in range(0, int(both.sum()), _COLUMNS):
        here = (column >= first) & (column < first + _COLUMNS)
        sides = []
        for side, rows, begin in ((left, len(one), 0), (~left, len(other), len(one))):
            present = np.zeros((rows, min(_COLUMNS, int(both.sum()) - first)), np.float32)
            present[member[here & side] - begin, column[here & side] - first] = 1
            sides.append(present)
        overlap += sides[0] @ sides[1].T
    return overlap


def _likely(one: list[np.ndarray], n_one: np.ndarray, other: list[np.ndarray], n_other: np.ndarray, spec: NearDuplicates) -> tuple[np.ndarray, np.ndarray]:
    """Overlaps of the sketches of two blocks, and which pairs overlap enough and are of like size."""
    overlap = _overlaps(one, other)
    large, small = np.maximum(n_one[:, None], n_other[None, :]), np.minimum(n_one[:, None], n_other[None, :])
    needed = np.where(large <= spec.k, -(-spec.percent * (large + small) // (100 + spec.percent)), spec.least_overlap)
    return overlap, (overlap >= needed) & (100 * small >= spec.percent * large)


class _Comparison:
    """Links between members of different components, over all groups of a bundle; a pair is compared once."""

    def __init__(self, spec: NearDuplicates):
        self._spec, self._root, self._compared = spec, {}, set()
        self.links: list[tuple[int, int]] = []

    def _find(self, group: int) -> int:
        root = self._root
        while (up := root.setdefault(group, group)) != group:
            root[group] = root[up]
            group = up
        return group

    def compare(self, one: _Side, other: _Side) -> None:
        """Add as many links as join components that were apart."""
        spec = self._spec
        roots = [np.array([self._find(c) for c in side.component.tolist()]) for side in (one, other)]
        if len(np.unique(np.concatenate(roots))) == 1:
            return
        overlap, likely = _likely([s[: spec.k] for s in one.arrays], one.n, [s[: spec.k] for s in other.arrays], other.n, spec)
        if one is other:
            likely = np.triu(likely, 1)
        left, right = (likely & (roots[0][:, None] != roots[1][None, :])).nonzero()
        for i in np.argsort(-overlap[left, right], kind="stable"):
            a, b = left[i], right[i]
            pair = (int(min(one.ids[a], other.ids[b])), int(max(one.ids[a], other.ids[b])))
            x, y = self._find(int(roots[0][a])), self._find(int(roots[1][b]))
            if x == y or pair in self._compared:
                continue
            self._compared.add(pair)
            if spec.plausible(one.arrays[a], other.arrays[b]) and spec.similar(one.arrays[a], other.arrays[b]):
                self._root[max(x, y)] = min(x, y)
                self.links.append(pair)


@dataclass
class _Side:
    """Members of a group that lie in one block."""

    ids: np.ndarray
    n: np.ndarray
    component: np.ndarray
    arrays: list[np.ndarray]


_DEALT = ("bundle", "low", "high", "blocks")


def _deal(members: DataFrame) -> DataFrame:
    """Members ``(centre, id, n, size, component)`` dealt to bundles that one task can hold; ``size`` counts what each one ships.

    Small groups share a bundle; a large one is dealt in pairs of blocks.
    """
    sizes = members.groupBy("centre").agg(F.count("*").alias("m"), F.sum("size").alias("values"))
    blocks = F.greatest(F.ceil(F.col("m") / F.lit(_BLOCK_MEMBERS)), F.ceil(F.col("values") / F.lit(_BLOCK_VALUES))).cast("int")
    sized = cut_lineage(sizes.select("centre", blocks.alias("blocks"), "m"))
    bundles = max(1, math.ceil((sized.where("blocks = 1").agg(F.sum("m")).first()[0] or 0) / _BUNDLE_MEMBERS))
    return (
        members.join(sized.drop("m"), "centre")
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("bundle", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("centre"), F.lit(bundles))).otherwise(F.col("centre")))
        .withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
        .select(*_DEALT, "centre", "id", "n", "component", "mine")
    )


def _by_group(rows: pa.Table, array: Callable[[pa.Scalar], np.ndarray]) -> Iterator[tuple[int, _Side, _Side]]:
    """``(centre, one block, other block)`` of each group in a bundle; the same block twice where a block meets itself."""
    rows = rows.sort_by([("centre", "ascending"), ("mine", "ascending"), ("id", "ascending")])
    centre, mine, high = (rows[c].to_numpy() for c in ("centre", "mine", "high"))
    numbers = {c: rows[c].to_numpy() for c in ("id", "n", "component")}
    payload = rows["values"]
    edges = np.concatenate([[0], (centre[1:] != centre[:-1]).nonzero()[0] + 1, [len(centre)]])

    def side(first: int, last: int) -> _Side:
        here = slice(first, last)
        return _Side(numbers["id"][here], numbers["n"][here], numbers["component"][here], [array(payload[i]) for i in range(first, last)])

    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
        cut = first + int(np.searchsorted(mine[first:last], high[first]))
        upper = side(cut, last)
        yield int(centre[first]), side(first, cut) if cut > first else upper, upper


def _active(groups: DataFrame, classes: DataFrame, spec: NearDuplicates) -> DataFrame:
    """``(centre, id)`` of members that some other member of their group overlaps with in as many sketch values as similar sets do."""
    dealt = _deal(groups.withColumns({"size": F.lit(0), "component": F.lit(0).cast("long")}))
    shipped = dealt.join(classes.select("id", F.col("sketch").alias("values")), "id")

    def filter_members(rows: pa.Table) -> pa.Table:
        kept: tuple[list, list] = ([], [])
        for centre, one, other in _by_group(rows, lambda x: x.values.to_numpy().view(np.uint64)):
            _, likely = _likely(one.arrays, one.n, other.arrays, other.n, spec)
            if one is other:
                np.fill_diagonal(likely, False)
            found = {*one.ids[likely.any(1)].tolist(), *other.ids[likely.any(0)].tolist()}
            kept[0].extend([centre] * len(found))
            kept[1].extend(found)
        return pa.table({"centre": pa.array(kept[0], pa.int64()), "id": pa.array(kept[1], pa.int64())})

    return shipped.groupBy(*_DEALT).applyInArrow(filter_members, "centre long, id long").distinct()


def _across_components(members: DataFrame, components: DataFrame, sets: DataFrame, spec: NearDuplicates) -> DataFrame:
    """Links that the first members of the groups have not shown."""
    named = members.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    summary = named.groupBy("centre").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("m"))
    apart = named.join(summary.where("least <> most and m > 2").select("centre"), "centre").withColumn("size", F.col("n"))
    shipped = _deal(cut_lineage(apart)).join(sets, "id")

    def compare(rows: pa.Table) -> pa.Table:
        comparison = _Comparison(spec)
        for _, one, other in _by_group(rows, _array):
            comparison.compare(one, other)
        links = comparison.links
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return shipped.groupBy(*_DEALT).applyInArrow(compare, "a long, b long").distinct()


def _judged(narrow: DataFrame, spec: NearDuplicates) -> DataFrame:
    """``(doc_id, key, n, component, component_id)`` of every document ``(doc_id, key, text)``; ``component`` is null without shingles."""
    sketched = cut_lineage(_sketches(narrow, spec))
    by_set = sketched.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut_lineage(by_set).withColumn("id", F.monotonically_increasing_id())  # stable: the rows lie in files now
    groups = cut_lineage(_lists(classes, spec).select(F.col("first.id").alias("centre"), "id", "n").distinct())
    active = groups.join(_active(groups, classes, spec), ["centre", "id"])
    first = active.groupBy("centre").agg(F.min(F.struct("id", "n")).alias("first"))
    members = cut_lineage(active.join(first, "centre"))
    concerned = members.select("id").distinct()
    sets = cut_lineage(_sets_of(narrow, classes.join(concerned, "id", "left_semi"), spec))
    small, large = F.least("n", "first.n"), F.greatest("n", "first.n")
    pairs = members.where((F.col("id") != F.col("first.id")) & (100 * small >= spec.percent * large)).select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct()
    links = cut_lineage(_verified(pairs, sets, spec))
    components = connected_components(links)
    more = cut_lineage(_across_components(members.select("centre", "id", "n"), components, sets, spec))
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))
    named = classes.select("id", "set_id", "doc_id").join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(least, "component").select("set_id", "component", "component_id")
    # texts without words share one set and are linked with nothing: they never meet in a join
    with_words = sketched.where("n > 0").select("doc_id", "key", "n", "set_id").join(by_class, "set_id").drop("set_id")
    alone = sketched.where("n = 0").select("doc_id", "key", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return with_words.unionByName(alone)


def near_duplicates(documents: DataFrame, spec: NearDuplicates = NearDuplicates(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: the smallest id that links lead to, for every document."""
    narrow = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.lit("").alias("key"), whole_text(text_column).alias("text"))
    judged = _judged(narrow, spec)
    return judged.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_copies(documents: DataFrame, spec: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row of each group, columns unchanged: the one with the smallest id, then text; null ids come last.

    Rows are told apart by (id, digest of the text), so repeated ids with different texts are judged apart and of rows
    equal in both one stays. Rows without words are linked with nothing and all stay.
    """
    digest = F.md5(whole_text())
    judged = _judged(documents.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("key"), whole_text().alias("text")), spec)
    judged = cut_lineage(judged.select("doc_id", "key", "component"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = F.min_by(F.struct("doc_id", "key"), order)
    stays = judged.where("component is not null").groupBy("component").agg(first.alias("row")).select(F.col("row.doc_id").alias("stay_id"), F.col("row.key").alias("stay_key"))
    alone = judged.where("component is null").select(F.col("doc_id").alias("stay_id"), F.col("key").alias("stay_key")).distinct()
    stays = cut_lineage(stays.unionByName(alone.where("stay_id is not null or stay_key is not null")))
    same = (documents["doc_id"].cast("long").eqNullSafe(stays["stay_id"])) & (digest == stays["stay_key"])
    kept = documents.join(stays, same, "left_semi")
    several = judged.where("component is not null").groupBy("doc_id", "key").agg(F.count("*").alias("times")).where("times > 1")
    if several.isEmpty():
        return kept
    # rows equal in id and text: one of each stays
    several = cut_lineage(several.select(F.col("doc_id").alias("several_id"), F.col("key").alias("several_key")))
    equal = (documents["doc_id"].cast("long").eqNullSafe(several["several_id"])) & (digest == several["several_key"])
    single = kept.join(several, equal, "left_anti")
    names = [f"column_{i}" for i in range(len(documents.columns))]
    repeated = kept.join(several, equal, "left_semi").toDF(*names)
    at = {c: n for c, n in zip(documents.columns, names)}
    one = repeated.withColumns({"one_id": F.col(at["doc_id"]), "one_key": F.md5(whole_text(at["text"]))}).dropDuplicates(["one_id", "one_key"]).select(*names)
    return single.unionByName(one.toDF(*documents.columns))

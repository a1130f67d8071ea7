"""Deduplicate new batches against all history.

Exact repeats are found by digest and by the hash of the folded text; everything after that works on classes of equal
folded text. A class gets a fingerprint of 160 bytes, each the low byte of a min-hash of its words, so the share of
differing bits estimates how many words two texts don't share. Each of 64 tables keys the texts by 8 of these bytes and by
the order in which their words stand in the text: texts of one template share many words, but in another order, and don't
meet. Only words that a text has once count for the order, since a repeated word's first place changes easily. Texts that
meet in a table are candidates if a sketch of their fingerprints (128 bits, one a lane) differs little; then the Hamming
distance of the fingerprints and last the words themselves are compared: at least three quarters of the longer text's words
stand in the other in the same order.

A bucket above BUCKET members is not expanded into pairs at first: its members meet its HEADS earliest ones. Then each
member meets all others of the bucket that arrived before the earliest class it is known to repeat (before itself where
there is none), in blocks of BLOCK by BLOCK members by whole fingerprints, so nothing is dropped and no task is large;
members that repeat one of the earliest have nothing left to meet.

Tables find a pair by chance (see the README); what they miss is mostly far apart but has a text between: what a text's own
repeats repeat, and that arrived before all it is known to repeat, is compared with it too.

History grows by appending (HistoryStore): a new batch's keys are looked up in the stored tables, and its own are added; what
was accepted before isn't fingerprinted again, and of its texts only the candidates' are read. found() is a store's first
batch without the writing.

Defined results: null or blank texts repeat nothing by text, null or malformed digests and sizes of zero nothing by
digest; documents without any event_ts have no arrival and take no part; of rows with one doc_id (in any letter case)
the first pos counts; equal arrivals don't repeat each other; empty tables give an empty result; extra columns are
ignored; very long texts are compared whole. Word order is compared by a longest common subsequence in bit vectors.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacre.sources.tables import written

LANES, BLOCKS = 160, 32
#: Tables and the lanes of each one's key.
TABLES, KEYED = 64, 8
#: Differing bits up to which pairs stay candidates: of 128 sketch bits (a half of them differ for every word not shared)
#: and of 1,280 fingerprint bits (texts that share 0.6 of their words differ in about 256).
MAX_SKETCH, MAX_BITS = 40, 330
BUCKET, HEADS, BLOCK = 500, 4, 2000
#: Shared keys, and ids of candidates, up to which they are broadcast (16 to 60 bytes each); above, joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Share of the longer text's words in the same order.
SIMILARITY = 0.75
#: Combining marks, and characters that show nothing.
MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]+")


def fold(text: str | None) -> str:
    """Letter case, accents and spacing taken away; empty where nothing is left."""
    if not text:
        return ""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFD", text))
    return " ".join(text.lower().split())


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence of words, a bit for each word of a."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := at.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def repeats(a: list[str], b: list[str], similarity: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    need = similarity * longer
    if not longer or min(len(a), len(b)) < need:
        return False
    more, less = (a, b) if len(a) >= len(b) else (b, a)
    if len(set(more).difference(less)) > longer - need:  # words of the longer text that the other hasn't at all
        return False
    head = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    for x, y in zip(reversed(a), reversed(b), strict=False):
        if x != y:
            break
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    same = head + tail  # a common head and tail belong to some longest common subsequence
    if same >= need:
        return True
    if same + sum((Counter(a) & Counter(b)).values()) < need:  # words in common in any order
        return False
    return same + lcs_length(a, b) >= need


class Fingerprints:
    """Min-hash bytes of texts' words and the places of these words; the lanes of known words are kept in a matrix of bounded
    size."""

    def __init__(self, limit: int = 60_000) -> None:
        import numpy as np

        draw = np.random.default_rng(20_240_229)
        self.mul = draw.integers(1, 1 << 63, LANES, np.uint64) | np.uint64(1)
        self.add = draw.integers(0, 1 << 63, LANES, np.uint64)
        self.lanes = np.empty((1024, LANES), np.uint32)
        self.row: dict[str, int] = {}
        self.limit = limit
        shuffled = [draw.permutation(LANES) for _ in range(-(-TABLES * KEYED // LANES))]
        self.tables = np.concatenate(shuffled)[: TABLES * KEYED].reshape(TABLES, KEYED)

    def of(self, text: str):  # noqa: ANN201
        """(bytes, places) of the lanes of a folded text; a word that it has more than once has the place -1."""
        import numpy as np
        import xxhash

        words = Counter(text.split(" "))  # in the order of their first places
        if len(self.row) + len(words) > self.limit:
            self.row.clear()
        new = [w for w in words if w not in self.row]
        if new:
            h = np.array([xxhash.xxh64_intdigest(w.encode()) for w in new], np.uint64)[:, None]
            first = len(self.row)
            while first + len(new) > len(self.lanes):
                self.lanes = np.concatenate([self.lanes, np.empty_like(self.lanes)])
            self.lanes[first : first + len(new)] = ((h * self.mul + self.add) >> np.uint64(32)).astype(np.uint32)
            self.row.update(zip(new, range(first, first + len(new)), strict=True))
        lanes = np.ascontiguousarray(self.lanes[[self.row[w] for w in words]].T)
        least = lanes.argmin(axis=1)
        once = np.fromiter(words.values(), np.int64, len(words)) == 1
        return (lanes[np.arange(LANES), least] & np.uint32(0xFF)).astype(np.uint8), np.where(once[least], least, -1).astype(np.int32)

    def keys(self, lanes, places):  # noqa: ANN001, ANN201
        """(n, LANES) bytes and places -> (n, TABLES) keys: the bytes of each table's lanes and which of two words comes later."""
        import numpy as np

        out = np.empty((len(lanes), TABLES), np.int32)
        for i in range(0, len(lanes), 500):
            bytes_of, later = np.ascontiguousarray(lanes[i : i + 500][:, self.tables]), places[i : i + 500].T[self.tables.T]
            earlier = np.where(later < 0, np.iinfo(np.int32).max, later)
            order = np.zeros((TABLES, len(bytes_of)), np.uint64)
            for x in range(KEYED):
                for y in range(x):
                    order = order << np.uint64(1) | (later[x] > earlier[y])
            h = bytes_of.view(np.uint64)[:, :, 0] * np.uint64(0x9E3779B97F4A7C15)
            h = ((h ^ h >> np.uint64(29)) + order.T) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
            out[i : i + 500] = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return out


def entries(classes: DataFrame, *kept: str) -> DataFrame:
    """(c, keys, kept ...) -> (key, c, kept ...): the places of each class in the tables; a key begins with its table's number."""
    placed = classes.where("keys is not null").select("c", *kept, F.posexplode("keys").alias("t", "k"))
    return placed.select((F.shiftleft(F.col("t").cast("long"), 32) + F.col("k")).alias("key"), "c", *kept)


def sketched(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Whether two sketches differ little."""
    return F.bit_count(F.col(a0).bitwiseXOR(F.col(b0))) + F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) <= MAX_SKETCH


def _pairs_within(lists: DataFrame) -> DataFrame:
    """(cs) -> (a, b) of each two members (c, s0, s1) of a list of bounded length whose sketches differ little."""
    pairs = F.expr(
        "flatten(transform(cs, (x, i) -> transform(filter(slice(cs, i + 2, size(cs)), "
        f"y -> x.c != y.c and bit_count(x.s0 ^ y.s0) + bit_count(x.s1 ^ y.s1) <= {MAX_SKETCH}), y -> struct(least(x.c, y.c) as a, greatest(x.c, y.c) as b))))"
    )
    return lists.select(F.inline(pairs))


def candidates(prints: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """prints(c, keys, s0, s1) -> candidate pairs (a, b) of classes, and the members (key, n, c, first, bound) of
    buckets above BUCKET (None without one); bound: the last arrival among the bucket's HEADS earliest, which all members are
    paired with."""
    size = entries(prints).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    size = written(size, "sizes")
    shared = written(entries(prints, "s0", "s1").join(F.broadcast(size) if size.count() <= BROADCAST_KEYS else size, "key"), "shared-keys")
    small = shared.where(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list(F.struct("c", "s0", "s1")).alias("cs"))
    if size.where(F.col("n") > BUCKET).isEmpty():
        return _pairs_within(small).distinct(), None
    big = written(shared.where(F.col("n") > BUCKET).select("key", "n", "c", "s0", "s1").distinct().join(classes.select("c", "first"), "c"), "large")
    order = Window.partitionBy("key").orderBy("first")
    heads = big.select("key", "first", F.col("c").alias("h"), F.col("s0").alias("h0"), F.col("s1").alias("h1")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= HEADS)
    heads = written(heads.select("key", "h", "h0", "h1", "first"), "heads")
    led = big.join(heads.select("key", "h", "h0", "h1"), "key").where((F.col("c") != F.col("h")) & sketched("s0", "s1", "h0", "h1"))
    led = led.select(F.least("c", "h").alias("a"), F.greatest("c", "h").alias("b"))
    return _pairs_within(small).unionByName(led).distinct(), big.drop("s0", "s1").join(heads.groupBy("key").agg(F.max("first").alias("bound")), "key")


def earlier(big: DataFrame, links: DataFrame, classes: DataFrame, prints: DataFrame) -> DataFrame:
    """big: see candidates(); links(c, other) -> pairs (a, b): each member of a large bucket with the bucket's members,
    heads apart, that arrived before all that it is linked to, if their fingerprints differ in MAX_BITS bits at most."""
    salts = F.ceil(F.col("n") / BLOCK).cast("int")
    mine, all_of = F.pmod(F.xxhash64("c"), salts).cast("int"), F.explode(F.sequence(F.lit(0), salts - 1))
    big = big.join(prints.select("c", F.col("print").alias("w")), "c")
    left = big.join(nearest(links, classes), "c", "left").withColumn("limit", F.least("first", F.coalesce("near", "first"))).where("limit > bound")
    left = left.select("key", "c", "limit", "w", mine.alias("i"), all_of.alias("j"))
    right = big.where("first > bound").select("key", F.col("c").alias("o"), F.col("first").alias("of"), F.col("w").alias("wo"), mine.alias("j"), all_of.alias("i"))
    met = left.join(right, ["key", "i", "j"]).where((F.col("of") < F.col("limit")) & (differing("w", "wo") <= MAX_BITS))
    return met.select(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).distinct()


def nearest(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, near): the earliest document of the classes that each class is linked to."""
    return links.join(classes.select(F.col("c").alias("other"), "first"), "other").groupBy("c").agg(F.min("first").alias("near"))


def differing(a: str, b: str) -> Column:
    """Bits in which two fingerprints differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BLOCKS)), F.lit(0))


def near(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs whose fingerprints differ in MAX_BITS bits at most; prints(c, print)."""
    p = prints.select("c", F.col("print").alias("w"))
    both = pairs.join(p.select(F.col("c").alias("a"), F.col("w").alias("wa")), "a").join(p.select(F.col("c").alias("b"), F.col("w").alias("wb")), "b")
    return both.where(differing("wa", "wb") <= MAX_BITS).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) of ids whose texts repeat each other. Where the ids of the pairs are few enough to be broadcast, only
    their texts are shuffled, else texts(id, text) as a whole."""
    t = texts.select("id", "text")
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    if needed.count() <= BROADCAST_KEYS:
        t = t.join(F.broadcast(needed), "id", "left_semi")
    both = pairs.join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    kind = texts.schema["id"].dataType.simpleString()

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words: dict[str, list[str]] = {}
            keep = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                for t in (ta, tb):
                    if t not in words:
                        words[t] = fold(t).split(" ")
                keep.append(repeats(words[ta], words[tb]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def text_of() -> Column:
    return F.coalesce(F.when(F.trim("native_text") != "", F.col("native_text")), F.col("ocr_text"))


def fingerprinted(texts: DataFrame, *kept: str) -> DataFrame:
    """(text, kept ...) -> (kept ..., c, print, keys, s0, s1): the 64-bit hash of the folded text, its fingerprint, its keys in
    the tables and the lowest bits of 128 lanes; null without words. A fingerprint is a list of its blocks, five bytes each
    in a long."""
    schema = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in kept)

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        prints = Fingerprints()
        for batch in batches:
            n = batch.num_rows
            ids: list[int | None] = [None] * n
            lanes, places = np.zeros((n, LANES), np.uint8), np.full((n, LANES), -1, np.int32)
            for i, t in enumerate(map(fold, batch.column("text").to_pylist())):
                if t:
                    ids[i] = xxhash.xxh64_intdigest(t.encode()) - (1 << 63)
                    lanes[i], places[i] = prints.of(t)
            blank = np.array([i is None for i in ids], bool)
            bits = np.packbits(lanes[:, :128] & 1, axis=1).view(np.int64)
            blocks = (lanes.reshape(-1, BLOCKS, LANES // BLOCKS).astype(np.int64) << np.arange(0, 8 * (LANES // BLOCKS), 8)).sum(axis=2)
            made = [pa.array(ids, pa.int64())]
            for values in (blocks, prints.keys(lanes, places)):
                offsets = np.arange(n + 1, dtype=np.int32) * values.shape[1]
                made.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()), mask=pa.array(blank)))
            made += [pa.array(bits[:, k], mask=blank) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made], [*kept, "c", "print", "keys", "s0", "s1"])

    return texts.select("text", *kept).mapInArrow(work, f"{schema}, c long, print array<long>, keys array<int>, s0 long, s1 long")


def documents(analyses: DataFrame) -> DataFrame:
    """(doc_id, sha, pos, c, print, keys, s0, s1): one notation for ids and digests; texts are read and folded once."""
    sha = F.regexp_extract(F.lower("sha256"), "([0-9a-f]{64})", 1)
    a = analyses.where("doc_id is not null").select(F.lower(F.trim("doc_id")).alias("doc_id"), F.when((sha != "") & (F.col("size_bytes") > 0), sha).alias("sha"), "pos", text_of().alias("text"))
    return fingerprinted(a, "doc_id", "sha", "pos")


def arrivals(batch_documents: DataFrame) -> DataFrame:
    return batch_documents.where("event_ts is not null").groupBy(F.lower(F.trim("doc_id")).alias("doc_id")).agg(F.min("event_ts").alias("ts"))


def beyond(links: DataFrame, classes: DataFrame) -> DataFrame:
    """links(c, other) in both directions -> pairs (a, b): each class with what its links are linked to, where that arrived
    before the class and before all it is linked to itself."""
    f = classes.select("c", "first")
    mine = f.join(nearest(links, classes), "c").select("c", F.least("first", "near").alias("limit"))
    hop = links.join(mine, "c").select("c", "limit", F.col("other").alias("m"))
    far = links.select(F.col("c").alias("m"), F.col("other").alias("o")).join(f.select(F.col("c").alias("o"), F.col("first").alias("of")), "o")
    met = hop.join(far, "m").where((F.col("of") < F.col("limit")) & (F.col("o") != F.col("c")))
    return met.select(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).distinct()


def links_within(prints: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(c, other) in both directions of classes that repeat each other; classes(c, first), texts(id, text) by document."""
    pairs, big = candidates(prints, classes)

    def linked(candidate: DataFrame, far: bool = True) -> DataFrame:
        first = lambda side: classes.select(F.col("c").alias(side), F.col("first.doc_id").alias(f"{side}_doc"))
        ids = (near(candidate, prints) if far else candidate).join(first("a"), "a").join(first("b"), "b")
        ids = written(ids.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("a_doc").alias("a"), F.col("b_doc").alias("b")), "candidates")
        return both_ways(written(ids.join(verified(ids.select("a", "b"), texts), ["a", "b"]).select("ca", "cb"), "links"))

    links = linked(pairs)
    if big is not None:
        links = links.unionByName(linked(earlier(big, links, classes, prints)))
    more = written(beyond(links, classes), "beyond")
    return links if more.isEmpty() else links.unionByName(linked(more, far=False))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(ca, cb) -> (c, other) in both directions."""
    return pairs.select(F.col("ca").alias("c"), F.col("cb").alias("other")).unionByName(pairs.select(F.col("cb").alias("c"), F.col("ca").alias("other")))


def prepared(analyses: DataFrame, batch_documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """light (doc_id, sha, c, ts, me) of arrived documents, their classes (c, first), prints (c, print, keys, s0, s1), and texts."""
    docs = written(documents(analyses), "prints")
    one = docs.groupBy("doc_id").agg(F.min_by(F.struct("sha", "c"), "pos").alias("x")).select("doc_id", "x.sha", "x.c")
    light = written(one.join(arrivals(batch_documents), "doc_id").withColumn("me", F.struct("ts", "doc_id")), "arrived")
    prints = written(docs.where("c is not null").select("c", "print", "keys", "s0", "s1").dropDuplicates(["c"]), "class-prints")
    texts = analyses.select(F.lower(F.trim("doc_id")).alias("id"), text_of().alias("text"))
    return light, written(first_of(light), "first"), prints, texts


def first_of(light: DataFrame) -> DataFrame:
    return light.where("c is not null").groupBy("c").agg(F.min("me").alias("first"))


def resolved(light: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, doc_id_a, doc_id_b): every document of light, whose classes are given, with the earliest one that it repeats by
    links or digest."""
    by_text = classes.join(nearest(links, classes), "c", "left").select("c", F.least("first", F.coalesce("near", "first")).alias("by_text"))
    by_sha = light.where("sha is not null").groupBy("sha").agg(F.min("me").alias("by_sha"), F.count("*").alias("n")).where("n > 1").drop("n")
    d = light.join(by_text, "c", "left").join(by_sha, "sha", "left")
    d = d.withColumn("before", F.least("by_text", "by_sha")).where("before.ts < ts and before.doc_id != doc_id")
    return d.select("doc_id", F.least("doc_id", "before.doc_id").alias("doc_id_a"), F.greatest("doc_id", "before.doc_id").alias("doc_id_b"))


def found(analyses: DataFrame, batch_documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): every document with the earliest arrived one that it repeats, the smaller id first."""
    light, classes, prints, texts = prepared(analyses, batch_documents)
    return resolved(light, classes, links_within(prints, classes, texts)).select("doc_id_a", "doc_id_b").distinct()


class HistoryStore:
    """Accepted documents, classes with fingerprint and text, and table keys with sketches, appended batch by batch.

    A batch is a sub-folder of each table and counts once its marker is there, so a batch that broke off leaves nothing that
    is read. Looking up reads the stored keys (24 bytes each) and documents' ids; of fingerprints and texts only those of
    candidates. A batch's keys are broadcast where they are few, so the stored ones aren't shuffled.
    """

    TABLES = {
        "documents": "doc_id string, sha string, c long, ts timestamp", "keys": "key long, o long, o0 long, o1 long", "classes": "c long, print array<long>, text string, doc_id string",
    }

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of the finished batches."""
        root = self._path(f"{self.folder}/finished")
        return sorted(str(f.getPath().getName()) for f in self._files.listStatus(root)) if self._files.exists(root) else []

    def stored(self, name: str) -> DataFrame:
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], self.TABLES[name])
        return self.spark.read.schema(self.TABLES[name]).parquet(*(f"{self.folder}/{name}/{b}" for b in done))

    def check(self, light: DataFrame, classes: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
        """A prepared() batch -> (doc_id, doc_id_a, doc_id_b): each of its documents with the earliest one, stored or of the
        batch, that it repeats. What was found for stored documents isn't looked at again, also if the batch holds one that
        arrived before them."""
        links = links_within(prints, classes, texts)
        if self.batches():
            links = links.unionByName(self._links(classes, prints, texts))
        links = written(links, "batch-links")
        old = self.stored("documents")
        partners = links.select(F.col("other").alias("c")).union(light.where("c is not null").select("c")).distinct()
        by_class = old.join(self._few(partners), "c", "left_semi")
        by_sha = old.join(self._few(light.where("sha is not null").select("sha").distinct()), "sha", "left_semi")
        known = by_class.unionByName(by_sha).distinct().withColumn("me", F.struct("ts", "doc_id")).join(self._few(light.select("doc_id")), "doc_id", "left_anti")
        every = written(light.select("doc_id", "sha", "c", "ts", "me").unionByName(known.select("doc_id", "sha", "c", "ts", "me")), "batch-and-partners")
        return resolved(every, first_of(every), links).join(light.select("doc_id"), "doc_id", "left_semi").distinct()

    def append(self, light: DataFrame, prints: DataFrame, texts: DataFrame) -> None:
        """Accepts a batch: its documents, and the classes that aren't stored yet."""
        import uuid

        name = f"{len(self.batches()):08d}-{uuid.uuid4().hex}"
        classes = first_of(light)
        new = prints.join(classes, "c").select("c", "print", "keys", "s0", "s1", F.col("first.doc_id").alias("doc_id")).join(self.stored("documents").select("c").distinct(), "c", "left_anti")
        t = texts.groupBy(F.col("id").alias("doc_id")).agg(F.min("text").alias("text"))
        new = written(new.join(t, "doc_id"), "new-classes")
        light.select("doc_id", "sha", "c", "ts").write.parquet(f"{self.folder}/documents/{name}")
        new.select("c", "print", "text", "doc_id").write.parquet(f"{self.folder}/classes/{name}")
        keys = entries(new, "s0", "s1")
        keys.select("key", F.col("c").alias("o"), F.col("s0").alias("o0"), F.col("s1").alias("o1")).write.parquet(f"{self.folder}/keys/{name}")
        self._files.mkdirs(self._path(f"{self.folder}/finished/{name}"))

    def add(self, analyses: DataFrame, batch_documents: DataFrame) -> DataFrame:
        """check() and append() of one batch: (doc_id_a, doc_id_b) of its documents."""
        light, classes, prints, texts = prepared(analyses, batch_documents)
        got = written(self.check(light, classes, prints, texts).select("doc_id_a", "doc_id_b").distinct(), "batch-found")
        self.append(light, prints, texts)
        return got

    def _few(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df

    def _links(self, classes: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
        """(c, other) of the batch's classes with stored ones that they repeat, in both directions."""
        own = written(entries(prints.join(classes.select("c"), "c", "left_semi"), "s0", "s1"), "batch-keys")
        met = self.stored("keys").join(self._few(own), "key").where((F.col("c") != F.col("o")) & sketched("s0", "s1", "o0", "o1")).select("c", "o").distinct()
        met = written(met, "met")
        kept = self.stored("classes").join(self._few(met.select(F.col("o").alias("c")).distinct()), "c", "left_semi").select("c", "print", "text", "doc_id")
        kept = written(kept, "met-classes")
        w = prints.select("c", F.col("print").alias("wa"))
        close = met.join(w, "c").join(kept.select(F.col("c").alias("o"), F.col("print").alias("wb")), "o").where(differing("wa", "wb") <= MAX_BITS)
        pairs = close.join(classes.select("c", F.col("first.doc_id").alias("a")), "c").join(kept.select(F.col("c").alias("o"), F.concat(F.lit("stored "), "doc_id").alias("b")), "o").select("c", "o", "a", "b")
        pairs = written(pairs, "stored-candidates")
        both = texts.select("id", "text").unionByName(kept.select(F.concat(F.lit("stored "), "doc_id").alias("id"), "text"))
        good = pairs.join(verified(pairs.select("a", "b"), both), ["a", "b"]).select(F.col("c").alias("ca"), F.col("o").alias("cb"))
        return both_ways(good)

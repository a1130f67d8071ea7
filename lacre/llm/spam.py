"""Keyword-stuffed and link-list pages.

Each text is cut into segments at line ends and list separators. Links, hashtags and link captions are list evidence by
themselves; short segments without a sentence's end, amounts, dates, long digit runs or encoded tokens are phrases. The
phrases' shingles (five words, or the whole phrase where it is shorter; digits dropped, so numbered variants agree) are
exploded, those of lists included, and their distinct hosts counted over the whole corpus, with partial sums before the
shuffle. Longer segments
count by the repetition of words in windows (keywords written as one run), as phrases divided by full stops, or, where
their line has no sentence's end, by the hosts of their shingles. List density is the page's own evidence: links, tags,
and phrases of a list that are replicated within it (repeated, sharing a word in lines of many phrases, or sharing their
first or last two words); a phrase of a list that nothing on the page repeats needs other hosts, as all phrases do. A page
is flagged if what is replicated, on other hosts or within a list of the page, covers most of it. Only pages whose list
characters could reach the threshold are joined with the host counts.

Defined results: null, empty and blank texts are no cases; a null source is a host of its own for each document; repeated
rows yield one id; texts of any length count whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cases have two thirds of their characters in lists, others at most one third: the middle.
SHARE = 0.5
#: Segments a list has at least.
LIST_SEGMENTS = 4
#: Hosts (this page's own included) from which a phrase counts as replicated elsewhere.
HOSTS = 3
SHINGLE_WORDS = 5
#: Segments of one page that begin or end with the same two words are a list from so many on.
DENSE = 3
#: A line cut into so many segments is a list by itself.
LIST_ROW = 5
#: Longer segments are looked at in windows of so many words; in a run of keywords at most this share of a window's words
#: differ (sentences: mostly 0.65 and more in sf0.1; windows with two full stops are never runs).
WINDOW, RUN_WORDS = 60, 0.5
#: Words a run has at least, and the most records (amounts, dates, numbers) for each word.
RUN_LEAST, RUN_RECORDS = 10, 0.1


class Segments:
    """Cuts a text into segments and tells list evidence from sentences and records."""

    def __init__(self) -> None:
        self.cut = re.compile(r"\s*[|·•;\n\r\t]\s*|\s+(?=#\w)|,\s+| {3,}| [-–—*~>/]+ |</a>\s*").split
        self.link = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|com|net|org|info|br|io)\b(?:[/?#]\S*)?", re.I)
        self.mail = re.compile(r"\S@\S")
        self.tag = re.compile(r"#\w[\w-]*\Z")
        self.record = re.compile(r"\d[.,]\d\d\b|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\b\d+ ?x |\b[0-9a-f]{12,}\b|\S{25,}|\d{5,}|\b[01]{8}\b|R\$|[nN]º ?\d|\d{5}-\d{3}|@")
        self.entry = re.compile(r"\d[.,]\d\d\b|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}")
        self.words = re.compile(r"[^\W\d_]+").findall
        self.stop = re.compile(r"\w\w[.?!][”\"]?(?:\s|$)")
        self.enders = frozenset(".:”\"]?…")

    def phrase(self, segment: str) -> list[str] | None:
        """The words of a keyword phrase, or None for sentences and records."""
        if segment[-1] in self.enders or self.record.search(segment):
            return None
        words = self.words(segment.lower())
        return words if 0 < len(words) <= 9 else None

    def run(self, segment: str) -> tuple[int, int]:
        """Characters and number of keywords of a long segment that stand in windows of few distinct words."""
        tokens = [t for t in segment.split() if len(t) < 25]  # longer ones are encoded
        chars = listed = 0
        cuts = list(range(0, max(1, len(tokens) - WINDOW // 2), WINDOW))
        for a, b in zip(cuts, [*cuts[1:], len(tokens)], strict=True):
            window = tokens[a:b]
            words = self.words(" ".join(window).lower())
            if len(words) >= max(RUN_LEAST, 0.7 * len(window)) and len(set(words)) <= RUN_WORDS * len(words):
                part = " ".join(window)
                if len(self.record.findall(part)) <= RUN_RECORDS * len(words) and len(self.stop.findall(part)) < 2:
                    chars, listed = chars + len(part), listed + len(words) // 2
        return min(chars, len(segment)), listed

    def analyse(self, text: str) -> tuple[int, int, int, Counter, dict, set]:
        """Characters in all, characters of lists that need no other evidence, their number, other phrases with their counts,
        those phrases' characters, and the phrases of the lists, for the host counts alone."""
        total = sure = links = 0
        phrases: Counter = Counter()
        chars: dict = {}
        heads: Counter = Counter()
        lists: set = set()
        rows: dict = {}

        def add(key: tuple, n: int) -> None:
            if key:
                phrases[key] += 1
                chars[key] = chars.get(key, 0) + n
                heads.update(((0, key[:2]), (1, key[-2:])) if len(key) > 2 else ())

        for line in text.splitlines():
            line = line.strip()
            if not line:
                continue
            segments = self.pieces(line)
            row = len(segments) >= LIST_ROW
            prose = line[-1] in self.enders or self.stop.search(line)
            for segment in segments:
                n = len(segment)
                total += n
                if self.tag.match(segment):
                    sure, links = sure + n, links + 1
                elif "." in segment and (found := self.link.findall(segment)) and not self.mail.search(segment) and len(self.words(self.link.sub(" ", segment))) <= 8:
                    sure, links = sure + n, links + len(found)
                elif n <= 90 and (words := self.phrase(segment)):
                    key = tuple(words)
                    if row:
                        times, size = rows.get(key, (0, 0))
                        rows[key] = (times + 1, size + n)
                        continue
                    add(key, n)
                elif n > 40:
                    parts = [x for x in segment.rstrip(".").split(". ") if x.strip()]
                    keys = [(x, k) for x in parts if (k := self.phrase(x))] if n <= 60 * len(parts) else []
                    if len(keys) >= max(LIST_ROW, 0.7 * len(parts)):  # keywords with full stops
                        for x, words in keys:
                            add(tuple(words), len(x))
                        continue
                    area, listed = self.run(segment)
                    sure, links = sure + area, links + listed
                    if area:
                        lists.add(tuple(self.words(segment.lower())))
                    elif not prose and not self.record.search(segment):
                        add(tuple(self.words(segment.lower())), n)
        shared = Counter(w for key in rows for w in set(key))
        for key, (times, size) in rows.items():
            if times > 1 or any(shared[w] > 1 for w in key):
                sure, links = sure + size, links + times
                lists.add(key)
            else:
                phrases[key] += times
                chars[key] = chars.get(key, 0) + size
        for key in [k for k in phrases if len(k) > 2 and (heads[0, k[:2]] >= DENSE or heads[1, k[-2:]] >= DENSE)]:
            sure, links = sure + chars.pop(key), links + phrases.pop(key)
            lists.add(key)
        return total, sure, links, phrases, chars, lists

    def pieces(self, line: str) -> list[str]:
        """A line that ends as a sentence or holds an amount or a date is one piece: its marks separate no list."""
        if (len(line) > 40 and line[-1] in self.enders or self.entry.search(line)) and line.count("|") < 3 and line.count("•") < 3 and line.count("#") < 3 and line.count("://") < 2:
            return [line]
        return [s for x in self.cut(line) if (s := x.strip())]


def shingles(words: tuple, n: int = SHINGLE_WORDS) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def pages(documents: DataFrame) -> DataFrame:
    """(doc_id, host, total, sure, links, phrases): one row a document; phrases: shingle hash, characters, count (0:
    in sure and links already, for the host counts alone)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def analysed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        cutter = Segments()
        item = pa.struct([("shingle", pa.int64()), ("chars", pa.int32()), ("n", pa.int32())])
        hashed: dict = {}

        def key(s: str) -> int:
            if (h := hashed.get(s)) is None:
                if len(hashed) > 200_000:
                    hashed.clear()
                h = hashed[s] = xxhash.xxh64_intdigest(s.encode()) - (1 << 63)
            return h

        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                total, sure, links, phrases, chars, lists = cutter.analyse(text)
                rows = []
                for words, n in phrases.items():
                    parts = shingles(words)
                    rows += [{"shingle": key(s), "chars": chars[words] // len(parts), "n": n} for s in parts]
                rows += [{"shingle": h, "chars": 0, "n": 0} for h in {key(s) for words in lists for s in shingles(words)}]
                for c, v in zip(cols, (total, sure, links, rows), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), *(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.list_(item))],
                ["doc_id", "host", "total", "sure", "links", "phrases"],
            )

    host = F.coalesce(F.lower(F.trim("source")), F.concat(F.lit("?"), F.col("doc_id").cast("string")))
    return (
        documents.where("trim(text) != ''").select("doc_id", F.xxhash64(host).alias("host"), "text")
        .mapInArrow(analysed, f"doc_id {kind}, host long, total int, sure int, links int, phrases array<struct<shingle:long,chars:int,n:int>>")
    )


def scores(documents: DataFrame, hosts: int = HOSTS) -> DataFrame:
    """(doc_id, list_share, segments) of the pages whose list characters could reach the threshold."""
    from lacre.sources.tables import written

    p = written(pages(documents), "spam-pages")
    spread = p.select("host", F.explode("phrases.shingle").alias("shingle")).distinct().groupBy("shingle").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= hosts)
    possible = p.where("total > 0").where(F.col("sure") + F.aggregate("phrases", F.lit(0), lambda a, x: a + x["chars"]) >= SHARE * F.col("total"))
    seen = possible.select("doc_id", "total", "sure", "links", F.inline_outer(F.filter("phrases", lambda x: x["n"] > 0)))
    seen = seen.join(spread, "shingle", "left")
    counts = F.col("hosts").isNotNull() | (F.col("n") > 1)
    return (
        seen.groupBy("doc_id", "total", "sure", "links")
        .agg(F.sum(F.when(counts, F.col("chars")).otherwise(0)).alias("stitched"), F.sum(F.when(counts, F.col("n")).otherwise(0)).alias("listed"))
        .select("doc_id", ((F.col("sure") + F.coalesce("stitched", F.lit(0))) / F.col("total")).alias("list_share"), (F.col("links") + F.coalesce("listed", F.lit(0))).alias("segments"))
    )


def found(documents: DataFrame) -> DataFrame:
    return scores(documents).where((F.col("list_share") >= SHARE) & (F.col("segments") >= LIST_SEGMENTS)).select("doc_id").distinct()

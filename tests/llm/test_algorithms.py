"""Components, history and packing against brute force."""

import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacre.llm import components, history, packing

WORDS = [f"w{i}" for i in range(400)]


def brute_components(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for space, a, b in edges:
        if space is None or a is None or b is None or a == b:
            continue
        x, y = root((space, a)), root((space, b))
        if x != y:
            up[max(x, y)] = min(x, y)
    return sorted((*k, root(k)[1]) for k in up)


@pytest.mark.parametrize(("seed", "per_task"), [(1, 7), (2, 25), (3, 400_000)])
def test_components(spark, seed, per_task):
    rng = random.Random(seed)
    edges = [("A", f"n{i:03}", f"n{i + 1:03}") for i in range(60)]  # a chain
    edges += [("A", "hub", f"m{i:03}") for i in range(60)]  # a hot node
    edges += [(rng.choice("BC"), f"r{rng.randint(0, 90):02}", f"r{rng.randint(0, 90):02}") for _ in range(70)]
    edges += [("A", None, "x"), (None, "a", "b"), ("D", "s", "s")] + edges[:5]
    rng.shuffle(edges)
    got = sorted(tuple(r) for r in components.components(spark.createDataFrame(edges, "space string, a string, b string"), per_task).collect())
    assert got == brute_components(edges)


def test_findings(spark):
    a, b, c = sorted(str(uuid.UUID(int=i << 64)) for i in (1, 2, 3))
    rows = [(1, " dup ", [a, b.upper()]), (1, " dup ", [a, b.upper()]), (2, "DUP", [f"{{{b}}}", f"urn:uuid:{c}"]), (3, "x", [a, a.replace("-", ""), None]), (4, "x", None), (5, "x", []), (6, "x", [f" {a} ", c]), (7, None, [a, b])]
    f = spark.createDataFrame([(*r, "z") for r in rows], "finding_id long, code string, doc_ids array<string>, space string")
    assert {tuple(r) for r in components.found(f).collect()} == {("DUP", a, a), ("DUP", b, a), ("DUP", c, a), ("X", a, a), ("X", c, a)}
    assert components.found(f.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert history.lcs_length(a, b) == table[-1][-1]
    longer = max(len(a), len(b))
    assert history.repeats(a, b) == (longer > 0 and table[-1][-1] >= 0.75 * longer)


def changed(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


def corpus(rng, n=40):
    texts = []
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randint(60, 160))]
        texts.append(base)
        texts += [changed(rng, base, rng.choice((0.0, 0.03, 0.08, 0.12))) for _ in range(rng.randint(0, 2))]
        texts.append(changed(rng, base, 0.6))
    return [" ".join(t) for t in texts]


def arrived(spark, texts, rng, extra=()):
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in texts]
    a = [(d, f"{i:064x}", 10, t if i % 3 else None, None if i % 3 else t.upper(), i, "z") for i, (d, t) in enumerate(zip(ids, texts, strict=True))] + list(extra)
    b = [("b", d.upper() if i % 2 else d, i) for i, d in enumerate(ids)] + [("b", d, i + 500) for i, d in enumerate(ids)]
    analyses = spark.createDataFrame(a, "doc_id string, sha256 string, size_bytes long, native_text string, ocr_text string, pos long, c string")
    batches = spark.createDataFrame(b, "batch_id string, doc_id string, s long").selectExpr("batch_id", "doc_id", "timestamp_seconds(s) event_ts")
    return ids, analyses, batches


def test_history(spark):
    rng = random.Random(11)
    texts = corpus(rng)
    ids, analyses, batches = arrived(spark, texts, rng)
    words = [history.fold(t).split(" ") for t in texts]
    want = set()
    for j in range(len(ids)):
        hit = next((i for i in range(j) if history.repeats(words[i], words[j])), None)
        if hit is not None:
            want.add((min(ids[hit], ids[j]), max(ids[hit], ids[j])))
    got = {tuple(r) for r in history.found(analyses, batches).collect()}
    assert len(want) > 20
    assert len(got & want) >= 0.99 * len(want) and not got - want


def test_history_digests_and_gaps(spark):
    rng = random.Random(2)
    a, b, c, d = (str(uuid.UUID(int=i)) for i in range(1, 5))
    sha = "ab" * 32
    rows = [(a, sha, 5, None, None, 0, "z"), (b.upper(), f"SHA256:{sha.upper()} ", 5, "", " ", 1, "z"), (c, sha, 0, None, None, 2, "z"), (d, sha, 5, None, None, 3, "z"), (a, sha, 5, None, None, 9, "z")]
    _, _, batches = arrived(spark, ["x"], rng)
    batches = spark.createDataFrame([("b", a, 1), ("b", b, 2), ("b", c, 3)], "batch_id string, doc_id string, s long").selectExpr("batch_id", "doc_id", "timestamp_seconds(s) event_ts")
    analyses = spark.createDataFrame(rows, "doc_id string, sha256 string, size_bytes long, native_text string, ocr_text string, pos long, c string")
    assert {tuple(r) for r in history.found(analyses, batches).collect()} == {(a, b)}  # d never arrived, c is empty
    assert history.found(analyses.where("false"), batches).count() == 0
    assert history.found(analyses, batches.where("false")).count() == 0


def test_large_buckets(spark, monkeypatch):
    """A group of near copies above the bucket's bound: every member still finds the first one."""
    monkeypatch.setattr(history, "BUCKET", 8)
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(150)]
    texts = [" ".join(base)] + [" ".join(changed(rng, base, 0.03)) for _ in range(60)]
    ids, analyses, batches = arrived(spark, texts, rng)
    got = {tuple(r) for r in history.found(analyses, batches).collect()}
    assert got == {(min(ids[0], x), max(ids[0], x)) for x in ids[1:]}


def test_texts_of_one_template_seldom_meet(spark):
    """Texts of the same phrases in another order are no candidates; near copies, also of repeated words, are."""
    rng = random.Random(8)
    phrases = [" ".join(f"p{i}w{k}" for k in range(4)) for i in range(45)]
    texts = [" ".join(rng.sample(phrases, 30)) for _ in range(150)] + [" ".join(rng.choice(WORDS[:60]) for _ in range(120)) for _ in range(10)]
    texts += [" ".join(changed(rng, t.split(" "), 0.08)) for t in texts]
    prints = history.fingerprinted(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "i")
    e = prints.select("c", "i").join(history.entries(prints), "c").select("key", "i")
    met = e.join(e.select("key", F.col("i").alias("j")), "key").where("i < j").select("i", "j").distinct()
    met = {tuple(r) for r in met.collect()}
    copies = {(i, i + 160) for i in range(160)}
    assert copies <= met
    assert sum(i % 160 < 150 and j % 160 < 150 for i, j in met - copies) < 300  # of 44,700; by shared words alone they were 2,141


def families(rng, n, words, copies, changes):
    """Families of drifting copies: each copy changes some words of the one before."""
    texts = []
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(words)]
        for _ in range(copies):
            texts.append(" ".join(base))
            base = list(base)
            for i in rng.sample(range(words), changes):
                base[i] = rng.choice(WORDS)
    return texts


def brute(ids, texts, order):
    """The earliest arrived text that each one repeats."""
    want = set()
    for j, b in enumerate(order):
        for a in order[:j]:
            if history.repeats(history.fold(texts[a]).split(), history.fold(texts[b]).split()):
                want.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
                break
    return want


def test_drifting_copies_at_the_edge(spark):
    """What the tables miss at three quarters of the words is found through the texts between."""
    rng = random.Random(12)
    texts = families(rng, 8, 120, 20, 3)
    ids, analyses, batches = arrived(spark, texts, rng)
    want = brute(ids, texts, range(len(texts)))
    got = {tuple(r) for r in history.found(analyses, batches).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.03 * len(want)


def test_history_store(spark, tmp_path):
    """Batch after batch through the store: what one look at all texts finds."""
    rng = random.Random(6)
    texts = families(rng, 6, 100, 6, 4)
    ids, analyses, batches = arrived(spark, texts, rng)
    store = history.HistoryStore(spark, tmp_path.as_uri())
    got = set()
    for part in range(3):
        mine = ids[part * 12 : part * 12 + 12]
        rows = store.add(analyses.where(F.lower("doc_id").isin(mine)), batches.where(F.lower("doc_id").isin(mine)))
        got |= {tuple(r) for r in rows.collect()}
        assert len(store.batches()) == part + 1
    assert got == {tuple(r) for r in history.found(analyses, batches).collect()} == brute(ids, texts, range(len(texts)))
    assert store.stored("documents").count() == 36 and store.stored("keys").count() == store.stored("classes").count() * history.TABLES


def test_history_store_ignores_what_broke_off(spark, tmp_path):
    rng = random.Random(7)
    texts = families(rng, 2, 100, 2, 3)
    ids, analyses, batches = arrived(spark, texts, rng)
    store = history.HistoryStore(spark, tmp_path.as_uri())
    store.add(analyses.where(F.lower("doc_id").isin(ids[:2])), batches.where(F.lower("doc_id").isin(ids[:2])))
    analyses.limit(1).write.parquet(f"{tmp_path}/documents/00000001-broken")
    assert store.stored("documents").count() == 2
    got = store.add(analyses.where(F.lower("doc_id").isin(ids[2:])), batches.where(F.lower("doc_id").isin(ids[2:])))
    assert {tuple(r) for r in got.collect()} == {tuple(sorted(ids[2:]))}


def test_packing(spark):
    rng = random.Random(1)
    sizes = [0, 0, 1, 100, 100, 513] + [rng.randint(1, 90) for _ in range(400)]
    items = spark.createDataFrame([(i, n, 5) for i, n in enumerate(sizes)] + [(2, 1, 5)], "doc_id long, n_tokens long, capacity int")
    kinds = spark.createDataFrame([("small", 100), ("large", 300), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    rows = packing.pack(items, kinds).collect()
    for kind, cap in (("small", 100), ("large", 300)):
        mine = [r for r in rows if r.container_kind == kind]
        whole, fill, docs = {}, {}, {}
        for r in mine:
            whole.setdefault(r.doc_id, []).append(r.n_tokens)
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
            docs[r.container_id] = docs.get(r.container_id, 0) + 1
        cost = {}
        for r in mine:
            cost.setdefault(r.container_id, []).append(r.n_tokens**2)
        assert all(sum(v) <= packing.ATTENTION_SHARE * cap * cap or len(v) == 1 or sum(x > 0 for x in v) == 1 for v in cost.values())
        assert max(fill.values()) <= cap and max(docs.values()) <= cap // packing.TOKENS_PER_DOCUMENT
        for i, n in enumerate(sizes):
            pieces = whole[i] if i != 2 else whole[i][:1]
            assert sum(pieces) == n and (n <= cap or sorted(pieces)[1:] == [cap] * (n // cap)) and (n > cap or len(pieces) == 1)
        assert sum(fill.values()) / (cap * len(fill)) > 0.96  # the document capacity binds among the smallest pieces
        loose = packing.pack(items, kinds, tokens_per_document=4, attention_share=1.0).where(f"container_kind = '{kind}'")
        assert sum(fill.values()) / (cap * loose.select("container_id").distinct().count()) > 0.97
    assert packing.pack(items.where("false"), kinds).count() == 0
    assert {r.container_kind for r in rows} == {"small", "large"}


def test_best_fit_respects_every_capacity():
    where = packing.best_fit([10] * 6, 100, 2, 10_000)
    assert max(list(where).count(w) for w in set(where)) == 2
    where = packing.best_fit([10] * 6, 100, 50, 300)
    assert max(list(where).count(w) for w in set(where)) == 3


def test_large_buckets_of_several_groups(spark, monkeypatch):
    """Groups that share buckets without repeating each other: the same pairs as with no bucket counted as large."""
    rng = random.Random(21)
    base = [f"b{i}" for i in range(100)]
    groups = [changed(rng, base, 0.35) for _ in range(8)]
    texts = [" ".join(changed(rng, groups[i % 8], rng.choice((0.03, 0.06, 0.12)))) for i in range(96)]
    ids, analyses, batches = arrived(spark, texts, rng)
    words = [history.fold(t).split(" ") for t in texts]
    want = {tuple(r) for r in history.found(analyses, batches).collect()}
    assert len(want) > 60
    assert all(history.repeats(words[ids.index(a)], words[ids.index(b)]) for a, b in want)
    monkeypatch.setattr(history, "BUCKET", 6)
    monkeypatch.setattr(history, "HEADS", 1)
    monkeypatch.setattr(history, "BLOCK", 5, raising=False)
    got = {tuple(r) for r in history.found(analyses, batches).collect()}
    assert got == want


def test_links_elsewhere_excuse_no_member_of_a_large_bucket(spark, monkeypatch):
    """Four near copies meet in a large bucket, two and two also in small ones: all find the first of them."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(120)]
    texts = [" ".join(rng.choice(WORDS) for _ in range(120)) for _ in range(10)] + [" ".join(changed(rng, base, 0.02)) for _ in range(4)]
    ids, analyses, batches = arrived(spark, texts, rng)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    c = {r.i: r.c for r in history.fingerprinted(rows, "i").collect()}
    keys = spark.createDataFrame([(1, c[i]) for i in c] + [(2, c[10]), (2, c[13]), (3, c[11]), (3, c[12])], "key long, c long")
    monkeypatch.setattr(history, "entries", lambda prints, *kept: prints.join(keys, "c").select("key", "c", *kept))
    monkeypatch.setattr(history, "BUCKET", 8)
    monkeypatch.setattr(history, "BLOCK", 3, raising=False)
    a, *others = ids[10:]
    assert {tuple(r) for r in history.found(analyses, batches).collect()} == {(min(a, x), max(a, x)) for x in others}


def test_words_are_permuted_by_a_network_too():
    from lacre.llm import pii

    p = pii.Pseudonyms(b"k")
    for v in ("maria da silva", "x", "ana@example.com", "rua " + "das flores " * 40 + "12", "мария"):
        for kind in ("NAME", "EMAIL", "ADDRESS"):
            new = bytes.fromhex(p.tag(v, kind))
            assert p.words(new, kind, back=True).decode() == v and new != v.encode()
    assert p.tag("María  da Silva", "NAME") == p.tag("maria da silva", "NAME") != p.tag("maria da silva", "ADDRESS")
    assert len({p.words(bytes([i, j]), "NAME") for i in range(32) for j in range(256)}) == 32 * 256

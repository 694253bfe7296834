"""The corpus operators on small tables, against brute force, with the odd cases of real tables."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import byte_bpe, decontaminate, graph, html_extract, line_dedup, ngram_jaccard, ngram_lm, packing, quality_rules, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


ODD = [None, "", " \t\n", "\n\n", "one", "One two\x1cthree", "é" * 5 + " ✓ 😀 ok", "a b c d " * 2000, "x" * 50_000]


def passage(rnd, n, vocabulary=2000):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


# ---- quality rules


def counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark):
    rnd = random.Random(1)
    texts = [*ODD, *["\n".join(passage(rnd, rnd.randrange(12), 9) for _ in range(rnd.randrange(8))) for _ in range(60)], "the of " + passage(rnd, 80), "#*$ " * 60]
    df = docs_of(spark, texts).withColumn("kept", F.lit("clash")).withColumn("other", F.lit(1))
    got = {r.doc_id: r for r in quality_rules.quality_rules(df.unionByName(df)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        n, chars, symbols, dup, rep = counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), t
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and (not r.kept or not r.base_failed) and r.other == 1
    assert got[len(texts) - 2].kept and not got[len(texts) - 1].kept
    long = docs_of(spark, [" ".join(f"the{k} of w{k}" for k in range(400_000))])  # no length is too long
    assert [(r.n_words, r.kept) for r in quality_rules.quality_rules(long).collect()] == [(1_200_000, True)]
    assert quality_rules.quality_rules(empty(spark)).count() == 0


# ---- line dedup


def near(a, b):
    """Word edit distance of at most one (none for short lines)."""
    a, b = a.split(" "), b.split(" ")
    if max(len(a), len(b)) < line_dedup.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_lines(texts):
    places = [(d, n, raw, raw.strip(" \t\r")) for d, t in enumerate(texts) for n, raw in enumerate((t or "").split("\n"))]
    out = {}
    for i, (d, n, raw, line) in enumerate(places):
        gone = bool(line) and any(near(line, other) for _, _, _, other in places[:i] if other)
        out.setdefault(d, []).append(None if gone else raw)
    return {d: "\n".join(x for x in rows if x is not None) for d, rows in out.items()}


def test_line_dedup(spark):
    rnd = random.Random(2)
    base = [passage(rnd, rnd.randrange(3, 14), 30) for _ in range(25)] + [passage(rnd, 40, 50), "Page 1 of the manual of the engine", "a b c d e f g a b c d e f g"]
    lines = []
    for _ in range(160):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.choice((0, 0, 1, 1, 2))):
            at, how = rnd.randrange(len(w)), rnd.randrange(3)
            w[at : at + (how > 0)] = [] if how == 2 else [f"n{rnd.randrange(40)}"]
        lines.append(" " * rnd.randrange(2) + " ".join(w))
    texts = [*ODD[:7], *["\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 7))) for _ in range(50)], *[f"Page {i} of the manual of the engine" for i in range(40)], passage(rnd, 3000), passage(random.Random(2), 5)]
    df = docs_of(spark, texts).withColumn("n_removed", F.lit("clash")).withColumn("x", F.lit(1))
    got = {r.doc_id: r for r in line_dedup.line_dedup(df.repartition(5)).collect()}
    want = brute_lines(texts)
    for k, t in enumerate(texts):
        assert (got[k].text is None) == (t is None) and (got[k].text or "") == want[k], (k, t)
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    twice = line_dedup.line_dedup(docs_of(spark, ["same line", None]).unionByName(docs_of(spark, ["same line"]))).collect()
    assert [r.text for r in twice if r.text] == ["same line"] * 2


# ---- decontamination


def brute_contamination(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for i, item in items:
            v = split(item)
            n = min(13, len(v))
            for window in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) == window:
                        hit.update(range(s, s + n))
                        found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_decontaminate(spark):
    rnd = random.Random(3)
    items = [(k, passage(rnd, n, 60)) for k, n in enumerate((40, 13, 12, 5, 3, 1, 20, 20))] + [(100, None), (101, " - "), (102, "Same, Words!"), (103, "same words")]
    items[7] = (7, items[6][1])
    texts = [*ODD, "SAME words."]
    for _ in range(60):
        parts = [passage(rnd, rnd.randrange(0, 50), 60)]
        v = rnd.choice(items)[1] or ""
        w = v.split(" ")
        a = rnd.randrange(len(w))
        parts += [" ".join(w[a : a + rnd.randrange(30)]), passage(rnd, rnd.randrange(60), 60)]
        texts.append(rnd.choice((" ", "\n", "? ")).join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, texts).withColumn("n_hit", F.lit("clash"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(df.repartition(3), bench).collect()}
    for k, want in enumerate(brute_contamination(texts, items)):
        assert got[k] == want, texts[k]
    none = decontaminate.decontaminate(df, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.contaminated for r in none)
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0


# ---- n-gram Jaccard


def brute_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    links = [sum(bool(a and b) and den * len(a & b) >= num * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    return [(len(sets[i]), find(i), links[i]) for i in range(len(sets))]


@pytest.mark.parametrize("width,num,den,block", [(4, 85, 100, 1_000_000), (5, 80, 100, 1_000_000), (4, 85, 100, 300)])
def test_ngram_jaccard(spark, monkeypatch, width, num, den, block):
    rnd = random.Random(4)
    texts = list(ODD)
    for _ in range(25):
        words = passage(rnd, rnd.choice((3, 6, 15, 40, 120, 300))).split(" ")
        for _ in range(rnd.randrange(1, 9)):
            w = list(words)
            for _ in range(rnd.randrange(0, 1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(1000)}"
            texts.append(" ".join(w[rnd.randrange(3) :]))
    shared = passage(rnd, 60)
    texts += [f"{passage(rnd, 100)} {shared}" for _ in range(10)]
    rnd.shuffle(texts)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    df = docs_of(spark, texts).withColumn("n_shingles", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_components(df.repartition(6), width, num, den, count=True).collect()}
    want = brute_components(texts, width, num, den)
    assert max(n for _, _, n in want) > 3
    for k in range(len(texts)):
        assert got[k] == want[k], (k, texts[k])
    if block == 1_000_000:  # the shorter way, without numbers of links
        again = ngram_jaccard.jaccard_components(df, width, num, den).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in again} == {k: w[:2] for k, w in enumerate(want)}


def test_ngram_jaccard_odd_tables(spark):
    assert ngram_jaccard.jaccard_components(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_components(df, count=True).collect())
    assert got == [(0, None, 0), (1, 1, 1), (2, 1, 1), (2, 1, 1)]
    rnd = random.Random(41)
    words = passage(rnd, 200)
    near = [words, words + " end", words + " end", words + " stop"]
    rows = docs_of(spark, near).unionByName(docs_of(spark, near))
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_components(rows, count=True).collect())
    assert got == [(k, 0, 3) for k in range(4) for _ in range(2)]
    with pytest.raises(TypeError):
        ngram_jaccard.jaccard_components(df.withColumn("doc_id", F.lit("x")))


def test_parity_sketch_bounds_the_difference():
    import numpy as np

    rnd = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(rnd.integers(0, 2**63, 400).astype(np.uint64))
        b = np.unique(np.r_[a[rnd.integers(0, 100) :], rnd.integers(0, 2**63, 30).astype(np.uint64)])
        far = int(np.bitwise_count(ngram_jaccard.folded(a) ^ ngram_jaccard.folded(b)).sum())
        assert far <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 8), (20, 21), (22, 21), (30, 30)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys((3, 4, 5, 8, 9), 3), **dict.fromkeys((20, 21, 22), 20), **dict.fromkeys(range(100, 141), 100)}


def test_small_graphs_are_written_as_few_files(spark, monkeypatch):
    parts, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = graph.components(edges).collect()
        few = parts[:]
        monkeypatch.setattr(graph, "PART_EDGES", 1)  # many edges for each part: nothing is drawn together
        assert sorted(graph.components(edges).collect()) == sorted(got) and max(parts[len(few) + 1 :]) >= 40
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.component for r in got} == {0} and len(got) == 31
    assert len(few) > 4 and set(few[1:]) == {1}


# ---- packing


def test_best_fit_decreasing():
    rnd = random.Random(6)
    for length in (1, 2, 7, 64, 100):
        sizes = [rnd.randint(1, length) for _ in range(300)]
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(k for r in rows for k in r) == list(range(300))
        assert all(sum(sizes[k] for k in r) <= length for r in rows)
        free, want = [], []
        for k in sorted(range(300), key=lambda k: (-sizes[k], k)):
            fits = [c for c in free if c >= sizes[k]]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - sizes[k])
            else:
                free.append(length - sizes[k])
        assert len(rows) == len(free)


def test_packing_round_trip(spark):
    rnd = random.Random(7)
    texts = [*ODD, *[passage(rnd, rnd.randrange(1, 400)) for _ in range(40)]]
    df = docs_of(spark, texts)
    packed = packing.pack(df.unionByName(df.where("doc_id = 10")), length=64, shards=3).cache()
    import numpy as np

    for r in packed.collect():
        ids, pos = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == 64 == len(pos) and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == packing.PAD).all()
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert list(pos[a:b]) == list(range(b - a))
    got = Counter((r.doc_id, tuple(r.ids)) for r in packing.unpack(packed).collect())
    want = Counter((r.doc_id, tuple(r.ids)) for r in byte_bpe.encode(df.unionByName(df.where("doc_id = 10"))).collect() if r.n_tokens)
    assert got == want
    assert packing.pack(empty(spark)).count() == 0


def test_packing_query_gives_whole_matrices(spark, tmp_path):
    import numpy as np

    rnd = random.Random(8)
    df = docs_of(spark, [*ODD, *[passage(rnd, rnd.randrange(1, 400)) for _ in range(40)], passage(rnd, 3000)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    packed = packing.query(spark, str(tmp_path)).cache()
    assert {"ids", "cu_seqlens", "positions"} <= set(packed.columns)
    for r in packed.collect():
        ids, pos = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == packing.LENGTH == len(pos) and (ids[r.n_tokens :] == packing.PAD).all()
        want = [k for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for k in range(b - a)]
        assert list(pos) == [*want, *range(packing.LENGTH - r.n_tokens)]
    got = {r.doc_id: tuple(r.ids) for r in packing.unpack(packed).collect()}
    assert got == {r.doc_id: tuple(r.ids) for r in byte_bpe.encode(df).collect() if r.n_tokens}


def test_written_matrices(spark, tmp_path):
    """What ``write`` leaves, read without Spark: every id in its place, positions that start anew, nothing lost; ids of any type."""
    import numpy as np
    import pyarrow.dataset as ds

    rnd = random.Random(81)
    enc, _ = reference()
    texts = [*ODD, *[passage(rnd, rnd.randrange(1, 400)) for _ in range(30)], "no id"]
    df = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("text") == "no id", None).otherwise(F.concat(F.lit("d"), "doc_id")))
    packing.write(packing.pack(df, length=128, shards=3), f"{tmp_path}/m")
    pieces, widths = {}, set()
    rows = ds.dataset(f"{tmp_path}/m", partitioning="hive").to_table().to_pylist()
    for r in rows:
        ids, pos = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["positions"], "<i4")
        widths.add((len(ids), len(pos)))
        for k, (d, n, o) in enumerate(zip(r["doc_ids"], r["doc_nos"], r["offsets"])):
            a, b = r["cu_seqlens"][k], r["cu_seqlens"][k + 1]
            pieces.setdefault((d, r["shard"], n), {})[o] = ids[a:b].tolist()
            assert pos[a:b].tolist() == list(range(b - a))
    got = {d: [i for o in sorted(p) for i in p[o]] for (d, _, _), p in pieces.items()}
    assert widths == {(128, 128)}
    assert got == {(None if t == "no id" else f"d{k}"): enc.encode_ordinary(t) for k, t in enumerate(texts) if t}
    # brute force: the rows themselves, shard by shard
    for s in {r["shard"] for r in rows}:
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["row"])
        sizes = {}
        for r in own:
            for k, piece in enumerate(zip(r["doc_nos"], r["offsets"])):
                sizes[piece] = r["cu_seqlens"][k + 1] - r["cu_seqlens"][k]
        free, want = [], []
        for piece in sorted(sizes, key=lambda p: (-sizes[p], p)):
            fits = [(c, -k) for k, c in enumerate(free) if c >= sizes[piece]]
            if fits:
                least = min(c for c, _ in fits)
                k = max((age[j], j) for j, c in enumerate(free) if c == least)[1]
            else:
                k = len(free)
                free.append(128)
                want.append([])
                if k == 0:
                    age = {}
            free[k] -= sizes[piece]
            age[k] = len(sizes) + sum(map(len, want))  # of equal capacities the latest
            want[k].append(piece)
        assert [list(zip(r["doc_nos"], r["offsets"])) for r in own] == want


# ---- URL filter


def test_url_parts(spark):
    urls = [("HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x"), ("x://h", "h", ""), ("x://h?a/b", "h", ""), ("nope", "", ""), (None, "", ""), ("a://b://c/d", "b:", "//c/d"), ("s://u@h.co.uk:80/p#?", "u@h.co.uk:80", "/p"), ("s://net/\nz", "net", "/\nz")]
    df = spark.createDataFrame([(u,) for u, _, _ in urls], "url string")
    got = df.select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p")).collect()
    assert [(r.h, r.p) for r in got] == [(h, p) for _, h, p in urls]


def test_rules_and_reputation(spark):
    rows = [("x://net/a", "block"), ("x://b.net/a", "block"), ("x://a.example.net/en/1", "allow"), ("x://example.net/de/", "block"), ("x://example.com/de/1", "block"), ("x://w.org/fr/", "allow"), ("x://internet/a", "allow"), ("x://net", "allow"), ("x://spam.com/1", "block"), ("x://new.spam.com/1", None), ("x://fine.com/1", "allow"), (None, "allow"), ("x://w.org/es/", "allow")]
    pages = [(k, u) for k, (u, _) in enumerate(rows)]
    labelled = []
    for k in range(400):
        pages.append((1000 + k, f"x://{'spam' if k % 2 else 'fine'}.com/{k}"))
        labelled.append((1000 + k, k % 2 == 1 and k % 20 != 1))
    p = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    o = spark.createDataFrame([*labelled, labelled[0], (None, True), (7, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.url_filter(p, o).collect()}
    assert len(got) == len(pages)
    for k, (_, want) in enumerate(rows):
        if want:
            assert got[k].verdict == want, rows[k]
    assert got[8].bad_rate > got[9].bad_rate > got[10].bad_rate
    none = url_filter.url_filter(p, o.limit(0))
    assert {r.verdict for r in none.where("rule is null").collect()} == {"allow"}
    assert url_filter.url_filter(p.limit(0), o).count() == 0


# ---- byte-level BPE


def reference():
    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    ranks = byte_bpe.load_ranks(path)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), {r: b for b, r in ranks.items()}


def test_byte_bpe(spark):
    rnd = random.Random(8)
    enc, bytes_of = reference()
    texts = [*ODD[:8], "x" * 3000, "<|endoftext|> it's 12345", *["".join(rnd.choice("aabcdeths é\n\t  xyz1293!!''s漢😀") for _ in range(rnd.randrange(400))) for _ in range(200)]]
    got = {r.doc_id: r for r in byte_bpe.digest(docs_of(spark, texts)).collect()}
    for k, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    df = docs_of(spark, texts).withColumn("n_tokens", F.lit("clash")).withColumn("x y", F.lit(1))
    whole = byte_bpe.decode(byte_bpe.encode(df)).collect()
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") and r["x y"] == 1 for r in whole)
    assert byte_bpe.digest(empty(spark)).count() == 0


def test_byte_bpe_of_one_text_a_partition(spark):
    """A replay without a mergeable pair, and long texts, each alone in its task; repeated rows; a null id."""
    rnd = random.Random(80)
    enc, _ = reference()
    texts = [*ODD, "   ", "\x01\x02", "\x7f", "\x00" * 5, "\t", "é", "漢", passage(rnd, 60_000)]
    df = docs_of(spark, texts)
    for some in [df.where(F.col("doc_id") == k) for k in range(9, len(texts))] + [df.unionByName(df).repartitionByRange(2 * len(texts), "doc_id")]:
        for r in byte_bpe.digest(some).collect():
            ids = enc.encode_ordinary(texts[r.doc_id] or "")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), texts[r.doc_id]
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert byte_bpe.digest(df.unionByName(df)).count() == 2 * len(texts)
    none = byte_bpe.digest(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_tokens) for r in none] == [(None, 2)]


@pytest.mark.parametrize("seed", range(6))
def test_merge_replay_on_any_ranks(seed):
    """Vocabularies in which a merge may bring up a lower rank."""
    rnd = random.Random(seed)
    vocabulary = [bytes([b]) for b in range(256)]
    for _ in range(60):
        new = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5)))
        if new not in vocabulary:
            vocabulary.append(new)
    rnd.shuffle(vocabulary)
    m = byte_bpe.MergeReplay({b: r for r, b in enumerate(vocabulary)})
    words = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(0, 30))) for _ in range(800)]
    assert m.encode(words) == [[m.ranks[w]] if w in m.ranks else m.alone(w) for w in words]


# ---- HTML


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p>a<b>b</b>&amp;&#233; c<br>d", "ab&é c d"),
        ("<article><h1>T</h1><p>One.<p>Two <ul><li>x<li>y</ul></article><footer>no</footer>", "T One. Two x y"),
        ("<nav><a href=1>m</a></nav><script>if (a<b) '</p>'</script><style>p{}</style><main><p>Body text here.</p></main><!-- c --><div class='ad'>buy</div>", "Body text here."),
        ("<div id=page><div class='post'><p>First long paragraph of words.</p><p>Second long paragraph of words.</p></div><div class='comments'><p>Great!</p></div></div>", "First long paragraph of words. Second long paragraph of words."),
        ("<article><p title='a>b'>x</p><aside>no</aside><form><input>no</form></article", "x"),
        ("<div class='with-sidebar'><article><div class='entry-header'><h1>T</h1></div><p>Text.</p></article><div id=sidebar>no</div></div>", "T Text."),
        ("<header>Site</header><section class='cookie-notice'>We use cookies</section><main><h1>T</h1><p>Text.</p><section id='comments'><p>nice</p></section></main>", "T Text."),
        ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def naive_density(node, body):
    """Density and density sum of a block, by recursion over its subtree; no text is marked."""

    def count(x, in_link=False):
        """Characters, tags, characters and tags of links; whether x is or holds a block; the same of what x holds itself."""
        in_link = in_link or x.tag == "a"
        total, own, block = [0] * 4, [0] * 4, x.tag not in html_extract.INLINE | html_extract.VOID
        for k in x.kids:
            if isinstance(k, str):
                n = len(" ".join(k.split()))
                got, inner = [n, 0, n if in_link else 0, 0], False
            else:
                got, _, inner = count(k, in_link)
                got = [got[0], got[1] + (inner or k.tag == "a"), got[2], got[3] + (k.tag == "a")]
            total = [a + b for a, b in zip(total, got)]
            own = own if inner else [a + b for a, b in zip(own, got)]
            block = block or inner
        return total, own, block

    def of(c, t, lc, lt):
        if not c:
            return 0.0
        t, b = max(t, 1), count(body)[0]
        base = math.log(math.log(c / max(c - lc, 1) * lc + b[2] / b[0] * c + math.e) + 1e-9)
        return c / t if base < 0.1 else c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / base

    total, own, _ = count(node)
    kids = [count(k)[0] for k in node.kids if not isinstance(k, str) and count(k)[2]]
    return of(*total), of(*own) + sum(of(*k) for k in kids)


def random_page(rnd, depth=0):
    if depth > 4 or rnd.random() < 0.3:
        words = passage(rnd, rnd.randrange(1, 30))
        return rnd.choice((words, f"<p>{words}</p>", f"<p>{words} <a href=x>{passage(rnd, 3)}</a> <b>x</b></p>", f"<ul><li><a href=1>{passage(rnd, 2)}</a><li>{passage(rnd, 2)}</ul>"))
    tag = rnd.choice(("div", "section", "div", "span"))
    return f"<{tag}>" + "".join(random_page(rnd, depth + 1) for _ in range(rnd.randrange(1, 5))) + f"</{tag}>"


@pytest.mark.parametrize("seed", range(40))
def test_density_against_recursion(seed):
    rnd = random.Random(seed)
    root = html_extract.parse(f"<html><body>{''.join(random_page(rnd) for _ in range(4))}</body></html>")
    found = html_extract.content(root)
    body = next(k for k in root.kids[0].kids if k.tag == "body")
    blocks, stack = [], [body]
    while stack:
        x = stack.pop(0)
        blocks.append(x)
        stack += [k for k in x.kids if not isinstance(k, str) and k.block]
    for x in blocks:
        d, total = naive_density(x, body)
        assert math.isclose(d, x.density, abs_tol=1e-9) and math.isclose(total, x.sum, abs_tol=1e-9)
    best = max(blocks, key=lambda x: naive_density(x, body)[1])
    at = best
    while at is not None and at not in found:
        at = at.parent
    assert at is not None  # the block of the largest sum is content


SPREAD_OUT = (
    "<body><div>" + "".join(f"<div><a href='/{k}'>short item {k}</a></div>" for k in range(30)) + "</div><div><h1>Title</h1>"
    + "".join(f"<p>Paragraph {k} has many words of running text and only <a href=x>one</a> link in it, as articles have.</p>" for k in range(4)) + "</div></body>"
)


def test_density_decides(monkeypatch):
    want = " ".join(["Title", *[f"Paragraph {k} has many words of running text and only one link in it, as articles have." for k in range(4)]])
    assert html_extract.main_text(SPREAD_OUT) == want
    monkeypatch.setattr(html_extract, "density", lambda *counts: 1.0)
    assert html_extract.main_text(SPREAD_OUT) != want


def test_pages_without_article_elements(spark):
    """The article element makes no difference; without any mark on menu, advert and footer, no text is lost and most pages stay equal."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", h) for h in pages]
    bare = [re.sub(r"<(/?)(nav|footer)\b", r"<\1div", h).replace(' class="ad"', "") for h in plain]
    want = [html_extract.main_text(h) for h in pages]
    assert all(want) and [html_extract.main_text(h) for h in plain] == want
    got = [html_extract.main_text(h) for h in bare]
    assert all(w in g for w, g in zip(want, got)) and sum(w == g for w, g in zip(want, got)) >= 0.8 * len(pages)


def test_long_and_repeated_pages(spark):
    body = " ".join(f"<p>{passage(random.Random(k), 40)}.</p>" for k in range(5000))
    df = spark.createDataFrame([(1, "u", f"<body><nav>no</nav>{body}"), (1, "u", "<p>again"), (1, "u", "<p>again")], "page_id long, url string, html string")
    got = sorted(r.text for r in html_extract.extract(df).collect())
    assert got[:2] == ["again", "again"] and got[2] == " ".join(passage(random.Random(k), 40) + "." for k in range(5000))


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<article>a</article>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(map(tuple, html_extract.extract(df).select("page_id", "text", "n_chars").collect())) == [(1, "a", 1), (2, "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


# ---- toxicity


def test_toxicity(spark):
    rnd = random.Random(9)

    def text(toxic):
        s = [passage(rnd, rnd.randrange(4, 12), 400) for _ in range(rnd.randrange(3, 12))]
        if toxic:
            s.insert(rnd.randrange(len(s)), f"you {rnd.choice(('grumbo', 'flarn'))}{rnd.choice(('', 'ish', 'er'))} {passage(rnd, 3, 400)}")
        return ". ".join(s)

    truth = [int(rnd.random() < 0.3) for _ in range(600)]
    df = docs_of(spark, [*map(text, truth), None, ""])
    labels = spark.createDataFrame([(k, t) for k, t in enumerate(truth[:400])] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df.withColumn("score", F.lit("clash")), model).collect()}
    right = sum(got[k].predicted == truth[k] for k in range(400, 600))
    assert right >= 190
    for k in range(400, 600):
        if got[k].predicted and truth[k]:
            assert any("grumbo" in s or "flarn" in s for s in got[k].offending)
    assert got[600].score == got[601].score < 0.5
    nothing = toxicity.train(df, labels.where("toxic = 0"))
    assert all((r.predicted, r.score) == (0, 0.0) for r in toxicity.score(df, nothing).collect())
    assert toxicity.train(df.where("doc_id is null"), labels)[0] == {} and toxicity.score(empty(spark), model).count() == 0
    twice = df.where("doc_id = 3")
    other = twice.withColumn("text", F.lit("zzz other text"))
    assert toxicity.train(df.unionByName(other).repartition(7), labels) == toxicity.train(other.unionByName(df), labels)


def test_toxicity_against_plain_scores(spark):
    """Noisy-or over sentences, written out; long texts, repeated rows, odd texts."""
    rnd = random.Random(90)
    weights = {f"w{k}": rnd.uniform(-2, 2) for k in range(0, 200, 3)} | {"^w1": 0.3, "one": 4.0}
    texts = [*ODD, *[". ".join(passage(rnd, rnd.randrange(1, 9), 200) for _ in range(rnd.randrange(1, 9))) for _ in range(40)], passage(rnd, 50_000), "W7! w9?\nw10"]

    def plain(text):
        none = 1.0
        for s in re.split(r"[.!?\n]", (text or "").lower()):
            words = re.findall(r"[^\W_]+", s)
            if words or not re.search(r"[^\W_]", text or ""):
                z = -3.0 + sum(weights.get(w, 0.0) + sum(weights.get("^" + w[:k], 0.0) for k in range(3, min(len(w), 6) + 1)) for w in words)
                none *= 1 - 1 / (1 + math.exp(-z)) if z > -700 else 1.0
            if not re.search(r"[^\W_]", text or ""):
                break
        return 1 - none

    df = docs_of(spark, texts)
    for r in toxicity.score(df.unionByName(df), (weights, -3.0)).collect():
        assert math.isclose(r.score, plain(texts[r.doc_id]), abs_tol=1e-9), texts[r.doc_id]
        assert r.predicted == int(r.score >= 0.7)


# ---- extra columns

NAMES = ["_kept", "kept2", "_r", "r", "a.b", "_key", "_t", "_found", "_w", "_words", "_lines", "n", "w", "place", "lines", "x`y", "a b"]


@pytest.mark.parametrize("run", ["line_dedup", "decontaminate", "quality_rules", "encode", "score_lm", "toxicity", "extract", "url_filter"])
def test_extra_columns_stay(spark, run):
    bench = spark.createDataFrame([(1, passage(random.Random(1), 20))], "item_id long, text string")
    calls = {
        "line_dedup": line_dedup.line_dedup,
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "quality_rules": quality_rules.quality_rules,
        "encode": byte_bpe.encode,
        "score_lm": lambda d: ngram_lm.score(d, ngram_lm.train(d)),
        "toxicity": lambda d: toxicity.score(d, ({"a": 1.0}, -1.0)),
        "extract": html_extract.extract,
        "url_filter": lambda d: url_filter.url_filter(d.withColumnsRenamed({"doc_id": "page_id", "text": "url"}), outcomes).withColumnsRenamed({"page_id": "doc_id", "url": "text"}),
    }
    outcomes = spark.createDataFrame([(1, True)], "page_id long, bad boolean")
    df = docs_of(spark, [passage(random.Random(1), 60), None, "a b", "a b"])
    if run == "extract":
        df = df.withColumnRenamed("text", "html")
    quoted = ["`" + n.replace("`", "``") + "`" for n in NAMES]
    for n in NAMES:
        df = df.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    out = calls[run](df)
    assert out.columns[: len(df.columns)] == df.columns or run in ("score_lm", "extract")  # the text is used up
    rows = out.select("doc_id", *quoted).collect()
    assert len(rows) == 4 and all(list(r)[1:] == [n + str(r.doc_id) for n in NAMES] for r in rows)


def test_line_dedup_of_many_lines_of_one_template(spark):
    """Distinct lines that share all deletion keys but one word: the first stays, no pairs are made."""
    n = 100_000
    lines = spark.range(n, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit("User "), F.col("id"), F.lit(" logged in to the console from the office")).alias("text"))
    got = line_dedup.line_dedup(lines).agg(F.sum("n_removed"), F.min(F.when(F.col("n_removed") == 0, F.col("doc_id")))).first()
    assert tuple(got) == (n - 1, 0)

"""The language model against a plain one, the pipeline against brute force, and the registered queries."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import ngram_jaccard, ngram_lm
from lorekeep.llm.queries import ORACLE_SQL, QUERIES

from .test_text_ops import LOWER, ODD, WORD, brute_components, brute_contamination, brute_lines, counts, docs_of, empty, passage, reference

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_model(texts):
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), "end of text"]
    words, pairs = Counter(), Counter()
    for t in texts:
        w = tokens(t)
        words.update(w)
        pairs.update(zip(["begin of text", *w], w))
    tally = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    d2, before = ngram_lm.discounts(*tally(pairs.values())), Counter(w for _, w in pairs)
    d1 = ngram_lm.discounts(*tally(before.values()))
    total, taken = Counter(), defaultdict(float)
    for (v, _), n in pairs.items():
        total[v] += n
        taken[v] += d2[min(n, 3) - 1]
    n_pairs, types = len(pairs), len(words)
    g1 = sum(d1[min(n, 3) - 1] for n in before.values()) / n_pairs if n_pairs else 1.0

    def p(v, w):
        low = g1 / (types + 1) + ((before[w] - d1[min(before[w], 3) - 1]) / n_pairs if w in before else 0)
        if v not in total:
            return low
        n = pairs.get((v, w), 0)
        return taken[v] / total[v] * low + ((n - d2[min(n, 3) - 1]) / total[v] if n else 0)

    def score(t):
        w = tokens(t)
        base = sum(math.log10((words[x] + 1) / (sum(words.values()) + types + 1)) for x in w)
        return len(w), sum(x in words for x in w), sum(words.values()), base, sum(math.log10(p(v, x)) for v, x in zip(["begin of text", *w], w))

    return score, p, words


@pytest.mark.parametrize("size", [0, 1, 60])
def test_ngram_lm(spark, size):
    rnd = random.Random(size)
    train = [*ODD[:8], *[passage(rnd, rnd.randrange(40), 50) for _ in range(50)], "a b " * 400][:size]
    texts = [*ODD, "a b a b", "never seen words", *[passage(rnd, rnd.randrange(40), 60) for _ in range(20)]]
    model = ngram_lm.train(docs_of(spark, train).repartition(3), order=2)
    want, p, words = plain_model(train)
    df = docs_of(spark, texts).withColumn("score", F.lit("clash")).withColumn("x", F.lit(1))
    for r in ngram_lm.score(df.unionByName(df), model).collect():
        n, known, total, base, own = want(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.x) == (n, known, total, 1)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, own, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-own / n), rel_tol=1e-9)
    if size > 1:
        unseen = p("a", "not a word")
        assert math.isclose(sum(p("a", w) for w in words) + unseen, 1.0)
    assert ngram_lm.score(empty(spark), model).count() == 0


def plain_scores(texts, asked, order):
    """Log10 scores by the recursion over all levels, with distinct predecessors counted as sets."""
    tokens = lambda t: [*["begin of text"] * (order - 1), *WORD.findall((t or "").translate(LOWER)), "end of text"]
    counts, types = {order: Counter()}, set()
    for t in texts:
        w = tokens(t)
        types.update(w[order - 1 :])
        counts[order].update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: ngram_lm.discounts(*[sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]) for k, c in counts.items()}
    total, taken = Counter(), defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            total[g[:-1]] += n
            taken[g[:-1]] += d[k][min(n, 3) - 1]

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1 / (len(types) + 1)
        n = counts[len(g)][g]
        return taken[g[:-1]] / total[g[:-1]] * low + ((n - d[len(g)][min(n, 3) - 1]) / total[g[:-1]] if n else 0) if total[g[:-1]] else low

    return [sum(math.log10(p(tuple(w[i - order + 1 : i + 1]))) for i in range(order - 1, len(w))) for w in map(tokens, asked)], p, types


@pytest.mark.parametrize("order", [2, 3, 4])
def test_ngram_lm_of_any_order(spark, order):
    rnd = random.Random(order)
    train = [*ODD[:8], *[passage(rnd, rnd.randrange(40), 12) for _ in range(60)], "a b c " * 400, "x b c"]
    texts = [*ODD, "a b c a b", "x b c", "never seen words", *[passage(rnd, rnd.randrange(40), 14) for _ in range(20)]]
    want, p, types = plain_scores(train, texts, order)
    model = ngram_lm.train(docs_of(spark, train).repartition(3), order)
    for r in ngram_lm.score(docs_of(spark, texts), model).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-9)
    assert math.isclose(sum(p((*["a", "b", "c"][-order + 1 :], w)) for w in types) + p((*["a", "b", "c"][-order + 1 :], "not a word")), 1.0)


def test_query_models_trigrams(spark, tmp_path):
    texts = [f"{'a' if k % 2 else 'b'} link {'c' if k % 2 else 'd'}" for k in range(60)]
    docs = docs_of(spark, texts).select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, _, _ = plain_scores([t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2], texts, 3)
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in ngram_lm.query(spark, str(tmp_path)).collect())


def test_large_counts_are_kept(spark):
    texts = ["x y " * 1000, "x z"]
    model = ngram_lm.train(docs_of(spark, texts), order=2)
    want, _, _ = plain_model(texts)
    got = ngram_lm.score(docs_of(spark, texts), model).collect()
    assert all(math.isclose(r.score, want(texts[r.doc_id])[4], rel_tol=1e-9) for r in got)


def test_parts_follow_the_text_and_a_lost_array_fails(spark, monkeypatch):
    from lorekeep.llm.shared_arrays import SharedArrays

    monkeypatch.setattr(ngram_lm, "PART_CHARS", 500)
    rnd = random.Random(12)
    texts = [passage(rnd, 60, 300) for _ in range(40)]
    model = ngram_lm.train(docs_of(spark, texts))
    assert model.parts > 20 and model.order == ngram_lm.ORDER == 3
    want, _, _ = plain_scores(texts, texts, 3)
    scorer = ngram_lm.Scorer(model)
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(scorer.score(texts)[3], want))
    level, part = next((k, p) for k, p in sorted(model.written) if k == "3")
    os.remove(f"{SharedArrays(model.uri).folder}/b{level}-{part}-key.npy")
    with pytest.raises(FileNotFoundError):
        ngram_lm.Scorer(model).score(texts)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_rounds_give_the_same_model_and_leave_only_its_arrays(spark, monkeypatch, order):
    from lorekeep.llm.shared_arrays import SharedArrays

    rnd = random.Random(order)
    texts = [*ODD[:8], *[passage(rnd, 60, 200) for _ in range(60)], "a b c " * 400]
    whole = ngram_lm.train(docs_of(spark, texts).repartition(3), order)
    monkeypatch.setattr(ngram_lm, "ROUND_CHARS", 500)
    monkeypatch.setattr(ngram_lm, "COUNT_TOKENS", 700)
    model = ngram_lm.train(docs_of(spark, texts).repartition(3), order)
    assert model.parts == 8 * ngram_lm.ROUNDS > whole.parts and (model.tokens, model.types, model.d_gram, model.d_word) == (whole.tokens, whole.types, whole.d_gram, whole.d_word)
    want, _, _ = plain_scores(texts, texts, order)
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(ngram_lm.Scorer(model).score(texts)[3], want))
    names = os.listdir(SharedArrays(model.uri).folder)
    assert names and all(n[0] in "buvw" for n in names)


def test_arrays_are_small(spark):
    from lorekeep.llm.shared_arrays import SharedArrays

    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(400)) for _ in range(500)]
    model = ngram_lm.train(docs_of(spark, texts))
    folder = SharedArrays(model.uri).folder
    size = {k: sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.startswith(k)) for k in ("b3", "v3")}
    words = [["", "", *t.split(), "."] for t in texts]
    grams = len({g for w in words for g in zip(w, w[1:], w[2:])})
    heads = len({g for w in words for g in zip(w, w[1:-1])})
    # before: 9 bytes of an n-gram, 24 of a context
    assert size["b3"] < 8 * grams and size["v3"] < 10 * heads


def test_keys_without_their_top_bits(tmp_path):
    import numpy as np

    from lorekeep.llm.shared_arrays import SharedArrays

    rnd, store = np.random.default_rng(1), SharedArrays(str(tmp_path))
    for n, mask in ((0, -1), (1, -1), (1000, -1), (1000, 0xFFFF0003000000FF), (1000, 0xFFFF)):
        draw = lambda n: rnd.integers(0, 1 << 64, n, dtype=np.uint64)
        keys = np.unique(draw(n) & np.uint64(mask & 0xFFFFFFFFFFFFFFFF))
        ngram_lm.write_keys(store, "x", keys)
        asked = np.concatenate([keys, keys + np.uint64(1), draw(300)])
        at = ngram_lm.places(store.read("x-key"), store.read("x-at"), asked)
        there = np.isin(asked, keys)
        assert ((at >= 0) == there).all() and (keys[at[there]] == asked[there]).all()
    stats = np.concatenate([rnd.integers(0, 4, (500, 4)), [[1 << 40, 1, 2, 3], [70_000, 0, 0, 1]]])
    code, kinds = ngram_lm.coded(stats)
    assert (kinds[code] == stats).all() and len(kinds) < 300


def test_words_are_hashed_alike():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(8)
    texts = [*ODD, " \t\x0b a\x0c\rB \n", "\u00a0x\u2003y \x1c z", "Ä É İ", *[passage(rnd, rnd.randrange(40), 50) for _ in range(30)]]
    texts = [None if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()), pa.array(["cut", *texts]).slice(1)):
        for most in (1, 300, 1 << 20):
            got = [ngram_lm.hashed_words(x) for x in ngram_lm.pieces(column, most)]
            want = [ngram_jaccard.word_hashes(t) for t in texts]
            assert np.concatenate([n for _, n in got]).tolist() == [len(w) for w in want]
            assert (np.concatenate([h for h, _ in got]) == np.concatenate(want)).all()


def test_fold(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 17, 123456789)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.f for r in df.select("doc_id", ngram_lm.fold(F.col("doc_id"), 7).alias("f")).collect()}
    assert all(f == zlib.crc32((str(i) if i is not None else "").encode()) % 7 for i, f in got.items())


def corpus(rnd):
    stop = "the of and to in is that for it with".split()
    line = lambda n=25: " ".join(rnd.choice(stop) if rnd.random() < 0.3 else f"w{rnd.randrange(4000)}" for _ in range(n))
    docs = ["\n".join(line(rnd.randrange(15, 40)) for _ in range(rnd.randrange(3, 7))) for _ in range(40)]
    footer = line(12)
    docs += [d + "\n" + footer for d in docs[:6]] + [docs[0], docs[1].replace("w", "v", 1)]
    docs += ["\n".join(" ".join([*x.split(" ")[:3], "new", *x.split(" ")[3:], "one", "more"]) for x in d.split("\n")) for d in docs[5:12]]
    items = [(k, line(30)) for k in range(5)]
    docs += [f"{docs[20 + k]}\n{items[k][1]}" for k in range(5)] + ["#$% " * 80, "short", None, "", "a b c " * 100]
    return docs, items


def brute_pipeline(texts, items):
    from lorekeep.llm import quality_rules as q

    docs = {}
    for k, t in enumerate(texts):
        n, chars, symbols, dup, rep = counts(t)
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        v = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_lines": len(lines), "n_stop_words": sum(x in q.STOP_WORDS.split() for x in w), "n_bullet_lines": 0, "n_ellipsis_lines": 0}
        ok = all((not r.low or (d := v[r.denominator] if r.denominator else 1) == 0 or v[r.numerator] * r.low[1] >= d * r.low[0]) and (not r.high or (d := v[r.denominator] if r.denominator else 1) == 0 or v[r.numerator] * r.high[1] <= d * r.high[0]) for r in q.RULES)
        if n >= 50 and 100 * rep <= 50 * n and ok:
            docs[k] = t
    ids = list(docs)
    lines = brute_lines([docs[k] for k in ids])
    docs = {k: lines[n] for n, k in enumerate(ids) if lines[n].strip()}
    ids = list(docs)
    groups = brute_components([docs[k] for k in ids], 5, 80, 100)
    docs = {k: docs[k] for n, k in enumerate(ids) if groups[n][1] == n}
    bad = brute_contamination(list(docs.values()), items)
    docs = {k: t for (k, t), b in zip(docs.items(), bad) if not b[4]}
    enc, _ = reference()
    return {k: (len(i := enc.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, t in docs.items()}


def test_pipeline(spark, tmp_path):
    texts, items = corpus(random.Random(11))
    rows = [(k, t, "en", "s", None if t is None else len(t), "mine") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute_pipeline(texts, items)
    assert 0 < len(want) < 50 and got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert {r.kept for r in out.collect()} == {"mine"}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_duplicate_stage_shuffles_no_text(spark, monkeypatch):
    rnd = random.Random(12)
    texts = [passage(rnd, 80) for _ in range(12)]
    df = docs_of(spark, texts + [f"{t} end" for t in texts[:4]])
    before, joins = ngram_jaccard.cut, []
    monkeypatch.setattr(ngram_jaccard, "cut", lambda d, *a: joins.append(d._jdf.queryExecution().sparkPlan().toString()) or before(d, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_duplicate_stage(spark, df, "")
        plans = [out._jdf.queryExecution().sparkPlan().toString(), *[p for p in joins if "FlatMapGroupsInArrow" in p and "copies" in p]]
        assert sorted(r.doc_id for r in out.collect()) == list(range(12))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 2 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(map(repr, map(tuple, df.select(columns).collect())))
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        assert got == Counter(map(repr, con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()))
    else:
        assert sum(got.values()) > 0

"""Operators over whole tables, against brute force and held-out rows."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from redebit.llm import jaccard_join, mixing, packing, quality_model, topk_search, toxicity
from tests.llm import fixtures

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.documents(spark).cache()


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_is_an_exact_round_trip(spark, docs, capacity):
    import zlib

    packed = packing.pack_documents(docs, capacity=capacity)
    got = packed.collect()
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        own = TOKENIZER.encode(r.text or "", add_special_tokens=False).ids + [packing.CLOSING_ID]
        ids.setdefault(r.doc_id, []).append(own)
    spans = {}
    for r in got:
        assert 0 < r.length <= capacity
        fits = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        crc = lambda x: zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
        assert any(crc(x) == r.ids_crc32 for x in fits)
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) for xs in ids.values() for x in xs)
    for own in spans.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(spans) == list(range(len(spans)))
    assert packing.padding(packed, capacity).first().tokens == sum(r.length for r in got)
    assert packing.pack_documents(fixtures.empty(spark)).count() == 0


def test_shortest_pack_first_places_everything():
    rng = np.random.default_rng(5)
    histogram = [(int(k), int(n)) for k, n in zip(range(1, 101), rng.integers(0, 50, 100)) if n]
    filled, taken = {}, {}
    for length, rank, count, first, offset in packing.shortest_pack_first(histogram, 100):
        assert taken.get(length, 0) == rank
        taken[length] = rank + count
        for s in range(first, first + count):
            assert filled.get(s, 0) == offset
            filled[s] = offset + length
    assert taken == dict(histogram) and max(filled.values()) <= 100


def test_tokenizer_cache_survives_being_emptied(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ROWS", 3)
    own = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    texts = ["One two. three, one", "x" * 100 + " Two don't", "é. Ünï, a\x1cb <|endoftext|>."]
    want = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(texts)] == want


def test_mixing_equals_sql(spark, docs):
    frame = docs.select("doc_id", "text", "source").toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(mixing.ORACLE).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r) for r in mixing.mix(docs).select(*names).collect()]
    key = lambda r: tuple(str(c) for c in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert mixing.mix(fixtures.empty(spark)).count() == 0


def test_mixed_rows_are_taken_as_often_as_reported(spark, docs):
    report, mixed = mixing.mix(docs).collect(), mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.where(mixing.n_words(mixed.text) > 0).count() == sum(r.taken // r.size for r in report if r.size)
    assert all(r.taken <= 3 * r.size for r in report)


def test_targets_are_capped_and_reshared(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 10), ("b", 1), ("c", 1000), (None, 5)])]
    got = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert sum(r.target for r in got.values()) == pytest.approx(1016)
    assert got["b"].target == 3 and got["a"].target == 30 and got[None].target == 15


def brute_components(pairs_of):
    sets = [set(s) for s in pairs_of]
    n = len(sets)
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(n)]
    seen, label = set(), [None] * n
    for i in range(n):
        if i not in seen:
            todo, own = [i], []
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    own.append(x)
                    todo += link[x]
            for x in own:
                label[x] = own
    return link, label


def shingle_list(text):
    words = (text or "").encode().lower().split()
    return [tuple(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [tuple(words)] if words else []


def test_words_of_a_batch_are_hashed_together():
    draw = random.Random(5)
    parts = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "a", "A", "É", "é", "\0", "x" * 9, "y" * 64, "z" * 65]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(2000)] + ["", " "]
    codes, ends = jaccard_join.word_codes(pa.array(["zz", *texts]).slice(1))
    words = [t.encode().lower().split() for t in texts]
    assert np.diff(ends).tolist() == [len(w) for w in words]
    known = {}
    for word, code in zip(sum(words, []), codes.tolist()):
        assert known.setdefault(word, code) == code
    assert len(set(known.values())) == len(known)
    whole = [every.tolist() for _, every in jaccard_join.shingled(pa.array(texts), 3)]
    assert whole == [next(jaccard_join.shingled(pa.array([t]), 3))[1].tolist() for t in texts]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_jaccard_join_equals_brute_force(spark, docs, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
        monkeypatch.setattr(jaccard_join, "HEAVY", 2)
    rows = docs.select("doc_id", "text").collect()
    link, label = brute_components([shingle_list(r.text) for r in rows])
    ids = lambda own: [rows[x].doc_id for x in own if rows[x].doc_id is not None]
    want = sorted(
        (str(r.doc_id), len(set(shingle_list(r.text))), min(ids(label[i]), default=None), len(link[i])) for i, r in enumerate(rows)
    )
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join_documents(docs).collect())
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


def test_links_survive_shared_passages_of_two_depths(spark):
    draw = np.random.default_rng(7)
    # Common words, so that the words of the shared passages are rarer and stand first in every prefix.
    body = [f"w{i}" for i in draw.integers(0, 60, 902)]
    shared, second = [f"h{i}" for i in range(50)], [f"p{i}" for i in range(60)]

    def copy(i, *more):
        return " ".join(sum(more, body) + [f"own{i}"])

    texts = [" ".join(body)] + [copy(i, shared) for i in range(6)] + [copy(i, shared, second) for i in range(6, 13)]
    texts += [" ".join([f"x{i}.{j}" for j in range(200)] + shared) for i in range(12)]
    link, label = brute_components([shingle_list(t) for t in texts])
    assert len(link[0]) == 6 and sorted(label[0]) == list(range(14))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.join_documents(docs).collect()}
    assert got == {i: (min(label[i]), len(link[i])) for i in range(len(texts))}


def test_the_last_round_of_indexing_asks_for_no_more_heavy_tokens(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY_ROUNDS", 1)
    asked, either = [], jaccard_join.either
    monkeypatch.setattr(jaccard_join, "either", lambda *maps: asked.append(maps) or either(*maps))
    jaccard_join.index(docs, 3)
    assert len(asked) == 5  # heavy, keys, texts, tokens of the fresh prefixes, possible tokens


def test_the_join_sends_small_batches_to_python(spark, docs):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    jaccard_join.joined(docs, 3)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], names=["n"])

    assert spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").groupBy().max("n").first()[0] <= 1000


def test_empty_blocks_add_no_links(spark):
    sets = [np.arange(k, 100 + k, dtype=np.uint64).tobytes() for k in range(3)]
    near = [(b"t", side, bytes([i]), 1, sets[i]) for side, i in ((2, 0), (2, 1), (2, 2))]
    alone = [(t, side, bytes([i]), 1, sets[i]) for t, side in ((b"u", 0), (b"v", 1)) for i in range(3)]
    tasks = "task binary, side int, key binary, copies long, set binary"
    got = jaccard_join.count_links(spark.createDataFrame(near + alone, tasks)).groupBy("key").sum("links").collect()
    assert {bytes(r.key)[0]: r[1] for r in got} == {0: 2, 1: 2, 2: 2}


def test_links_of_a_family_with_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 100)
    base = fixtures.prose(1, 400)
    texts = [fixtures.swapped(base, i, 1) for i in range(3)]
    link, _ = brute_components([shingle_list(t) for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard_join.join_documents(docs).collect()}
    assert got == {i: len(own) for i, own in enumerate(link)} == {0: 2, 1: 2, 2: 2}


def test_one_of_each_keeps_one_row_of_a_component(spark, docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = docs.select("doc_id", "text").collect()
    _, label = brute_components([shingle_list(r.text) for r in rows])
    groups = {tuple(own) for own in label}
    assert kept.count() == len(groups)
    assert jaccard_join.one_of_each(fixtures.empty(spark)).count() == 0
    assert jaccard_join.join_documents(fixtures.empty(spark)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 6).round(1).tolist(), 1) for i in range(130)]
    rows += [(20, [0.5] * 6, 1), (40, None, 1), (60, [None] + [0.1] * 5, 1), (80, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (61, [float("inf")] * 6, 0), (62, [0.4, 0.4], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.floor(64 * np.float32(v).astype(float))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for a, (i, v) in enumerate(good):
        if i % 20 == 0:
            scores = sorted((-int(v[: len(w)] @ w[: len(v)]), j) for b, (j, w) in enumerate(good) if a != b)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    got = [tuple(r) for r in topk_search.top_k(vectors.repartition(3)).collect()]
    assert sorted(got) == sorted(want)
    few = topk_search.top_k(vectors.where("vec_id < 5 AND embedding IS NOT NULL"))
    assert few.count() == 4
    assert topk_search.top_k(vectors.limit(0)).count() == 0


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(spark, scored, labels, column):
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", column).collect()
    return np.array([r[column] for r in rows]), np.array([r.score for r in rows]), np.array([r.predicted for r in rows])


def test_quality_model_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_model.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    y, s, _ = held_out(spark, scored, labels, "quality")
    assert auc(y, s) > 0.9
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_class_prior_of_mixtures():
    rng = np.random.default_rng(4)
    positive = rng.normal(2, 1, 5000)
    mixed = np.concatenate([rng.normal(2, 1, 3500), rng.normal(-2, 1, 1500)])
    assert abs(quality_model.class_prior(positive, mixed) - 0.7) < 0.06


def test_models_take_odd_rows(spark, docs):
    labels = fixtures.labels(spark)
    for score in (quality_model.quality_scores, toxicity.toxicity_scores):
        got = score(docs, labels)
        assert got.count() == docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert score(docs, labels.limit(0)).count() == docs.count()
        assert score(fixtures.empty(spark), labels).count() == 0


def test_toxicity_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    y, s, p = held_out(spark, toxicity.toxicity_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels), labels, "toxic")
    assert auc(y, s) > 0.95 and (p == y).mean() > 0.97


def test_obfuscated_words_are_restored():
    words = {w: 5.0 for w in ("idiot", "stupid", "moron", "trash")}
    model = toxicity.LetterModel.of([], words)
    for seen, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("s.t.u.p.i.d", "stupid"), ("stuuupid", "stupid"), ("$tupid!", "stupid"), ("m*r*n", "moron"), ("s*t*u*p*i*d", "stupid")):
        assert toxicity.restored(seen, model) == meant
    assert toxicity.restored("ordinary", model) is None and toxicity.restored("4587121519400672", model) is None
    assert toxicity.spelled("you i d i o t here") == ["i.d.i.o.t"]


def test_long_runs_and_dense_signs_are_restored():
    words = {f"={w}": 5.0 for w in ("idiot", "stupid", "moron")}
    text = " ".join(["you are an idiot and the others here are not so stupid at all"] * 50)
    codes = toxicity.CODES[np.frombuffer(f" {text} ".encode(), np.uint8)]
    tri = np.bincount((codes[:-2] * 28 + codes[1:-1]) * 28 + codes[2:], minlength=28**3)
    counts = toxicity.LetterModel(tri.astype(float))
    weights = toxicity.Weights(words, counts)
    assert toxicity.restored("5tup1d", counts) == "stupid" and toxicity.restored("stuupid", counts) == "stupid"
    assert toxicity.restored("57up1d", counts) == "stupid" and weights["57up1d"] == weights["stuupid"] == 5.0
    run = " ".join("youareanidiot")
    assert toxicity.restored(toxicity.spelled(run)[0], counts) == "you are an idiot"
    for spelled_out in (run, " ".join("youareanidiotandtheothersherearenotsostupidatall")):
        assert toxicity.summary(spelled_out, weights)[0] == 5.0
    assert toxicity.restored("stuupid", counts, frozenset({"stuupid"})) is None


def test_trie_skips_only_words_that_weigh_nothing():
    rng = np.random.default_rng(5)
    words = {"=idiot": 5.0, "=stupid": 4.0, "moro*": 3.0, "=ass": 3.0, "trash*": 2.5, "=a1b": 9.0, "=x=y": 9.0}
    model = toxicity.LetterModel.of([], {k[1:]: w for k, w in words.items() if k.isalpha() or k[0] == "=" and k[1:].isalpha()})
    weights = toxicity.Weights(words, model)
    seeds = ["idiot", "stupid", "moronic", "trashy", "ass", "harmless", "class", "weather"]
    swap = {"i": "1!|", "o": "0", "s": "5$", "a": "4@*", "t": "7+", "e": "3"}
    found = 0
    for _ in range(4000):
        word = str(rng.choice(seeds))
        out = []
        for c in word:
            c = str(rng.choice(list(swap[c]))) if c in swap and rng.random() < 0.4 else c
            out.append(c * int(rng.choice([1, 1, 1, 2, 3])))
        raw = (rng.choice(["", "", ".", "-", "*"])).join(out)
        if rng.random() < 0.3:
            at = int(rng.integers(0, len(raw) + 1))
            raw = raw[:at] + str(rng.choice(list("._-~*é9x"))) + raw[at:]
        want = max(map(weights.of, [toxicity.plain(raw), "", *toxicity.behind(raw, model)]))
        assert weights[raw] == want, raw
        found += want > 0
    assert 1000 < found < 4000
    assert weights["idi0t" * 400_000] == 0.0 and weights.chars < 64 * 5000  # long words are not remembered

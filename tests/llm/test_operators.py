from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from shelfmark.llm import bpe, class_lm, components, exact_dedup, fingerprints, langid, mixing, near_dedup, sharding, store, substring_dedup, textkit, url_filter

from . import corpus

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def rows():
    return corpus.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return corpus.frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


def clashing(docs):
    """Columns with the names that operators use inside."""
    names = "p size tag range digest band rep found h d label hub gone key lang_pred found_lang found_score _gone _digest _keep_id _tag _key _id _times _n _row _take _lang _score component_id kept".split()
    return docs.selectExpr("*", *[f"'{i}' AS {n}" for i, n in enumerate(names)])


def same_columns(out, docs):
    """All columns of the clashing table are there with their own values."""
    wide = clashing(docs)
    assert out.columns == wide.columns
    first = wide.drop(*docs.columns).first()
    assert all(r == first for r in out.drop(*docs.columns).distinct().collect())


# words


def test_words_and_hashes():
    texts = ["a bb\tccc", "", None, " x ", "é\x0bB  b", "end"]
    w = textkit.words(pa.array(texts))
    assert w.counts.tolist() == [len(corpus.words(t)) for t in texts]
    assert len(set(w.hashes.tolist())) == len({x for t in texts for x in corpus.words(t)})
    low = textkit.words(pa.array(["Aé", "aé", "AÉ"]), lower=True).hashes
    assert low[0] == low[1] != low[2]


def test_words_do_not_cross_texts():
    assert textkit.words(pa.array(["ab", "cd"])).counts.tolist() == [1, 1]
    sliced = pa.array(["zz", "ab cd", "e"]).slice(1, 2)
    assert textkit.words(sliced).hashes.tolist() == textkit.words(pa.array(["ab cd", "e"])).hashes.tolist()


def test_shingles_of_short_texts():
    values, bounds = textkit.shingles(textkit.words(pa.array(["a b", "a b c", "", "a b c d"])), 3)
    assert np.diff(bounds).tolist() == [1, 1, 0, 2]
    assert len(set(values.tolist())) == 3


# near-duplicates


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(docs, rows, k, percent):
    found = near_dedup.group(docs, near_dedup.Settings(k=k, percent=percent)).collect()
    expected = corpus.near_components(rows, k, percent)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_bucket_whose_members_do_not_match_the_hub(spark):
    """A chain: the hub is like the second only, the second like the third."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for n in range(120):
        w = list(base)
        for j in range(n * 3, n * 3 + 12):
            w[j % 400] = f"n{n}x{j}"
        rows.append((n, " ".join(w), "en", "a", None))
    rng.shuffle(rows)
    expected = corpus.near_components(rows, 3, 85)
    found = near_dedup.group(corpus.frame(spark, rows), near_dedup.Settings(k=3, percent=85)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_blocks_find_every_link(spark, monkeypatch):
    """Near copies around the threshold, in buckets of many blocks."""
    for name, value in (("BLOCK", 4), ("CROWD", 4), ("HUBS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(60):
        w = list(base)
        for j in rng.sample(range(150), rng.randint(1, 7)):
            w[j] = f"n{n}x{j}"
        rows.append((n, " ".join(w), "en", "a", None))
    expected = corpus.near_components(rows, 3, 85)
    found = near_dedup.group(corpus.frame(spark, rows), near_dedup.Settings(k=3, percent=85)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert 1 < len({c for _, c in expected.values()}) < 60


def test_shared_counts():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [2, 3, 9], [7])]
    assert near_dedup.shared_counts(sets, sets).tolist() == [[3, 2, 0], [2, 3, 0], [0, 0, 1]]


def test_near_dedup_keeps_columns(docs, none):
    same_columns(near_dedup.deduplicate(clashing(docs)), docs)
    assert near_dedup.group(none).count() == 0


def test_posterior_bounds():
    s = near_dedup.Settings(k=3, percent=85)
    assert s.length == s.bands * s.rows and (1 - 0.85**s.rows) ** s.bands <= s.band_miss
    n, need = s.least_agreements()[-1]
    tail = sum(math.comb(n + 1, m) * 0.85**m * 0.15 ** (n + 1 - m) for m in range(need))
    assert tail < s.miss


@pytest.mark.parametrize("chunk", [1 << 19, 40])
def test_components_of_a_long_chain(spark, chunk):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (3, 4)], "a long, b long").repartition(8)
    found = {r.node: r.component for r in components.components(links, chunk).collect()}
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components.components(links.limit(0)).count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def coders():
    made = bpe.Encoder(bpe.load_ranks(PATH), PATTERN)
    return made, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(made.vocabulary)}, special_tokens={})


def test_bpe_equals_tiktoken_on_odd_texts(coders, rows):
    made, reference = coders
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\r\n", " \n ", "\t", "\x1c", "\x85", "\xa0", "é", "你好", "😀", "²", "'s", "'LL", "!!!", "====", "aaaa", "0", "\u200b", "<|endoftext|>", "ſ", "İ"]
    texts = [r[1] or "" for r in rows] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice("abeinrst") for _ in range(150)) for _ in range(150)] + ["".join(chr(rng.choice([rng.randint(0, 0x24F), rng.randint(0, 0xD7FF)])) for _ in range(40)) for _ in range(300)]
    for t in texts:
        ids = made.encode(t)
        assert ids == reference.encode_ordinary(t), t
        assert made.decode(ids) == t.encode()


def test_bpe_query(docs, rows, coders, none):
    found = {r.doc_id: r for r in bpe.digests(docs, PATH, PATTERN).collect()}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            ids = coders[1].encode_ordinary(text or "")
            r = found[doc_id]
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.digests(none, PATH, PATTERN).count() == 0
    assert bpe.encode(clashing(docs), PATH, PATTERN).columns == [*clashing(docs).columns, "ids"]


# fingerprints


def _windows(text: str) -> set:
    w = corpus.words(text)
    return {tuple(w[max(0, i - 4) : i + 1]) for i in range(len(w))}


def test_fingerprints(docs, rows, none):
    found = fingerprints.compare_with_edits(docs).collect()
    assert len(found) == len(rows)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    by_digest = Counter()
    errors = []
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in found}
    for n, (doc_id, text) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        r = got[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        by_digest[r.fingerprint, text if not corpus.words(text) else " ".join(x.decode() for x in corpus.words(text))] += 1
        a, b = _windows(text), _windows(edited)
        if a and b:
            errors.append(r.near_edited - len(a & b) / len(a | b))
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.25
    assert len({f for f, _ in by_digest}) == len({t for _, t in by_digest if t.strip()}) + 1
    assert fingerprints.compare_with_edits(none).count() == 0


def test_fingerprints_of_one_row(spark):
    r = fingerprints.compare_with_edits(spark.createDataFrame([(7, "only one text in here", "en", "a", 1)], corpus.SCHEMA)).first()
    assert r.near_next == 1.0


# shards


def test_shards(docs, rows, none):
    found = sharding.shard(clashing(docs), 16).collect()
    assert len(found) == len(rows) and {r.law for r in found} == {"bytes"}
    sizes = Counter()
    slots: dict = {}
    for r in found:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(sizes.values()), max(r.size for r in found)
    assert all(abs(sizes[i] - total / 16) <= 2 * largest for i in range(16))
    crc = Counter(zlib.crc32((t or "").encode()) for _, t, *_ in rows)
    assert Counter(r.text_crc32 for r in found) == crc
    assert sharding.shard(none).count() == 0


def test_shards_of_one_hot_text(spark):
    rows = [(i, "same text", "en", "a", 9) for i in range(3000)]
    sizes = Counter(r.shard for r in sharding.shard(corpus.frame(spark, rows)).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 2


def test_small_groups_are_not_split(spark):
    rows = [(i, f"text number {i % 400} " + "w" * (i % 400 % 37), "en", "a", 9) for i in range(1600)]
    found = sharding.shard(corpus.frame(spark, rows), 4).collect()
    groups: dict = {}
    for r in found:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(groups) == 400 and all(len(x) == 1 for x in groups.values())
    total = sum(r.size for r in found)
    for shard in range(4):
        assert abs(sum(r.size for r in found if r.shard == shard) - total / 4) <= sharding.SNAP * total / 4
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))


# substring dedup


def test_repeats_equal_brute_force(docs, rows, none):
    expected = corpus.without_repeats(rows, 13)
    found = substring_dedup.remove(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and r.doc_id != 189:
            n, gone, kept = expected[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == (n, gone, hashlib.sha256(kept).hexdigest(), kept.decode())
        elif r.doc_id is None:
            assert r.n_removed == 0
    assert sum(r.n_removed > 0 for r in found) > 20
    assert substring_dedup.remove(none).count() == 0


@pytest.mark.parametrize("shift", range(7))
def test_repeats_at_every_alignment(spark, shift):
    run = [f"r{i}" for i in range(13)]
    rows = [(1, " ".join([f"a{i}" for i in range(5)] + run), "en", "a", 1), (2, " ".join([f"b{i}" for i in range(shift)] + run + ["z"]), "en", "a", 1), (3, " ".join(run[:12] + ["y"]), "en", "a", 1)]
    found = {r.doc_id: r.n_removed for r in substring_dedup.remove(corpus.frame(spark, rows)).collect()}
    assert found == {1: 0, 2: 13, 3: 0}


def test_windows_with_one_equal_hash_are_told_apart():
    ids = np.array([1, 2, 1, 2, 3])
    rows = next(substring_dedup._deal(np.array([[5, 1], [5, 2], [7, 1], [7, 1], [7, 2]], np.uint64), ids, 1))
    found = substring_dedup._shared(pa.Table.from_batches([rows]), False, 1, 2).to_pylist()
    assert [(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["hashes"], np.uint64).tolist()) for r in found] == [([2], [7])]


def test_stretches_of_a_very_long_word_count_by_their_place():
    a, b = "a" * 65536, "b" * 65536
    w = textkit.words(pa.array([a + b + "c", b + a + "c", a + b + "c"]), second=True)
    assert w.hashes[0] == w.hashes[2] != w.hashes[1] and w.second[0] == w.second[2] != w.second[1]
    near = textkit.words(pa.array(["  one two", "b" * 70_000]), second=True), textkit.words(pa.array(["one two"]), second=True)
    assert near[0].hashes[:2].tolist() == near[1].hashes.tolist() and near[0].second[:2].tolist() == near[1].second.tolist()


def test_difference_cover():
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in substring_dedup.COVER and (j + d) % 7 in substring_dedup.COVER for d in range(7))


# exact dedup


def test_exact(docs, rows, none):
    found = exact_dedup.classify(clashing(docs)).collect()
    assert len(found) == len(rows)
    groups: dict = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in found:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.classify(none).count() == 0
    out = exact_dedup.deduplicate(clashing(docs))
    same_columns(out, docs)
    assert out.count() == len(groups)


def test_index_takes_only_new_digests(spark, docs):
    index = exact_dedup.DigestIndex(spark)
    index.ingest(exact_dedup.digests(docs))
    before = index.read().count()
    index.ingest(exact_dedup.digests(docs))
    assert index.read().count() == before
    index.ingest(exact_dedup.digests(corpus.frame(spark, [(9999, "a new text", "en", "a", 1)])))
    assert index.read().count() == before + 1
    assert index.read().filter("keep_id = 9999").count() == 1
    plan = index.read().hint("merge").join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.close()


def test_index_outlives_its_session(spark, docs):
    """A later application finds the files only: nothing is lost, and what was published first stays."""
    index = exact_dedup.DigestIndex(spark, buckets=3)
    index.ingest(exact_dedup.digests(docs))
    before = index.read().count()
    index.close()
    again = exact_dedup.DigestIndex(spark, index.path)
    assert (again.buckets, again.read().count()) == (3, before)
    text = next(r.text for r in docs.collect() if r.text and r.doc_id is not None)
    new = corpus.frame(spark, [(10**6, "another text", "en", "a", 1), (10**6 + 1, text, "en", "a", 1)])
    assert [r.doc_id for r in exact_dedup.deduplicate(new, again).collect()] == [10**6]
    assert again.read().count() == before + 1
    assert [r.doc_id for r in exact_dedup.deduplicate(new, again).collect()] == [10**6]  # a job run again
    again.close()
    with pytest.raises(ValueError, match="no digest index"):
        exact_dedup.DigestIndex(spark, exact_dedup.digests(docs).shelf_path)


def test_batches_meet_the_index(spark, docs, monkeypatch):
    """The query's later batches are anti-joined with what the earlier ones wrote."""
    seen = []
    left = type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda self, other, on=None, how=None: (seen.append(how), left(self, other, on, how))[1])
    before = set(spark.catalog.listTables())
    exact_dedup.classify(docs)
    assert seen.count("left_anti") == exact_dedup.BATCHES
    assert set(spark.catalog.listTables()) == before


def test_hot_digest_goes_by_broadcast(spark):
    rows = [(i, "hot", "en", "a", 1) for i in range(1500)] + [(2000, "cold", "en", "a", 1)]
    found = exact_dedup.classify(corpus.frame(spark, rows)).collect()
    assert {(r.keep_id, r.group_size) for r in found} == {(1499, 1500), (2000, 1)} and sum(r.kept for r in found) == 2


# url filter


def test_url_parts_and_rules(spark):
    cases = [
        ("https://A.Net/x?y", "a.net", "/x", "net/"), ("http://example.net/en/1#t", "example.net", "/en/1", "example.net/en/"), ("http://sub.example.net/de/", "sub.example.net", "/de/", "net/"),
        ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/"), ("http://notexample.com/de/1", "notexample.com", "/de/1", None), ("x://b.org/fr/?q", "b.org", "/fr/", "org/fr/"),
        ("http://a.net", "a.net", "", None), ("no url", "", "", None), (None, "", "", None), ("http://?x", "", "", None), ("a://b://c/d", "b:", "//c/d", None),
    ]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    found = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == {h + p: v for v, h, p in url_filter.RULES}[rule]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_model(spark):
    pages = spark.createDataFrame([(1, "https://my-casino-bets.test/win-money-now"), (2, "https://university-library.test/articles/7"), (3, "https://cheap-pills.test/buy/cheap-deal"), (4, "https://www.science-journal.test/about")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    with pytest.raises(ValueError, match="labelled"):
        url_filter.train(spark.range(url_filter.TRAIN_ROWS + 1).selectExpr("concat('http://a/', id) AS url", "1 AS label"))


def test_url_accuracy_on_held_out_hosts(spark):
    assert url_filter.accuracy(url_filter.labelled(spark)) > 0.93


def test_url_scores_equal_brute_force(spark):
    """Trigrams, weights and verdicts in plain Python."""
    urls = ["https://Casino-4u.test/Win?x#y", "http://a/", "ftp://x.org", "nothing", None, "https://www.library.co.uk/en/guide.html"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    weights, bias = url_filter.train(url_filter.labelled(spark))
    grams = spark.createDataFrame([(m, t) for r in url_filter.judge(pages).collect() for m, x in (("h", r.host), ("p", r.path)) for s in [f"{m}^{x}$"] for t in [s[i : i + 3] for i in range(len(s) - 2)]], "mark string, gram string").distinct()
    number = {(r.mark, r.gram): r.n for r in grams.selectExpr("mark", "gram", f"pmod(xxhash64(mark, gram), {url_filter.BUCKETS}) AS n").collect()}
    for r in url_filter.judge(pages).collect():
        found = {number[m, s[i : i + 3]] for m, x in (("h", r.host), ("p", r.path)) for s in [f"{m}^{x}$"] for i in range(len(s) - 2)}
        expected = 1 / (1 + math.exp(-(bias + sum(weights[i] for i in found) / math.sqrt(len(found)))))
        assert r.allow_probability == pytest.approx(expected)
        assert r.rule is not None or r.verdict == ("allow" if expected >= 0.5 else "block")


# mixing


def test_targets(spark):
    def got(*totals):
        frame = spark.createDataFrame([(name, words, 1) for name, words in totals], "source string, words long, n long")
        return {r.source: r.target for r in mixing.targets(frame).collect()}

    found = got(("b", 100), ("a", 1000), (None, 10), ("c", 5))
    assert found[None] == 30 and found["c"] == 15
    assert sum(found.values()) == pytest.approx(1115)
    assert found["b"] == 300 and found["a"] == pytest.approx(770)
    assert got() == {} and got(("a", 0)) == {"a": 0.0}


def test_targets_equal_brute_force(spark):
    rng = random.Random(11)
    totals = [(f"s{i:03}" if i else None, rng.choice([0, rng.randint(1, 50), rng.randint(1, 90_000)])) for i in range(300)]
    order = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    weight = {name: mixing.WEIGHTS[i % 3] for i, (name, _) in enumerate(order)}
    want, free = {}, [name for name, _ in order]
    size, whole = dict(order), sum(w for _, w in order)
    while free:
        per = (whole - sum(want.values())) / sum(weight[x] for x in free)
        over = [x for x in free if per * weight[x] > 3 * size[x]]
        want |= {x: 3.0 * size[x] for x in over} if over else {x: per * weight[x] for x in free}
        free = [x for x in free if x not in want] if over else []
    frame = spark.createDataFrame([(name, words, 1) for name, words in totals], "source string, words long, n long").repartition(7)
    found = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert found == {k: pytest.approx(v) for k, v in want.items()}


def test_one_document_of_a_source_takes_the_remainder(spark):
    docs = corpus.frame(spark, [(1, "w " * 1000, "en", "a", 1), (2, "w " * 1000, "en", "b", 1), (3, "v " * 7, "en", None, 1)])
    found = mixing.taken(docs).collect()
    assert all(abs(r.taken - r.target) <= 1 and 0 <= r.taken <= 3 * r["size"] for r in found)


def test_many_repeated_rows_are_drawn_together(spark):
    docs = corpus.frame(spark, [(None, "same text", "en", "a", 1)] * 900 + [(i, "other text here", "en", "b", 1) for i in range(300)])
    found = mixing.taken(docs).collect()
    assert len(found) == 1200
    for target in {r.target for r in found}:
        own = [r.taken for r in found if r.target == target]
        assert sum(own) == pytest.approx(target, abs=1) and max(own) - min(own) <= 4
    assert mixing.mix(docs).filter("doc_id IS NULL").count() in range(*(sum(r.taken for r in found if r.doc_id is None) // 2 + d for d in (-1, 2)))


def test_flight_keeps_totals():
    rng = random.Random(4)
    p, x = [rng.random() for _ in range(500)], [float(rng.randint(1, 900)) for _ in range(500)]
    out = mixing.flight(p, x, 9)
    assert sum(0 < v < 1 for v in out) <= 2
    assert sum(out) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(out, x, strict=True)) == pytest.approx(sum(a * b for a, b in zip(p, x, strict=True)))
    assert mixing.flight(p, x, 9) == out


def test_mix(docs, rows, none):
    found = mixing.taken(clashing(docs)).collect()
    again = mixing.taken(docs.repartition(3)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    assert len(found) == len(rows) and all(r.taken <= 3 * r["size"] for r in found)
    assert Counter(r["size"] for r in found) == Counter(len(corpus.words(t)) for _, t, *_ in rows)
    totals = {(r.source_size, r.target): 0 for r in found}
    for r in found:
        totals[r.source_size, r.target] += r.taken
    assert all(abs(got - want) <= 1 for (_, want), got in totals.items())
    mixed = mixing.mix(clashing(docs))
    same_columns(mixed, docs)
    whole = mixing.plan(docs).selectExpr("sum(size * times)").first()[0]
    assert sum(len(corpus.words(r.text)) for r in mixed.collect()) == whole
    assert mixing.taken(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_over_many_blocks(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 60), "en", "a" if i % 3 else "b", 1) for i in range(9000)]
    found = mixing.taken(corpus.frame(spark, rows)).collect()
    for target in {r.target for r in found}:
        assert sum(r.taken for r in found if r.target == target) == pytest.approx(target, rel=2e-3)


# language


def test_languages(docs, rows, none):
    found = {r.doc_id: r for r in langid.classify(docs).collect() if r.doc_id is not None}
    right = seen = 0
    for doc_id, text, lang, *_ in rows:
        if doc_id is None:
            continue
        r = found[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif lang and len(text) > 60 and doc_id < 120:
            seen, right = seen + 1, right + (r.lang_pred == lang)
    assert right >= 0.8 * seen > 20  # some texts are mostly a passage in another language
    assert langid.classify(none).count() == 0
    kept = langid.keep_known(clashing(docs))
    same_columns(kept, docs)
    # A word of 70,000 times the same letter is in no language.
    assert kept.count() == sum(any(c.isalpha() for c in r[1] or "") and "x" * 1000 not in r[1] for r in rows)


def test_languages_equal_brute_force(rows):
    """Profiles letter by letter, with a long table of trigrams bound in several goes."""
    texts = [r[1] for r in rows][:40] + ["Ωμέγα 漢字かな " + "".join(chr(0x4E00 + i * 7 % 5000) for i in range(9000))]
    found, lettered = langid.profiles(texts)
    for text, profile, has in zip(texts, found, lettered, strict=True):
        letters = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""]
        line = [32]
        for c in [*letters, 0]:
            if c or line[-1] != 32:
                line.append(c or 32)
        grams = Counter(g for g in zip(line, line[1:], line[2:], strict=False) if g[1] != 32)
        total = np.zeros(langid.DIMENSIONS)
        for gram, n in grams.items():
            a, b, c = langid.vectors(np.array(gram)).astype(int)
            total += n * np.roll(a, 2) * np.roll(b, 1) * c
        size = np.sqrt((total**2).sum())
        assert has == any(letters)
        assert np.allclose(profile, total / size if size else 0, atol=1e-5)


def test_long_junk_is_rejected_and_labels_are_mended(spark, docs):
    rng = random.Random(5)
    junk = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(60))
    good = next(r for r in docs.collect() if r.lang == "en" and r.doc_id is not None and len(r.text or "") > 300)
    more = spark.createDataFrame([(9001, junk, "en", "a", 1), (9002, good.text, "fr", "a", 1), (9003, "Zz q.", "de", "a", 1)], corpus.SCHEMA)
    kept = {r.doc_id: r.lang for r in langid.keep_known(docs.unionByName(more)).collect()}
    assert 9001 not in kept and kept[9002] == "en" and kept[9003] == "de"


def test_memory_of_the_coder_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 40_000)
    made = bpe.Encoder(bpe.load_ranks(PATH), PATTERN)
    text = " ".join(f"wörd{i}" for i in range(5000)) + " " + "x" * 70_000
    tokens = made.encode(text)
    assert made.decode(tokens).decode() == text
    assert made.held <= 40_000 and len(made.pieces) + len(made.stretches) < 200
    assert max(map(len, made.pieces)) <= bpe.LONGEST
    made.forget()
    assert not made.pieces and not made.stretches and not made.pairs and not made.held


def test_languages_without_labels(spark):
    out = langid.classify(spark.createDataFrame([(1, "words", None, "a", 1)], corpus.SCHEMA)).first()
    assert out.lang_pred == "und"


def test_texts_stay_without_labels(spark):
    docs = spark.createDataFrame([(1, "words", None, "a", 1), (2, "12 3", None, "a", 1), (3, None, None, "a", 1)], corpus.SCHEMA)
    assert [r.doc_id for r in langid.keep_known(docs).collect()] == [1]


# language model


def test_lm_counts(docs, rows, none):
    found = class_lm.score(docs).collect()
    assert len(found) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts: Counter = Counter()
    for doc_id, text, *_ in rows:
        if not held(doc_id):
            counts.update([*corpus.words(text, lower=True), None])
    n, v = sum(counts.values()), len(counts)
    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in found:
        if r.doc_id is None:
            continue
        w = [*corpus.words(by_id[r.doc_id], lower=True), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)
    assert class_lm.score(none).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    seq = np.empty(20_000, np.int64)
    seq[0::2], seq[1::2] = rng.integers(0, 40, 10_000), rng.integers(40, 80, 10_000)
    classes = np.append(np.arange(class_lm.TYPES) % class_lm.CLASSES, class_lm._END)

    def tables(c):
        before, after = np.zeros((class_lm.TYPES + 1, class_lm.CLASSES + 1)), np.zeros((class_lm.TYPES + 1, class_lm.CLASSES + 1))
        np.add.at(before, (seq[1:], c[seq[:-1]]), 1)
        np.add.at(after, (seq[:-1], c[seq[1:]]), 1)
        return before, after

    scores = [class_lm._likelihood(class_lm._bigrams(tables(classes)[0], classes))]
    for _ in range(3):
        classes = class_lm.exchange(*tables(classes), classes)
        scores.append(class_lm._likelihood(class_lm._bigrams(tables(classes)[0], classes)))
    assert max(scores[1:]) > scores[0] + 1000


def test_every_word_has_a_class_of_its_own(spark):
    by_slot: dict[int, list[str]] = {}
    for i in range(40_000):
        by_slot.setdefault(int(textkit.words(pa.array([f"w{i}"])).hashes[0]) % 8192, []).append(f"w{i}")
    pairs = [x[:2] for x in by_slot.values() if len(x) > 1][:40]  # the words of a pair agree in 13 bits of their hashes
    rng = random.Random(3)
    texts = [" ".join(rng.choice(pairs)[k % 2] for k in range(60)) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    held = [r for r in class_lm.score(rows).collect() if r.held_out]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    # First and second words of pairs take turns, so knowing the class before halves the choice.
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.25


def test_scores_equal_brute_force(docs, rows, monkeypatch):
    """The model's formula in plain Python, with the classes that clustering gave."""
    made, cluster = [], class_lm.cluster
    monkeypatch.setattr(class_lm, "cluster", lambda table, buckets: made.append((table, cluster(table, buckets))) or made[0][1])
    found = class_lm.score(docs).collect()
    table, model = made[0]
    of: dict[int, int] = {}
    for row in class_lm._with_classes(table, model.kinds).collect():
        words = np.frombuffer(row.words, np.uint64).tolist()
        kinds = class_lm._classes({"kinds": [{"kinds": x.kinds} for x in row.kinds] if row.kinds is not None else None, "words": row.words})
        of |= dict(zip(words, kinds.tolist(), strict=False))
    number = lambda word: int(textkit.words(pa.array([word]), lower=True).hashes[0])
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learned = [[number(w) for w in corpus.words(text)] for doc_id, text, *_ in rows if not held(doc_id)]
    counts = Counter(w for text in learned for w in text)
    end, width = class_lm._END, class_lm.CLASSES + 1
    pairs: Counter = Counter()
    for text in learned:
        line = [end, *[of[w] for w in text], end]
        pairs.update(zip(line, line[1:], strict=False))
    sizes, before = Counter(), Counter()
    for (p, c), n in pairs.items():
        sizes[c] += n
        before[p] += n
    total, tokens = sum(sizes.values()), sum(counts.values()) + len(learned)
    unseen = (sum(n == 1 for n in counts.values()) + 1) / (tokens + 2)
    share = lambda c: (sizes[c] + 1) / (total + width)
    move = lambda p, c: (pairs[p, c] + class_lm.PRIOR * share(c)) / (before[p] + class_lm.PRIOR)
    once = {w for w, n in counts.items() if n == 1}
    lines = [[None, *text, None] for text in learned]
    steps = [(a, b) for line in lines for a, b in zip(line, line[1:], strict=False)]
    kind = lambda w: end if w is None else of[w]
    share_of, singles = Counter(kind(a) for a, b in steps if b in once), [b for a, b in steps if a in once]
    followed = Counter(map(kind, singles))
    prior = class_lm.PRIOR
    u = lambda p: (share_of[p] + prior * unseen) / (before[p] + prior) if p != "new" else (sum(b in once for b in singles) + prior * unseen) / (len(singles) + prior)
    to = lambda p, c: move(p, c) if p != "new" else (followed[c] + prior * share(c)) / (len(singles) + prior)
    by_id = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 189}
    for r in found:
        if r.doc_id not in by_id:
            continue
        expected, p = 0.0, end
        for w in [*[number(x) for x in corpus.words(by_id[r.doc_id])], None]:
            known = w is None or counts[w]
            c = kind(w) if known else "new"
            expected += math.log10((1 - u(p)) * to(p, c) * (1 if w is None else counts[w] / sizes[c])) if known else math.log10(u(p))
            p = c
        assert r.score == pytest.approx(expected, rel=1e-6)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_classes_are_better_than_words_alone(spark, sf):
    """Held-out perplexity under that of single words with the same share for unknown ones."""
    texts = {r.doc_id: corpus.words(r.text, lower=True) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, t in texts.items() if i not in held for w in [*t, None])
    n = sum(counts.values())
    unseen = (sum(c == 1 for c in counts.values()) + 1) / (n + 2)
    single = sum(math.log10((1 - unseen) * counts[w] / n) if counts[w] else math.log10(unseen) for i in held for w in [*texts[i], None])
    found = class_lm.score(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).filter("held_out").agg({"score": "sum", "n_tokens": "sum"}).first()
    tokens = found["sum(n_tokens)"]
    assert tokens == sum(len(texts[i]) + 1 for i in held)
    assert 10 ** (-found["sum(score)"] / tokens) < 10 ** (-single / tokens)


def test_steps_add_up():
    """Transitions with the unknown class are a distribution after every class."""
    rng = np.random.default_rng(1)
    width = class_lm._UNKNOWN
    sizes, rows = rng.integers(0, 900, width).astype(float), rng.random((width, width))
    model = class_lm.ClassModel(None, np.log10(rows / rows.sum(axis=1, keepdims=True)), sizes)
    seldom = np.floor(rng.random((2, width + 1)) * 5)
    seldom[0, width] = min(seldom[0, width], seldom[1, :width].sum())
    steps = 10 ** model.steps(np.minimum(seldom, np.append(sizes, 99)), 0.1)
    assert np.allclose(steps.sum(axis=1), 1)


def test_transitions_add_up(docs):
    rows = store.table(class_lm.units(docs.select("doc_id", "text", F.lit(False).alias("held_out"))), "t")
    model = class_lm.cluster(rows)
    assert np.allclose((10**model.transitions).sum(axis=1), 1)


# the pipeline


def test_pipeline_stages(spark, docs, rows, none):
    import corpus_pipeline

    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store.table(stage(spark, left, ""), "t")
        assert out.columns == docs.columns, name
        left = out
    coded = corpus_pipeline.STAGES[-1][1](spark, left, "")
    reference = bpe.encoder(PATH, PATTERN)
    texts = Counter(r.text for r in left.collect())
    assert Counter(reference.decode(r.ids).decode() for r in coded.collect()) == texts
    empty = none
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0

"""Every training-data operator on odd rows and against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash

from graphloom.llm import html_extract, langid, licenses, packing, quality, registry, sentencepiece_bpe, sharding, simhash, url_filter, winnowing

from ..conftest import same_as_sql

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept string, shard string, range int, h string"


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


ROWS = [
    (0, None, None, None, None, None, None, None, None, None),
    (1, "", "en", "a", 0, 1, "x", "y", 1, "z"),
    (2, words(300), "en", "a", 0, 1, "x", "y", 1, "z"),
    (3, words(300), "en", "a", 0, 1, "x", "y", 1, "z"),  # equal text
    (3, words(300), "en", "a", 0, 1, "x", "y", 1, "z"),  # repeated row
    (4, words(300) + " tail", "de", "b", 0, 1, "x", "y", 1, "z"),
    (5, "\t\n  \x0b", "de", "b", 0, 1, "x", "y", 1, "z"),
    (6, "Licensed under the Apache License, version 2.0. CC-BY 4.0; mit license\nmit license", "en", "b", 0, 1, "x", "y", 1, "z"),
    (7, words(40_000, 1), "en", "a", 0, 1, "x", "y", 1, "z"),
    (8, "日本語の文章 🙂 <|endoftext|> é́", "ja", "c", 0, 1, "x", "y", 1, "z"),
    (None, "no id here", "en", "c", 0, 1, "x", "y", 1, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sql(spark, sf):
    for name, sql in registry.oracles().items():
        same_as_sql(spark, registry.queries()[name], sql, sf)


def test_winnowing(docs, none):
    assert winnowing.compare_edited(none).count() == 0
    got = winnowing.compare_edited(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] and by[2]["near_next"] == 1.0
    ordered = [(None, "no id here")] + sorted({(r[0], r[1] or "") for r in ROWS if r[0] is not None})
    for k, (i, t) in enumerate(ordered):
        n = ordered[(k + 1) % len(ordered)][1]
        m = len(t) // 2
        assert by[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest()


def test_winnowing_chooses_the_rightmost_least(spark):
    text = " ".join(["a"] * 12)  # all hashes are equal
    row = winnowing.winnowed(spark.createDataFrame([(text,)], "t string"), "t", "v").selectExpr("v").head()
    places = [(1 << winnowing.PLACE_BITS) - 1 - (x & ((1 << winnowing.PLACE_BITS) - 1)) for x in row["v"]]
    assert places == list(range(winnowing.WINDOW - 1, 12 - winnowing.GRAM + 1))


def test_simhash(docs, none):
    assert simhash.near_duplicates(none).count() == 0
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fingerprint"] == "0" * 16 and by[5]["component_id"] == 0
    assert by[3]["component_id"] == 2


@pytest.mark.parametrize("radius", [4, 9])
@pytest.mark.parametrize("level", range(simhash.LEVELS))
def test_every_pair_within_the_radius_meets(radius, level):
    masks = simhash.tables(radius, level)
    assert len(masks) == {4: 31, 9: 62}[radius] and all(masks)
    rng = random.Random(3)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius)))
        assert any(not x & m for m in masks)


@pytest.mark.parametrize("n", range(1, 65))
def test_covering_holds_for_any_number_of_bits(n):
    masks = simhash.covering(list(range(n)), 4)
    if n <= 16:
        differ = [sum(1 << b for b in c) for k in range(1, 5) for c in itertools.combinations(range(n), k)]
    else:
        rng = random.Random(n)
        differ = [sum(1 << b for b in rng.sample(range(n), 4)) for _ in range(2000)]
    assert all(any(not x & m for m in masks) for x in differ)


def pairs_of(buckets):
    by, pairs = {}, set()
    for r in buckets:
        by.setdefault(r["key"], set()).add(r["__node"])
    for ns in by.values():
        pairs |= set(itertools.combinations(sorted(ns), 2))
    return pairs, max(map(len, by.values()))


@pytest.mark.parametrize("equal", [False, True])
def test_large_buckets_are_cut_and_no_pair_is_lost(spark, equal):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(200)})
    if equal:  # no mask parts these
        fps += [base] * 100
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "__fp bigint, __node bigint")
    small, rest = simhash.buckets(df, most=20, levels=1 if equal else 3)
    assert pairs_of(small.collect())[1] <= 20 and (rest is not None) == equal
    pairs, most = pairs_of((small if rest is None else small.unionByName(simhash.dealt(rest, 20))).collect())
    assert most < 60 and {(i, j) for i, a in enumerate(fps) for j in range(i + 1, len(fps)) if (a ^ fps[j]).bit_count() <= 4} <= pairs


def test_a_far_corner_of_a_dense_set_keeps_its_link(spark):
    """Two fingerprints that differ in bits 3, 7, 15 and 32 among thousands that agree with them in most places."""
    rng = random.Random(8)
    a = rng.getrandbits(64)
    b = a ^ (1 << 3 | 1 << 7 | 1 << 15 | 1 << 32)
    others = set()
    while len(others) < 12_000:
        x = a ^ sum(1 << k for k in rng.sample(range(64), rng.randint(5, 9)))
        if min((x ^ a).bit_count(), (x ^ b).bit_count()) > 4:
            others.add(x)
    fps = [a, b, *others]
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "doc_id bigint, __fp bigint")
    small, rest = simhash.buckets(df.withColumnRenamed("doc_id", "__node"), most=1024)
    rows = small if rest is None else small.unionByName(simhash.dealt(rest, 1024))
    assert rows.where("__node < 2").groupBy("key").count().where("count = 2").count()
    got = {r["doc_id"]: r["component_id"] for r in simhash.grouped(df).where("doc_id < 2").collect()}
    assert got == {0: 0, 1: 0}


def test_component_ids_are_brute_force(spark):
    rng = random.Random(6)
    texts = {}
    for i in range(40):
        own = words(rng.randint(1, 60), 30 + i).split()
        for _ in range(rng.randint(1, 5)):
            new = list(own)
            for _ in range(rng.randint(0, 2)):
                new[rng.randrange(len(new))] = words(1, rng.random())
            texts[1000 - len(texts)] = " ".join(new)
    texts |= {5: None, 6: "", 7: " \t"}
    fp = {i: simhash.fingerprint((t or "").encode()) for i, t in texts.items()}
    least = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4 and least[a] != least[b]:
            low, high = sorted((least[a], least[b]))
            least = {i: low if v == high else v for i, v in least.items()}
    rows = simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == {i: (fp[i], least[i]) for i in texts}
    assert 10 < len(set(least.values())) < len(texts)


def test_fingerprint_is_brute_force():
    text = words(50, 9)
    w = text.split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(len(w) - 3)]
    assert simhash.fingerprint(text.upper().encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(60)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["src"]: r["dst"] for r in simhash.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}


def test_sentencepiece(docs, none):
    path = public_tokenizers.path(sentencepiece_bpe.MODEL)
    assert sentencepiece_bpe.encode(none, path).count() == 0
    own, sp = sentencepiece_bpe.codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    odd = [r[1] or "" for r in ROWS] + ["".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "🙂", "日", "▁", "\x00"]) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    for t, (n, ids, decoded) in zip(odd, own.encode_batch(odd)):
        theirs = sp.encode(t, add_eos=True)
        assert ids == " ".join(map(str, theirs)) and n == len(theirs) and decoded == sp.decode(theirs)
        assert own.encode_words(["▁" + w for w in t.split(" ")]) == [own.encode_word("▁" + w) for w in t.split(" ")]
    assert {r["doc_id"]: r["n_tokens"] for r in sentencepiece_bpe.encode(docs, path).collect()}[0] == 1


def test_packing(docs, none, spark):
    paths = public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS)
    assert packing.pack_documents(none, *paths).count() == 0
    library = tokenizers.Tokenizer.from_file(paths[0])
    rows = packing.pack_documents(docs, *paths, size=128).collect()
    want = Counter()
    for r in ROWS:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cuts(len(ids), 128)):
            want[r[0], k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 128


@pytest.mark.parametrize("seed", range(20))
def test_plan_packs_everything_once(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 50) for _ in range(rng.randint(0, 200)))
    seen, bins = Counter(), {}
    for n, first, times, sequence, offset in packing.plan(dict(counts), 50):
        for i in range(times):
            seen[n] += 1
            bins.setdefault(sequence + i, []).append((offset, n))
    assert seen == counts
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 50


def test_sharding(docs, none):
    assert sharding.shard_documents(none, [1.0] * 4).count() == 0
    rows = sharding.shard_documents(docs, [1.0, 2.0, 1.0], parts=2).collect()
    assert len(rows) == len(ROWS)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    more = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard_documents(docs, [1.0, 2.0, 1.0, 1.0]).collect()}
    for r in rows:
        assert more[r["doc_id"], r["text_crc32"]] == r["grown_shard"] and r["grown_shard"] in (r["shard"], 3)
        assert r["text_crc32"] == zlib.crc32(({x[0]: x[1] for x in ROWS}[r["doc_id"]] or "").encode())


def test_weights_draw_their_share(spark):
    n = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    got = Counter(r["shard"] for r in sharding.shard_documents(n, [1.0, 3.0]).select("shard").collect())
    assert abs(got[1] / 20_000 - 0.75) < 0.02


def test_quality(docs, none, spark):
    assert quality.judged(none).count() == 0
    rows = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert rows[0]["base_failed"] and not rows[1]["kept"] and rows[2]["n_words"] == 300
    kept = quality.keep_good(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {2, 3, 4, 7}


def test_repeated_words_are_counted_once():
    assert quality.repeated(b"a b c x a b c".split()) == 6
    assert quality.repeated(b"a a a a".split()) == 4
    assert quality.repeated(b"a b".split()) == 0


def test_licenses(docs, none):
    assert licenses.license_scan(none).count() == 0
    rows = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert (rows[6]["n_base"], rows[6]["base_labels"]) == (4, "apache,cc-by,mit")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ROWS[7][1].lower())
    assert rows[6]["n_words"] == len(w) and rows[6]["first_word"] == w.index("apache") and rows[0]["labels"] == ""
    assert len(licenses.rules()) > 200


def test_contained_detections_are_suppressed():
    assert [x[2] for x in licenses.detect(b"licensed under cc by nc sa 4 0")] == ["cc-by-nc-sa"]


def test_language(docs, none, spark):
    rng = random.Random(1)
    say = lambda abc: " ".join("".join(rng.choices(abc, k=5)) for _ in range(60))
    train = spark.createDataFrame([(i, say("abcdef") if i % 2 else say("uvwxyz"), "one" if i % 2 else "two") for i in range(200)], "doc_id bigint, text string, lang string")
    filters = langid.learn(train)
    assert filters.languages == ["one", "two"]
    assert filters.predict(say("abcdef"))[0] == "one" and filters.predict(say("uvwxyz"))[0] == "two"
    assert filters.predict(None)[:2] == filters.predict("123 ...")[:2] == filters.predict("\U000F0000\u0301")[:2] == ("und", 0.0)
    assert filters.predict("ж" * 20)[:2] == ("one", 0.0)
    assert langid.identify(docs, filters).count() == len(ROWS)
    assert langid.learn(none).languages == [] and langid.identify(none, filters).count() == 0
    assert langid.keep_known(spark, docs, "").columns == docs.columns


def test_a_rare_language_and_many_languages_are_learned(spark):
    rng = random.Random(4)
    say = lambda abc: " ".join("".join(rng.choices(abc, k=5)) for _ in range(40))
    rows = [(i, say("abcdef"), "big") for i in range(1500)] + [(5000 + i, say("uvwxyz"), "rare") for i in range(20)]
    assert langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), learn_rows=120).predict(say("uvwxyz"))[0] == "rare"
    abc = [[chr(0x4E00 + 8 * k + j) for j in range(8)] for k in range(70)]
    many = langid.learn(spark.createDataFrame([(10 * k + i, say(abc[k]), f"l{k:02}") for k in range(70) for i in range(10)], "doc_id bigint, text string, lang string"))
    assert many.masks.shape[1] == 2 and sum(many.predict(say(abc[k]))[0] == f"l{k:02}" for k in range(70)) > 60


def test_language_filters_are_brute_force(spark):
    """Prediction against sets of n-grams in place of filters: the same languages, and scores within the error of the correction."""
    rng = random.Random(2)
    say = lambda abc, n: " ".join("".join(rng.choices(abc, k=rng.randint(2, 6))) for _ in range(n))
    abc = {"a": "abcdefgh", "b": "efghijkl", "c": "ijklmnop"}
    rows = [(3 * i + j, say(abc[k], 50), k) for i in range(60) for j, k in enumerate(abc)]
    filters = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    counts = {k: Counter(g for _, t, lang in rows if lang == k for g in set(langid.grams(langid._codes(t)).tolist())) for k in abc}
    sets = {k: {g for g, n in counts[k].items() if n >= langid.LEAST_ROWS and n >= langid.LEAST_RATE * max(c[g] for c in counts.values())} for k in abc}
    for k in [*abc] * 20:
        text = say(abc[k], 30)
        g = langid.grams(langid._codes(text)).tolist()
        share = {x: sum(y in sets[x] for y in g) / len(g) for x in abc}
        lang, score, n = filters.predict(text)
        assert n == len(g) and lang == max(share, key=share.get) == k and abs(score - share[k]) < 0.02


def test_language_accuracy_on_held_out_rows(spark, sf):
    rows = langid.op1_language_bitmask(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und' AND n_chars > 200").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_sharding_is_brute_force(docs):
    """Costs of all shards computed anew for each row, from Spark's hash alone."""
    from pyspark.sql import functions as F

    weights = [1.0, 2.5, 0.5, 1.0]
    u = [((F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(k)), 11)).alias(f"u{k}")) for k in range(5)]
    hashes = {r["doc_id"]: [-math.log((r[f"u{k}"] + 0.5) / 2**53) / w for k, w in enumerate([*weights, 1.0])] for r in docs.select("doc_id", *u).collect()}
    for r in sharding.shard_documents(docs, weights, parts=3).collect():
        costs = hashes[r["doc_id"]]
        assert r["shard"] == min(range(4), key=costs.__getitem__) and r["grown_shard"] == min(range(5), key=costs.__getitem__)
        assert r["size"] == 16 + len(({x[0]: x[1] for x in ROWS}[r["doc_id"]] or "").encode())


def brute_winnow(text):
    """Words of a text, by plain Python."""
    return [w for w in re.split("[\\x20\\x09-\\x0D]+", text.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))) if w]


def test_winnowing_is_brute_force(spark):
    """Chosen places and likenesses from the words' hashes, window by window."""
    from pyspark.sql import functions as F

    rng = random.Random(13)
    texts = [" ".join(rng.choices("a b c d E fg".split(), k=n)) for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 20, 60, 200)]
    vocabulary = sorted({w for t in texts for w in brute_winnow(t)})
    word = {r["w"]: r["h"] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    rot = lambda x, k: (x << k | x >> (64 - k)) & (2**64 - 1) if k else x

    def chosen(text):
        h = [word[w] for w in brute_winnow(text)]
        runs = [h[i : i + winnowing.GRAM] for i in range(max(1, len(h) - winnowing.GRAM + 1))] if h else []
        values = []
        for r in runs:
            x = 0
            for y in r:
                x = rot(x, 1) ^ y
            values.append(x)
        signed = [(v - 2**64 if v >> 63 else v) >> winnowing.PLACE_BITS for v in values]
        n = min(winnowing.WINDOW, len(signed))
        return {min(range(i, i + n), key=lambda k: (signed[k], -k)): None for i in range(len(signed) - n + 1)} if signed else {}, signed

    rows = winnowing.winnowed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "v").select("i", "v").collect()
    for r in rows:
        places, signed = chosen(texts[r["i"]])
        got = [((1 << winnowing.PLACE_BITS) - 1 - (x & ((1 << winnowing.PLACE_BITS) - 1)), x >> winnowing.PLACE_BITS) for x in r["v"]]
        assert sorted(got) == sorted((p, signed[p]) for p in places)
    by = {r["doc_id"]: r for r in winnowing.compare_edited(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    sets = [{chosen(t)[1][p] for p in chosen(t)[0]} for t in texts]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in enumerate(texts):
        n, m = texts[(i + 1) % len(texts)], len(t) // 2
        places, signed = None, None
        edited = t[: len(t) - m] + n[:m]
        assert by[i]["near_next"] == like(sets[i], sets[(i + 1) % len(texts)])
        if all(w in word for w in brute_winnow(edited)):
            places, signed = chosen(edited)
            assert by[i]["near_edited"] == like(sets[i], {signed[p] for p in places})


def test_urls(spark):
    rows = [(1, "https://A.example.COM/en/7/x?q#f"), (2, "http://example.com/en/8"), (3, None), (4, "no scheme"), (5, "http://x.net/de/1"), (6, "http://mynet/de/1"), (7, "http://q.example.net/de/88"), (8, "http://org")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    seen = spark.createDataFrame([("bad.io", 1)] * 60 + [("good.io", 0)] * 60 + [(None, 1)], "host string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, seen).collect()}
    assert got[1] == ("a.example.com", "/en/7/x", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow") and got[5][2] == "net/de/" and got[6][2] is None and got[7][2] == "example.net/de/8"
    more = spark.createDataFrame([(1, "http://bad.io/"), (2, "http://good.io/")], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(more, seen).collect()} == {1: "block", 2: "allow"}
    assert url_filter.filter_urls(more, seen.limit(0)).count() == 2 and url_filter.filter_urls(more.limit(0), seen).count() == 0
    clash = spark.createDataFrame([(None, "http://bad.io/" + "x" * 100_000, "a", "b", 1.0)] * 2, "page_id bigint, url string, host string, verdict string, bound double")
    assert [r["verdict"] for r in url_filter.filter_urls(clash, seen).collect()] == ["block"] * 2


def test_rules_say_what_the_contract_says(spark, sf):
    """Each rule's word, and the rows that a shorter and a longer one fit."""
    assert dict(map(reversed, url_filter.RULES)) == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    rows = [(1, "http://a.com/en/1"), (2, "http://example.com/en/77"), (3, "http://bad.net/de/1"), (4, "http://example.net/de/8"), (5, "http://x.org/es/"), (6, "http://example.net/de/7"), (7, "http://bad.net/en/")]
    seen = spark.createDataFrame([("bad.net", 1)] * 60 + [("good.io", 0)] * 60, "host string, bad int")
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), seen).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "block"}
    same_as_sql(spark, url_filter.op10_host_reputation, url_filter.ORACLES["op10_host_reputation"], sf)


def test_hosts_without_outcomes_follow_their_domain(spark):
    seen = spark.createDataFrame([(f"h{i}.bad.io", 1) for i in range(60)] + [(f"h{i}.good.com", 0) for i in range(60)], "host string, bad int")
    pages = spark.createDataFrame([(1, "http://new.bad.io/"), (2, "http://new.good.com/x"), (3, "http://other.io/"), (4, "http://10.1.2.3/")], "page_id bigint, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, seen).collect()}
    assert (got[1]["verdict"], got[2]["verdict"], got[4]["verdict"]) == ("block", "allow", "allow")
    assert got[3]["posterior"] > got[4]["posterior"] > got[2]["posterior"]


def test_posteriors_are_brute_force(spark):
    rng = random.Random(9)
    hosts = [f"{a}.{d}.{s}" for s in ("com", "co.uk", "net") for d in ("x", "y", "zz") for a in ("www", "m", "blog")] + ["10.0.0.1", "localhost"]
    rate = {h: rng.random() for h in hosts}
    rows = [(h, int(rng.random() < rate[h])) for h in hosts[::2] for _ in range(rng.randint(1, 30))]
    suffix = lambda h: h if h in ("10.0.0.1", "localhost") else h.split(".", 2)[2]
    domain = lambda h: h if h in ("10.0.0.1", "localhost") else h.split(".", 1)[1]

    def levels(key):
        by = {}
        for h, b in rows:
            n, k = by.get(key(h), (0, 0))
            by[key(h)] = n + 1, k + b
        return by

    def strength(by):
        n, k, g = sum(x for x, _ in by.values()), sum(y for _, y in by.values()), len(by)
        r = k / n
        spread = sum(x * (y / x - r) ** 2 for x, y in by.values()) / (r * (1 - r))
        room = n - sum(x * x for x, _ in by.values()) / n - (g - 1)
        rho = (spread - (g - 1)) / room
        return 1000.0 if rho <= 0 else min(1000.0, max(2.0, 1 / rho - 1))

    tops, mids, lows = levels(suffix), levels(domain), levels(lambda h: h)
    overall = sum(b for _, b in rows) / len(rows)
    post = lambda by, x, m, prior: (by.get(x, (0, 0))[1] + m * prior) / (by.get(x, (0, 0))[0] + m)
    for r in url_filter.host_reputation(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame(rows, "host string, bad int")).collect():
        h = r["host"]
        assert (r["suffix"], r["domain"]) == (suffix(h), domain(h))
        p = post(lows, h, strength(lows), post(mids, domain(h), strength(mids), post(tops, suffix(h), strength(tops), overall)))
        bound = max(0.0, p - url_filter.Z * math.sqrt(p * (1 - p) / (lows.get(h, (0, 0))[0] + strength(lows) + 1)))
        assert abs(r["posterior"] - p) < 1e-9 and abs(r["bound"] - bound) < 1e-9


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><div id=c><h1>Title {0} &amp; more</h1><p>First  paragraph of page {0} with words.<p>Second <b>one</b><br>here {0}.</div><div class=comments><p>reader says {0}</p></div><footer>end</footer></body></html>"


def test_html(spark):
    rows = [(i, f"http://h.example.com/{i}", PAGE.format(i)) for i in range(8)] + [(100, None, None), (101, "x", ""), (102, "http://other.org", "<article>only &lt;this&gt;")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3]["text"] == "Title 3 & more\nFirst paragraph of page 3 with words.\nSecond one here 3."
    assert got[100]["text"] == got[101]["text"] == "" and got[102]["text"] == "only <this>" and got[102]["n_chars"] == 11
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


LAYOUTS = {
    "<div class='layout has-sidebar'><article><h1>T @</h1><p>Body @ text.</p></article><div class=sidebar>x @</div></div>": "T @\nBody @ text.",
    "<article class='post no-comments'><p>Body @ text.</p></article>": "Body @ text.",
    "<article><header class='entry-header'><h1>Head @</h1></header><p>Body @ text here.</p></article>": "Head @\nBody @ text here.",
    "<article><h1>T @</h1><p class=lead>Lead @</p><div class=body><p>Long text @ and more and more.</p><p>para two @ and more</p></div></article>": "T @\nLead @\nLong text @ and more and more.\npara two @ and more",
    "<div><h1>T @</h1><div class=x><p>Text @ is long enough here, and longer than what stands alike.</p></div><p>The same words on each page.</p></div>": "T @\nText @ is long enough here, and longer than what stands alike.",
    "<main><h1>T @</h1><p>One @</p><section class='comments'><p>I say @</p></section></main><aside><p>side @</p></aside>": "T @\nOne @",
    "<div>" * 200 + "<article><p>Deep @ text</p></article>" + "</div>" * 200: "Deep @ text",
    f"<div class='{'a' * 60}x'><p>Ours @ one</p></div><div class='{'a' * 60}y ad'><p>theirs @</p></div>": "Ours @ one",
}


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_html_layouts(spark, layout):
    body, want = list(LAYOUTS.items())[layout]
    rows = [(i, f"http://h.example.com/{i}", f"<html><body><nav>menu</nav>{body.replace('@', str(i) * 3)}<footer>f</footer></body></html>") for i in range(7)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: want.replace("@", str(i) * 3) for i in range(7)}


def test_html_copies_repeated_rows_and_clashing_columns(spark):
    page = "<html><body><nav>menu</nav><article><h1>Same</h1><p>All pages are alike.</p></article></body></html>"
    rows = [(i, "http://h.example.com/", page, "a", "b", 1) for i in (1, 2, 3, 4, 4, None)] + [(9, None, "<p>" + "word " * 200_000, "a", "b", 1)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, region string, token int")).collect()
    assert len(got) == 7 and {r["text"] for r in got if r["page_id"] != 9} == {"Same\nAll pages are alike."}
    assert next(r["n_chars"] for r in got if r["page_id"] == 9) == 5 * 200_000 - 1


def test_token_classes_are_brute_force(spark):
    """Vectors of counts on every page, held in full, against the sums that stand for them."""
    rng, rows = random.Random(7), []
    for i in range(24):
        parts = ["<div class=top><p>always here</p></div>", f"<article><h1>t{i}</h1>" + "".join(f"<p>{words(9, 50 * i + k)}</p>" for k in range(rng.randint(1, 3))) + "</article>"]
        if rng.random() < 0.7:
            parts.append("<div class=note><p>some pages</p><span>only</span></div>")
        if rng.random() < 0.3:
            parts.append("<div class=rare>few</div>")
        rows.append((f"h{i % 2}", "<html><body>" + "".join(parts) + "</body></html>"))
    got = {}
    for r in html_extract.token_classes(spark.createDataFrame(rows, "host string, html string")).collect():
        by = {}
        for t in r["tokens"]:
            by.setdefault(t["vector"], set()).add(t["token"])
        got[r["host"]] = {frozenset(x) for x in by.values()}
    for host in ("h0", "h1", "*"):
        pages = [html_extract.Page(h) for x, h in rows if host in (x, "*")]
        counts = [Counter([*p.path, *(html_extract._hash(p.path[e], "", t) for e, t, _ in p.blocks)]) for p in pages]
        by = {}
        for token in set().union(*counts):
            vector = tuple(c[token] for c in counts)
            if max(vector) == 1 and sum(vector) >= html_extract.SUPPORT * len(pages):
                by.setdefault(vector, set()).add(token)
        assert got[host] == {frozenset(x) for x in by.values()}
    assert any(len(x) > 2 for x in got["h0"])


def test_licenses_are_brute_force():
    """No match is lost to the gate, and what is suppressed lies in another of its priority or a higher one."""
    rng = random.Random(3)
    vocabulary = sorted({w for r in licenses.rules() for k in r[2] for w in k.split()} | set("under the terms of version 2 0 license licence or later a this to be any".split()))
    grams = sorted({k for r in licenses.rules() for k in r[2]})
    for _ in range(300):
        text = " ".join(rng.choice(grams) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randint(1, 25))).encode()
        found = licenses.matches(text, False)
        assert licenses.matches(text) == found and licenses.detect(text) == licenses.detect(text, False)
        rank = lambda i: licenses.rules()[i][3]
        kept = [(b, e, i) for n, (b, e, i) in enumerate(found) if not any(x <= b and e <= y and (rank(j) > rank(i) or (rank(j) == rank(i) and ((x, y) != (b, e) or m < n))) for m, (x, y, j) in enumerate(found))]
        assert [(b, e, licenses.rules()[i][0]) for b, e, i in kept] == [x[:3] for x in licenses.detect(text)]


def test_base_places_are_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["Apache", "license", "CC", "by", "MIT", "mit", "gnu", "general", "public", "é", "x1", " ", " ", "-", "\n", ", "]) for _ in range(rng.randint(0, 60)))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        n_words, n_base, first, last, base, *_ = licenses.scan(text.encode())
        assert (n_words, n_base, first, last) == (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert base == ",".join(sorted({x for _, x in places}))


def test_pipeline(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r["doc_id"] for r in quality.judged(docs).where("kept").collect()}
    assert kept <= good and len(kept) > 0.5 * len(good)
    texts = dict(docs.where(docs.doc_id.isin(*good)).select("doc_id", "text").collect())
    assert kept == firsts_by_shingles(texts, True) == firsts_by_shingles(texts)


def shingles(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def meets(x):
    return any(not x & m for m in simhash.tables(simhash.STAGE_RADIUS))


def firsts_by_shingles(texts, met=False):
    """The smallest id of every group of texts whose shingles are alike at 0.8 or more (and whose words' SimHashes meet in some table)."""
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    prints = {i: simhash.word_print((texts[i] or "").encode())[0] for i in ids}
    least = {i: i for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if least[a] != least[b] and (not met or meets(prints[a] ^ prints[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((least[a], least[b]))
                least = {i: low if v == high else v for i, v in least.items()}
    return {i for i in ids if least[i] == i}


def test_near_copies_stage(spark, docs, none):
    rng = random.Random(5)
    texts = {}
    for base in range(12):
        own = words(260, 100 + base).split()
        for k in range(12):
            new = list(own)
            for _ in range(k):
                new[rng.randrange(len(new))] = words(1, rng.random())
            texts[len(texts)] = " ".join(new)
    texts[900], texts[901], texts[902] = "", None, "\t "
    df = spark.createDataFrame([(i, t, *[None] * 8) for i, t in texts.items()], SCHEMA).repartition(5)
    want = firsts_by_shingles(texts, True)
    assert 12 < len(want) < 100 and firsts_by_shingles(texts) <= want
    assert {r["doc_id"] for r in simhash.keep_firsts(spark, df, "").collect()} == want
    assert simhash.keep_firsts(spark, none, "").count() == 0
    kept = simhash.keep_firsts(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 2, 6, 7, 8] and len(kept) == 6
    assert len(kept[0]) == 10


@pytest.mark.parametrize("at_end, like, recall", [(False, 0.8, 0.95), (True, 0.8, 0.8), (True, 0.85, 0.93)])
def test_recall_of_the_tables(at_end, like, recall):
    """Texts with words changed, here and there or all at the end (the worst case), until they are just so alike."""
    rng, met, n = random.Random(21), 0, 0
    for i in range(300):
        a = words(rng.randint(80, 500), rng.random()).split()
        x, b, k = shingles(" ".join(a)), list(a), 0
        while True:
            last, k = list(b), k + 1
            b[-k if at_end else rng.randrange(len(b))] = words(1, rng.random())
            y = shingles(" ".join(b))
            if len(x & y) < like * len(x | y):
                break
        p, q = (simhash.word_print(" ".join(t).encode())[0] for t in (a, last))
        met, n = met + (meets(p ^ q) and (p ^ q).bit_count() <= simhash.FAR), n + 1
    assert met >= recall * n


def test_a_tally_bounds_the_difference():
    rng = random.Random(3)
    for _ in range(200):
        a = words(rng.randint(5, 400), rng.random()).split()
        b = a[: rng.randint(0, len(a))] + words(rng.randint(0, 300), rng.random()).split()
        (_, _, n, t), (_, _, m, u) = (simhash.word_print(" ".join(x).encode()) for x in (a, b))
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert (n, m) == (len(x), len(y)) and simhash.apart(t[None], u[None])[0] <= len(x ^ y)
        p, q = (simhash.shingle_set(" ".join(z).encode()) for z in (a, b))
        assert simhash.cells_apart(simhash.cells_of(p), simhash.cells_of(q)) <= len(x ^ y)
        k, cells = simhash._unpacked(np.frombuffer(simhash._packed(p), np.uint8).copy())
        assert k == n and (cells == simhash.cells_of(p)).all()


def test_a_doc_id_of_several_texts_is_one_document(spark):
    rows = [(1, "a b c"), (1, "d e f"), (1, "d e f"), (2, "g h i"), (3, "g h i")]
    kept = [r for _ in range(2) for r in simhash.keep_firsts(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "").collect()]
    assert sorted(r["doc_id"] for r in kept) == [1, 1, 2, 2] and len({r["text"] for r in kept if r["doc_id"] == 1}) == 1


def test_near_copies_in_a_hot_set(spark):
    """Records of the same words in other orders and with one common passage: each small class of copies is found, however the set is dealt."""
    rng = random.Random(11)
    own, passage = words(120, 1).split(), words(80, 2).split()
    texts = {}
    for base in range(60):
        rng.shuffle(own)
        for k in range(2 + base % 2):
            new = [*own, *passage]
            for _ in range(3 * k):
                new[rng.randrange(len(new))] = words(1, rng.random())
            texts[len(texts)] = " ".join(new)
    want = firsts_by_shingles(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    nodes, ends = simhash.near_copies(df, most=16)
    assert {r[0] for r in nodes.collect()} - {r["src"] for r in ends.collect()} == want
    assert 60 <= len(want) < 120


@pytest.mark.parametrize("most", [simhash.BUCKET, 16])
def test_rows_of_a_cluster_go_with_its_texts_not_its_pairs(spark, monkeypatch, most):
    """Variants of one text, most of them just too unlike each other: no row for each pair, yet every link."""
    rng, own, texts = random.Random(4), words(400, 3).split(), {}
    for i in range(160):
        new = texts[i - 1].split() if i % 8 == 7 else list(own)
        for _ in range(2 if i % 8 == 7 else 8):
            new[rng.randrange(len(new))] = words(1, rng.random())
        texts[i] = " ".join(new)
    made, plain, clumped = [], simhash.alike, simhash.links_in_clumps
    monkeypatch.setattr(simhash, "alike", lambda pairs, body: made.append(pairs.count()) or plain(pairs, body))
    monkeypatch.setattr(simhash, "links_in_clumps", lambda forest, *rest: made.append(forest.distinct().count()) or clumped(forest, *rest))
    monkeypatch.setattr(simhash, "CLUMP", 20_000)  # dealt into parts
    nodes, ends = simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3), most)
    want = firsts_by_shingles(texts)
    assert len(want) == 140 and {r[0] for r in nodes.collect()} - {r["src"] for r in ends.collect()} == want
    assert most == 16 or max(made) < 20 * len(texts)  # buckets dealt into parts of 16 make more, by their number of parts


def test_long_near_copies_are_compared_whole(spark):
    """Pairs of long texts just above and just below 0.8: none is decided by a sample."""
    rng, texts = random.Random(1), {}
    for i in range(16):
        a = words(1800, 500 + i).split()
        b = last = list(a)
        x = shingles(" ".join(a))
        while len(x & (y := shingles(" ".join(b)))) >= 0.8 * len(x | y):
            last = list(b)
            b[rng.randrange(len(b))] = words(1, rng.random())
        texts[2 * i], texts[2 * i + 1] = " ".join(a), " ".join(last if i % 2 else b)
    want = firsts_by_shingles(texts)
    assert len(want) == 24
    ends = simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))[1]
    assert set(texts) - {r["src"] for r in ends.collect()} == want


def test_license_gates_open_for_every_alternative():
    for text, label in (("governed by ncsa", "ncsa"), ("distributed under the terms of isc", "isc"), ("available under x11 version 11", "mit"), ("covered under the expat", "mit"), ("released under the gpl", "gpl"), ("distributed under the lgpl", "lgpl"), ("available under agpl", "agpl"), ("released under the wtfpl", "wtfpl"), ("available under mit", "mit"), ("covered by expat version 2", "mit"), ("provided under isc", "isc"), ("subject to psf", "python"), ("governed by ncsa", "ncsa"), ("under cc0", "cc0")):
        assert label in {x[2] for x in licenses.detect(text.encode())}, text

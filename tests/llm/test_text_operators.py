"""Tokenizers, classifiers, rules: library, held-out and brute-force checks."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldmill.llm import bpe, language_id, quality_classifier, quality_rules, queries, token_counts
from foldmill.llm.bytelevel import UNSETTLED

from . import tables
from .brute import repeated_words

SMALL = "/root/testdata/sf0.001"
BYTE, WORD = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")
byte_lib, word_lib = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def encoder():
    return bpe.ByteBpe(BYTE)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(WORD, {"the": 1, "internationalization": 2})


odd_text = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'stre.,1aZéΣİ<|>")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(odd_text, st.booleans())
def test_bpe_equals_library(encoder, text, special):
    text = f"{text}<|endoftext|>{text}" if special else text
    ids = byte_lib.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == ids
    assert encoder.decode(ids) == byte_lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(odd_text, st.booleans())
def test_counts_equal_library(counter, text, special):
    text = f"{text}<|startoftext|>{text}" if special else text
    assert counter.counts([text]) == [len(word_lib.encode(text, add_special_tokens=False).ids)]


def test_settled_characters_are_classed_alike(encoder):
    """Every character outside UNSETTLED is split as the library splits it, between letters and digits."""
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        if not UNSETTLED.search(c):
            text = f"a{c}a 1{c}1 .{c}. {c}"
            assert encoder.words.findall(text) == [text[x:y] for _, (x, y) in byte_lib.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_merging_many_equals_merging_one(encoder):
    rnd = random.Random(4)
    words = [bytes(rnd.choice(b"abcdeion \xc3\xa9") for _ in range(rnd.randint(1, 70))) for _ in range(500)]
    assert encoder.merges.encode_many(words) == [encoder.merges.encode(w) for w in words]


def test_long_runs(encoder, counter):
    text = "ab" * 20_000 + " " * 3000 + "é" * 2000
    assert encoder.encode(text) == byte_lib.encode(text, add_special_tokens=False).ids
    assert counter.counts([text]) == [len(word_lib.encode(text, add_special_tokens=False).ids)]


def test_frequent_table(spark):
    """The most frequent pre-tokens with the library's counts, within both bounds; counts above one included."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = token_counts.frequent(docs, WORD)
    words, lengths = (c.to_pylist() for c in table.columns)
    assert len(set(words)) == len(words) > 5000 and max(lengths) > 3
    assert lengths[:2000] == [len(e.ids) for e in word_lib.encode_batch(words[:2000], add_special_tokens=False)]
    plain = token_counts.Counter(WORD, {})
    tally = Counter(w for r in docs.select("text").collect() for w in plain.pre_tokens(r["text"])[1])
    assert words[:50] == [w for w, _ in sorted(tally.items(), key=lambda x: (-x[1], x[0]))[:50]]
    served = sum(tally[w] for w in words)
    assert served > 0.9 * sum(tally.values())
    few = token_counts.frequent(docs, WORD, sample=300, words=100, size=200)
    assert few.num_rows <= 100 and sum(len(w.encode()) for w in few.column(0).to_pylist()) <= 200
    assert token_counts.frequent(docs.limit(0), WORD).num_rows == 0


def test_a_worker_keeps_a_bounded_number_of_pairs(monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 4000)
    monkeypatch.setattr(bpe, "RECENT", 500)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 300)
    rnd = random.Random(8)
    few = bpe.ByteBpe(BYTE)
    for _ in range(40):
        texts = [" ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(1, 9))) for _ in range(60)) for _ in range(20)]
        assert [few.encode(t) for t in texts] == [e.ids for e in byte_lib.encode_batch(texts, add_special_tokens=False)]
        assert len(few.verdicts) <= 2 * 4000 + 3 * 500 + 2000
    assert len(few.verdicts.old[0]) > 0


def test_long_words_take_time_in_proportion(encoder):
    """About ten microseconds a byte at most, and no more for a longer word."""
    rnd = random.Random(9)
    for n in (20_000, 200_000):
        word = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        began = time.time()
        ids = encoder.encode(word)
        assert time.time() - began < 20e-6 * n + 0.5
        assert ids == byte_lib.encode(word, add_special_tokens=False).ids
    cjk = "".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(20_000))
    assert encoder.encode(cjk) == byte_lib.encode(cjk, add_special_tokens=False).ids


def test_small_caches_change_nothing(monkeypatch, spark):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "LONG", 4)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 50)
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    fresh, few = bpe.ByteBpe(BYTE), token_counts.Counter(WORD, {})
    assert [fresh.encode(t) for t in texts] == [e.ids for e in byte_lib.encode_batch(texts, add_special_tokens=False)]
    assert few.counts(texts) == [len(e.ids) for e in word_lib.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["data", "odd"])
def test_digests_and_counts(spark, tmp_path, name):
    path = SMALL if name == "data" else tables.write(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expect = []
    for d in docs:
        ids = byte_lib.encode(d["text"] or "", add_special_tokens=False).ids
        expect.append((d["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(byte_lib.decode(ids, skip_special_tokens=False))))
    found = queries.op10_bpe_round_trip(spark, path).collect()
    assert sorted(map(tuple, found), key=key) == sorted(expect, key=key)
    expect = []
    for d in docs:
        n = len(word_lib.encode(d["text"] or "", add_special_tokens=False).ids)
        expect.append((d["doc_id"], len((d["text"] or "").encode()), n, n > 2048))
    assert sorted(map(tuple, queries.op7_token_counts(spark, path).collect()), key=key) == sorted(expect, key=key)


def test_ids_and_texts(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b é"), (2, None), (3, "")], "doc_id int, text string")
    back = bpe.with_decoded(bpe.with_tokens(docs, BYTE), BYTE).collect()
    assert [(r["text"] or "") for r in back] == [r["decoded"] for r in back]


# --------------------------------------------------------------------------------------------- classifiers


def test_quality_held_out(spark):
    path = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    out = queries.op3_quality_classifier(spark, path).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    right = [r["predicted"] == labels[r["doc_id"]] for r in out if r["held_out"] and r["doc_id"] in labels]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)


def test_held_out_labels_are_not_learned(spark):
    """Turning round the held-out labels changes no score."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = quality_classifier.train(docs, labels), quality_classifier.train(docs, turned)
    assert (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()


def test_forest_walk_equals_a_plain_walk():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(600, len(quality_classifier.FEATURES))), rng.integers(0, 2, 600).astype(float)
    model = quality_classifier.fit(x, y)
    for row, score in zip(x[:40], model.score(x[:40])):
        total = model.start
        for t in range(len(model.feature)):
            at = 0
            while at < model.feature.shape[1]:
                at = 2 * at + (2 if row[model.feature[t, at]] > model.threshold[t, at] else 1)
            total += model.leaf[t, at - model.feature.shape[1]]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def plain_statistics(text):
    """The trees' features from plain Python, in their order."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return [0.0] * len(quality_classifier.FEATURES)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    n, chars = len(words), sum(map(len, words))
    count = lambda some: sum(c in some for c in text)
    upper, lower = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz")
    sizes = Counter(words)
    return [
        math.log(1 + n), chars / n, count("#*$%&|<>") / n, (len(lines) - len(set(lines))) / max(1, len(lines)), repeated_words(text) / n, n / max(1, len(lines)),
        upper / max(1, upper + lower), sum(a == b for a, b in zip(words, words[1:])) / n, len(sizes) / n, max(sizes.values()) / n, count("0123456789") / chars,
        count("!,.:;?") / n, count("!") / n, (upper + lower) / chars, max(len(w.encode()) for w in sizes),
    ]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBc d \n\t#!.,9é", max_size=120))
def test_statistics_by_brute_force(text):
    assert np.allclose(quality_classifier.statistics(text), plain_statistics(text), rtol=1e-12)


def test_first_split_by_brute_force():
    """The root of the first tree is the best of all cuts by the gain of Newton boosting; its leaves are Newton steps."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality_classifier.FEATURES)))
    y = (x[:, 4] + 0.3 * rng.normal(size=400) > 0.4).astype(float)
    model = quality_classifier.fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality_classifier.L2)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_classifier.BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    best = max(((gain(x[:, f] <= c) + gain(x[:, f] > c), f, c) for f in range(x.shape[1]) for c in cuts[f]))
    assert (model.feature[0, 0], model.threshold[0, 0]) == best[1:]
    where = np.zeros(len(x), int)
    for _ in range(quality_classifier.DEPTH):
        where = 2 * where + 1 + (x[np.arange(len(x)), model.feature[0, where]] > model.threshold[0, where])
    where -= model.feature.shape[1]
    for leaf in set(where.tolist()):
        m = where == leaf
        assert abs(model.leaf[0, leaf] - quality_classifier.RATE * g[m].sum() / (h[m].sum() + quality_classifier.L2)) < 1e-9


def test_no_labels_give_one_half(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    out = quality_classifier.with_score(docs, quality_classifier.train(docs, none)).collect()
    assert [r["score"] for r in out] == [0.5, 0.5]


def test_language_held_out(spark):
    path = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    out = queries.op5_language_id(spark, path).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in out if r["held_out"]]
    assert len(right) > 200 and sum(right) >= 0.98 * len(right)
    assert sum(r["rejected"] for r in out) <= 0.01 * len(out)


def plain_vector(text, idf):
    """TF-IDF of letter bigrams and trigrams by plain loops; a gram's slot is the module's own hash."""
    run, out = " ", np.zeros(language_id.SLOTS)
    for c in f" {text.lower()} ":
        if c.isalpha():
            run += c
        elif run[-1] != " ":
            run += " "
    codes = [0 if c == " " else ord(c) for c in run]
    top = (1 << 32) - 1
    for k in range(len(codes) - 1):
        two = (codes[k] * 0x9E3779B1 & top) ^ (codes[k + 1] * 0x85EBCA77 & top)
        grams = [two] if codes[k + 1] else []
        if k + 2 < len(codes) and codes[k + 1]:
            grams.append((two * 0xC2B2AE3D & top) ^ (codes[k + 2] * 0x27D4EB2F & top))
        for g in grams:
            out[(g * 0x165667B1 & top) >> 32 - language_id.SLOTS.bit_length() + 1] += 1
    out = np.sqrt(out) * idf
    return out / max(np.linalg.norm(out), 1e-12)


def test_language_by_brute_force(spark):
    """idf, the centroid of largest cosine and the verdict, from plain vectors of the same sample."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    learned = {}
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] and any(c.isalpha() for c in r["text"] or ""):
            learned[r["lang"], r["text"]] = plain_vector(r["text"], np.ones(language_id.SLOTS))
    assert model.languages == sorted({lang for lang, _ in learned}) and all(sum(x == lang for x, _ in learned) <= language_id.PER_LANGUAGE for lang in model.languages)
    having = sum((v > 0).astype(int) for v in learned.values())
    assert np.allclose(model.idf, np.log((1 + len(learned)) / (1 + having)) + 1, rtol=1e-6)
    for k, lang in enumerate(model.languages):
        own = np.stack([plain_vector(t, model.idf) for x, t in learned if x == lang])
        centres = model.centres[model.owner == k]
        assert np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-5) and len(centres) == min(4, len(own))
        # Each centre is the mean of the vectors nearest to it, as k-means leaves it (within its last step).
        near = (own @ centres.T).argmax(1)
        for j, c in enumerate(centres):
            mean = own[near == j].mean(0)
            assert c @ (mean / np.linalg.norm(mean)) > 0.97
    for r, got in zip(docs.collect()[:60], language_id.with_language(docs, model).collect()[:60]):
        if any(c.isalpha() for c in r["text"] or ""):
            cosine = plain_vector(r["text"], model.idf) @ model.centres.T
            assert abs(got["lang_score"] - cosine.max()) < 1e-4 and got["lang_pred"] == model.languages[model.owner[cosine.argmax()]]


def test_held_out_languages_are_not_learned(spark):
    """Neither other labels nor other texts in the held-out fold change the model."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    out = "crc32(cast(doc_id as string)) % 3 = 1"
    turned = docs.selectExpr("doc_id", f"if({out}, upper(reverse(text)), text) as text", f"if({out}, 'zz', lang) as lang")
    a, b = language_id.train(docs), language_id.train(turned)
    assert a.languages == b.languages and (a.centres == b.centres).all() and (a.floors == b.floors).all() and (a.idf == b.idf).all()


def test_all_languages_are_learned_and_copies_count_once(spark):
    """300 labels are all learned; a hundred thousand copies of one row take no place from others."""
    rnd = random.Random(6)
    texts = [(k * 300 + n, " ".join("".join(rnd.choices([chr(0x61 + (k * 7 + j) % 26) for j in range(6)], k=4)) for _ in range(12)), f"l{k:03d}") for k in range(300) for n in range(3)]
    docs = spark.createDataFrame(texts, "doc_id int, text string, lang string")
    kept = {t[2] for t in texts if zlib.crc32(str(t[0]).encode()) % 3 != 1}
    assert len(kept) > 256 and language_id.train(docs).languages == sorted(kept)
    french = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'fr'").limit(100).collect()]
    rows = spark.range(100_000).selectExpr("id as doc_id", "'The very same English row with the same words' as text", "'en' as lang")
    rows = rows.unionByName(spark.createDataFrame([(k, t, "fr") for k, t in enumerate(french)], "doc_id bigint, text string, lang string"))
    assert language_id.train(rows).languages == ["en", "fr"]
    assert {r["lang"]: r["count"] for r in language_id.sample(rows).groupBy("lang").count().collect()}["en"] == 1
    assert language_id.sample(rows, 10).where("lang = 'fr'").count() == 10


def test_language_odd_texts(spark, tmp_path):
    out = {r["doc_id"]: r for r in queries.op5_language_id(spark, tables.write(spark, tmp_path)).collect()}
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 and out[k]["rejected"] for k in (3, 4, 5, 6))
    assert out[12]["lang_pred"] == "fr" and out[1]["lang_pred"] == "en"


def test_unlearned_scripts_and_noise_are_rejected(spark):
    """Letter noise of 20 to 500 words and unlearned languages go; the sample's own languages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rnd = random.Random(7)
    scripts = ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x5500))), "".join(map(chr, range(0x627, 0x63B)))]
    noise = [" ".join("".join(rnd.choices(s, k=rnd.randint(2, 9))) for _ in range(n)) for s in scripts for n in (20, 50, 100, 250, 500) for _ in range(4)]
    prose = (
        "Однажды весною, в час небывало жаркого заката, в Москве, на Патриарших прудах, появились два гражданина. Первый из них был одет в летнюю серенькую пару, "
        "был маленького роста, упитан, лыс, свою приличную шляпу пирожком нёс в руке, а на хорошо выбритом лице его помещались сверхъестественных размеров очки.",
        "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie.",
    )
    model = language_id.train(docs)
    junk = ["".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n)) for n in (200, 1000, 5000)]
    texts = [(k, t) for k, t in enumerate([*noise, *prose, *junk])]
    out = language_id.with_language(spark.createDataFrame(texts, "doc_id int, text string"), model).collect()
    assert [r["doc_id"] for r in out if not r["lang_rejected"]] == []
    lettered = [r for r in language_id.with_language(docs, model).select("text", "lang_rejected").collect() if any(c.isalpha() for c in r["text"] or "")]
    assert sum(r["lang_rejected"] for r in lettered) <= 0.002 * len(lettered)


def test_cut_texts_count_the_same_grams(monkeypatch):
    text = " ".join(["Straße und 12 Häuser,", "où l'été"] * 40)
    whole, _ = language_id.counts([text, None, "ab"])
    monkeypatch.setattr(language_id, "PIECE", 50)
    cut, some = language_id.counts([text, None, "ab"])
    assert (whole == cut).all() and some.tolist() == [True, False, True]


# --------------------------------------------------------------------------------------------------- rules


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#A.é", max_size=80))
def test_measurements(text):
    got = dict(zip(quality_rules.MEASURES, quality_rules.measure(text)))
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t")]
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == text.count("#") and got["n_dup_lines"] == len(lines) - len(set(lines))
    assert got["n_repeat_words"] == repeated_words(text)


def test_long_texts_repeat_the_same_words():
    rnd = random.Random(2)
    for kinds in (2, 5, 400):
        words = [b"w%d" % rnd.randrange(kinds) for _ in range(1500)]
        words[700:760] = words[100:160]
        assert quality_rules.repeated(words) == quality_rules.repeated_in_many(words) == repeated_words(b" ".join(words).decode())


def test_policies_and_ablations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    book = quality_rules.ledger(docs).cache()
    bits = [r["failed_bits"] for r in book.collect()]
    names = list(quality_rules.RULES)
    for policy in quality_rules.POLICIES:
        m = quality_rules.mask(policy)
        assert quality_rules.apply_policy(book, policy).where("kept").count() == sum(not b & m for b in bits)
        found = {r["rule"]: (r["failed"], r["failed_alone"], r["kept_without"]) for r in quality_rules.ablations(book, policy).collect()}
        for r in quality_rules.POLICIES[policy]:
            one = 1 << names.index(r)
            assert found[r] == (sum(bool(b & one) for b in bits), sum(b & m == one for b in bits), sum(not b & m & ~one for b in bits))
    book.unpersist()

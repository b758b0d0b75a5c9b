"""Decontamination, URL filters, sharding, license scans and SimHash against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldmill.llm import decontamination as dc
from foldmill.llm import license_scan, queries, sharding, simhash, url_filter

from . import tables
from .brute import components, contaminated, fingerprint, similar_classes

SMALL = "/root/testdata/sf0.001"


def hit(substituted, k):
    """Whether a mask fits into a window of k words beside the substituted ones."""
    return any(not any(s + c in substituted for c in m) for m in dc.MASKS for s in range(k - dc.SPAN + 1))


@pytest.mark.parametrize("k, e", [(13, 2), (12, 1), (11, 1), (10, 1), (9, 0), (8, 0)])
def test_masks_hit_every_window_within_the_tolerance(k, e):
    assert all(hit(set(c), k) for c in itertools.combinations(range(k), e))


def overlap_rows(df):
    return sorted((str(r["doc_id"]), str(r["item_id"]), r["window"], r["matched"]) for r in df.collect())


@pytest.mark.parametrize("limit", [dc.BROADCAST_BYTES, 0])
def test_substituted_passages(spark, limit):
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 5, 7, 8, 9, 10, 12, 13, 20, 40])))) for k in range(24)]
    docs = []
    for k in range(150):
        text = rnd.choices(vocabulary, k=rnd.randint(0, 40))
        if k % 2:
            item = items[rnd.randrange(len(items))][1].split()
            cut = item[rnd.randint(0, 5) :] if rnd.random() < 0.5 else item[:]
            for _ in range(rnd.randint(0, 4)):
                if cut:
                    cut[rnd.randrange(len(cut))] = rnd.choice(vocabulary)
            at = rnd.randint(0, len(text))
            text[at:at] = cut
        docs.append((k, rnd.choice([" ", ", "]).join(text).upper() if k % 3 else " ".join(text)))
    found = dc.overlaps(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), broadcast_bytes=limit)
    expect = []
    for d, t in docs:
        for i, x in items:
            if n := contaminated(t, x):
                expect.append((str(d), str(i), min(13, len(x.split()), len(t.split())), n))
    assert expect and overlap_rows(found) == sorted(expect)
    assert {e[2] for e in expect} >= {1, 2, 8, 13}


def test_decontaminated_keeps_the_rest(spark, tmp_path):
    path = tables.write(spark, tmp_path)
    docs, benchmark = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    kept = dc.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    gone = Counter(str(d[0]) for d in tables.DOCS)
    gone.subtract(str(r["doc_id"]) for r in kept.collect())
    assert +gone == Counter({"1": 1, "2": 2, "None": 1, "7": 1, "10": 1})


@pytest.mark.parametrize("limit", [dc.BROADCAST_BYTES, 0])
def test_short_items_and_short_documents(spark, limit):
    """Items of one to seven words count if all their words stand in a row; a document of eight words or more
    that is part of a longer item counts too."""
    items = spark.createDataFrame([(1, "What is water?"), (2, "one"), (3, " ".join(f"w{k}" for k in range(30)))], "item_id int, text string")
    docs = [(1, "They asked: what is, WATER"), (2, "what is the water"), (3, "One."), (4, "w3 w4 w5 w6 w7 w8 w9 w10"), (5, "w3 w4 w5 w6 w7 w8 w9"), (6, "what is water what is water")]
    found = dc.overlaps(spark.createDataFrame(docs, "doc_id int, text string"), items, broadcast_bytes=limit)
    assert overlap_rows(found) == [("1", "1", 3, 3), ("3", "2", 1, 1), ("4", "3", 8, 8), ("6", "1", 3, 3)]


# ------------------------------------------------------------------------------------------------- URLs


def verdicts(entries, captures):
    """Replay of the list, day by day."""
    out = []
    for url, day in captures:
        host, _, path = url.split("://")[1].partition("/")
        labels, parts = host.split("."), [p for p in ("/" + path).rstrip("/").split("/")]
        keys = {"d:" + ".".join(labels[k:]) for k in range(max(1, len(labels) - 1))} | {"p:" + host + "/".join(parts[: k + 1]) for k in range(len(parts))}
        active = []
        for name, key in {(e[0], e[1]) for e in entries}:
            past = [(e[2], e[4], e[3]) for e in entries if (e[0], e[1]) == (name, key) and e[2] <= day]
            if key in keys and past and max(past)[2] == "add":
                active.append((len(key), key))
        out.append((url, day, bool(active), len(active), max(active)[1] if active else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, limit", [(1, 0), (2, url_filter.BROADCAST_BYTES)])
def test_url_filter_replay(spark, seed, limit):
    rnd = random.Random(seed)
    host = lambda: rnd.choice(["a.com", "b.a.com", "c.b.a.com", "x.org"])
    key = lambda: rnd.choice(["d:", "p:"]) + host()
    entries = []
    for n in range(200):
        k = key()
        entries.append((rnd.choice("LM"), k if k[0] == "d" else k + rnd.choice(["", "/u", "/u/v"]), f"2024-01-{rnd.randint(1, 28):02d}", rnd.choice(["add", "remove"]), n))
    captures = [(f"http://{host()}/{rnd.choice(['', 'u', 'u/', 'u/v', 'u/v/w', 'z'])}", f"2024-01-{rnd.randint(1, 31):02d}") for _ in range(150)]
    found = url_filter.evaluated(
        spark.createDataFrame(captures, "url string, fetch_day string"), spark.createDataFrame(entries, "list_name string, key string, day string, action string, seq bigint"), broadcast_bytes=limit
    ).collect()
    assert sorted(((r["url"], r["fetch_day"], r["blocked"], r["n_active"], r["matched_key"]) for r in found), key=str) == verdicts(entries, captures)


def test_url_parts(spark):
    cases = {
        "https://User:p@WWW.Example.COM.:8080/a/b/?q#f": ("www.example.com", "/a/b"), "http://h": ("h", ""), "http://h?x": ("h", ""), "ftp://h/": ("h", ""),
        "nothing": (None, ""), "http:///x": (None, "/x"), "http://h/a//": ("h", "/a"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    found = {r[0]: (r[1], r[2]) for r in df.select("u", url_filter.host_of(df.u), url_filter.path_of(df.u)).collect()}
    assert found == cases


# --------------------------------------------------------------------------------------------- sharding


def test_table_is_even_and_stable():
    shards = [f"s{k}" for k in range(10)]
    size = sharding.next_prime(1280)
    full = [shards[k] for k in sharding.fill(shards, size)]
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    fewer = [x for x in shards if x != "s3"]
    moved = sum(a != b for a, b in zip(full, [fewer[k] for k in sharding.fill(fewer, size)]) if a != "s3")
    assert moved < 0.1 * size
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 7)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 8)


def test_placement(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (7, None)], "doc_id bigint, slot string")
    shards = ["a", "b", "c"]
    table = sharding.fill(shards, 13)
    out = sharding.placed(docs, "doc_id", shards, 13).collect()
    assert len(out) == 4
    for r in out:
        slot = sharding.number("" if r["doc_id"] is None else str(r["doc_id"]), 0) % 13
        assert (r["slot"], r["shard"]) == (slot, shards[table[slot]])
    sharding.write_shards(docs, str(tmp_path / "out"), "doc_id", shards, 2, 13)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_written_shards_are_even_and_few(spark, tmp_path):
    """32 shards of three files: all keys in their shard, files alike in size even with one hot key."""
    docs = spark.range(60_000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "id as n").repartition(5)
    shards = [f"s{k}" for k in range(32)]
    sharding.write_shards(docs, str(tmp_path / "out"), "doc_id", shards, 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("n").distinct().count() == back.count() == 60_000
    wrong = back.join(sharding.placed(docs, "doc_id", shards).selectExpr("n", "shard as own"), "n").where("shard <> own")
    assert wrong.count() == 0
    files = [[len(list(d.glob("*.parquet")))] for d in (tmp_path / "out").iterdir() if d.is_dir()]
    assert len(files) == 32 and max(files) == [3]
    sizes = back.groupBy("shard", F.input_file_name().alias("f")).count().groupBy("shard").agg(F.min("count").alias("a"), F.max("count").alias("b")).collect()
    assert all(r["b"] <= 1.2 * r["a"] + 20 for r in sizes)
    sharding.write_shards(docs, str(tmp_path / "by_size"), "doc_id", shards)
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "by_size").iterdir() if d.is_dir())


# --------------------------------------------------------------------------------------------- licenses


def test_anchors_cover_every_template():
    marks = set(license_scan.anchors(list(license_scan.TEMPLATES.values())))
    for text in license_scan.TEMPLATES.values():
        shingles = set(license_scan.shingles_of_template(text))
        assert sum(not set(s) & marks for s in shingles) < 0.8 * len(shingles)


@pytest.mark.parametrize("limit", [license_scan.BROADCAST_BYTES, 0])
def test_license_edits(spark, limit):
    rnd = random.Random(3)
    docs, sure = [], set()
    names = list(license_scan.TEMPLATES)
    for k in range(60):
        name = rnd.choice(names)
        words = license_scan.TEMPLATES[name].split()
        if k % 3 == 0 and len(words) > 40:
            words[rnd.randrange(len(words))] = "changed"
        fill = [f"f{rnd.randrange(999)}" for _ in range(rnd.randint(0, 300))]
        at = rnd.randint(0, len(fill))
        docs.append((k, " ".join(fill[:at] + words + fill[at:])))
        sure.add((k, name))
    docs += [(100, "plain prose about a license and a copyright"), (101, None), (102, "")]
    found = license_scan.scan(spark.createDataFrame(docs, "doc_id int, text string"), broadcast_bytes=limit).collect()
    pairs = {(r["doc_id"], r["license"]) for r in found}
    assert sure <= pairs and not {p for p in pairs if p[0] >= 100}
    assert all(r["matched"] >= 0.8 * r["of"] for r in found)


@pytest.mark.parametrize("limit", [license_scan.BROADCAST_BYTES, 0])
def test_short_notices_and_template_tables(spark, limit):
    """Templates of fewer than five words match inside longer texts; templates may come as a table."""
    rows = [("short", "All rights reserved."), ("one", "Proprietary"), ("long", "this is a longer notice of seven words"), ("none", "--"), (None, None)]
    known = spark.createDataFrame(rows, "license string, body string")
    docs = [(1, "Copyright 2020 Somebody. All Rights  RESERVED, and more."), (2, "all rights are reserved"), (3, "proprietary"), (4, "All rights reserved"), (None, "x this is a longer notice of seven words y")]
    found = license_scan.scan(spark.createDataFrame(docs, "doc_id int, text string"), known, broadcast_bytes=limit).collect()
    assert sorted((str(r["doc_id"]), r["license"], r["first_shingle"]) for r in found) == [("1", "short", 2), ("3", "one", 0), ("4", "short", 0), ("None", "long", 0)]
    assert license_scan.scan(spark.createDataFrame(docs, "doc_id int, text string"), known.limit(0)).collect() == []


# ---------------------------------------------------------------------------------------------- SimHash


@pytest.mark.parametrize("radius", [1, 3, 4, 5])
@pytest.mark.parametrize("k, more", [(0, 0), (3, 0), (6, 0), (4, 2)])
def test_buckets_together_link_every_near_pair(radius, k, more):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 2**63, 40, np.uint64)
    flips = rng.integers(0, 64, (40, 8))
    fps = list(base) + [base[i] ^ np.uint64(sum(1 << int(b) for b in set(flips[i][: i % 8]))) for i in range(40)]
    fps = np.unique(np.array(fps, np.uint64))
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(1 << k + more):
        for u, v in zip(*simhash.bucket_links(fps, b, radius, k, more)):
            x, y = find(int(u)), find(int(v))
            parent[max(x, y)] = min(x, y)
    expect = components({int(f): int(f) for f in fps}, radius)
    assert {f: find(f) for f in parent} == expect


def test_pairs_at_an_odd_radius(spark):
    """Fingerprints exactly five bits apart link at radius five, and not at four."""
    fps = spark.createDataFrame([(0,), (0b11111,), (0b11111 << 40 | 0b11111,), (1 << 62,)], "fp bigint")
    links = [sorted(map(tuple, simhash.ball_links(fps, 4, r).collect())) for r in (4, 5)]
    assert len(links[0]) == 1 and {x for link in links[1] for x in link} == {0, 0b11111, 0b11111 << 40 | 0b11111, 1 << 62}


def test_fan_out_stays_small():
    """Buckets that a fingerprint is sent to: with k bits of hash 1 + k + k (k - 1) / 2, whatever its 2,081 variants."""
    for k in (0, 5, 12, 16, 20):
        assert simhash.sent_to(4, k) == 1 + k + k * (k - 1) // 2


def check_groups(found, docs):
    prints = {k: fingerprint(t) for k, t in docs}
    classes = components(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {k: (f"{prints[k]:016x}", classes[k]) for k in prints}


def test_simhash_on_data(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check_groups(queries.op9_simhash_dedup(spark, SMALL).collect(), docs)


def test_simhash_chains_in_many_buckets(spark, monkeypatch, tmp_path):
    """Near copies that link in chains, with buckets of very few variants."""
    monkeypatch.setattr(simhash, "BUCKET_VARIANTS", 1 << 14)
    monkeypatch.setattr(simhash, "AT_ONCE", 1 << 12)
    rnd = random.Random(5)
    docs = []
    for g in range(12):
        words = [f"w{rnd.randrange(500)}" for _ in range(300)]
        for _ in range(8):
            words = words[:]
            words[rnd.randrange(300)] = f"w{rnd.randrange(500)}"
            docs.append((len(docs), " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, docs[0][1].upper()), (1003, "a b"), (1004, "A  B")]
    tables.write(spark, tmp_path, [(k, t, None, None, None) for k, t in docs])
    found = queries.op9_simhash_dedup(spark, str(tmp_path)).collect()
    check_groups(found, docs)
    kept = simhash.deduplicated(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in found})


def test_pipeline_stage_drops_similar_texts(spark):
    """Near copies of similarity 0.8 and more whose fingerprints differ in more than four bits."""
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    classes = similar_classes(texts)
    assert len(set(classes.values())) < len(set(components({k: fingerprint(t) for k, t in texts}).values()))
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, path).collect()]
    assert sorted(kept) == sorted(set(classes.values()))


def test_similar_texts_on_both_sides_of_the_bound(spark):
    """Shingle sets of 60 with 52 to 55 in common; two links in a chain; copies and texts without words."""
    base = [f"w{k}" for k in range(64)]
    docs = [(0, " ".join(base))]
    docs += [(n, " ".join(base[: n + 4] + [f"x{n}_{k}" for k in range(60 - n)])) for n in (52, 53, 54, 55)]
    docs += [(100, " ".join(base).upper()), (101, None), (102, ""), (103, "a b"), (104, "A  B"), (105, "a c")]
    classes = similar_classes(docs)
    kept = simhash.deduplicated(spark.createDataFrame(docs, "doc_id int, text string"), similar=0.8).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(classes.values()))
    assert classes[54] == 0 and classes[104] == 103 and classes[105] == 105


def thirteen_words(k):
    """Two texts of nine shingles, eight of them in both: a similarity of 0.8."""
    words = [f"w{k}_{j}" for j in range(13)]
    return words, " ".join(words), " ".join(words[:12] + [f"x{k}"])


def test_similar_texts_that_share_no_band_or_no_centre(spark):
    """Pair 22911 shares no band; the one band of pair 414 has a third text as centre, which resembles neither."""
    words, a, b = thirteen_words(414)
    third = " ".join(words[:12] + [f"y13_{i}" for i in range(6)])
    keys = simhash.band_keys([simhash.shingle_set(t) for t in (a, b, third)])
    assert all(((keys[i] == keys[j]) == (keys[0] == keys[1])).all() for i, j in ((0, 2), (1, 2))) and (keys[0] == keys[1]).sum() == 1
    _, c, d = thirteen_words(22911)
    assert not np.equal(*simhash.band_keys([simhash.shingle_set(t) for t in (c, d)])).any()
    docs = list(enumerate([a, b, third, c, d]))
    classes = similar_classes(docs)
    assert classes == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
    kept = simhash.deduplicated(spark.createDataFrame(docs, "doc_id int, text string"), similar=0.8).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 3]


@pytest.mark.parametrize("similar", [0.5, 0.8, 0.855, 1])
@pytest.mark.parametrize("often", [0, 40])
def test_prefixes_meet_for_all_similar_sets(similar, often, monkeypatch):
    """Every pair of the similarity in different classes, whatever shingles come last; pairs of one class never."""
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    rnd = random.Random(often)
    p, q = simhash.ratio(similar)
    sets = []
    for _ in range(30):
        base = rnd.sample(range(100), rnd.randint(1, 25))
        for _ in range(6):
            changed = set(base)
            for _ in range(rnd.randint(0, 3)):
                changed ^= {rnd.randrange(100)}
            sets.append(np.array(sorted(changed or {0}), np.uint64))
    frequent = np.array(sorted(rnd.sample(range(100), often)), np.uint64)
    order = np.array(rnd.sample(range(often), often), np.int64)
    rows, roots = [], [rnd.randrange(20) for _ in sets]
    for k, x in enumerate(sets):
        rows += [(k, roots[k], len(x), place, gram) for place, gram in enumerate(simhash.prefix(x, frequent, order, p, q))]
    entries = np.array(rows, simhash.ENTRY)
    met = set()
    for i, j in simhash.met_pairs(entries, p, q):
        met |= {tuple(sorted(x)) for x in zip(entries["set_id"][i].tolist(), entries["set_id"][j].tolist())}
    plain = [set(x.tolist()) for x in sets]
    alike = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if roots[i] != roots[j] and q * len(plain[i] & plain[j]) >= p * len(plain[i] | plain[j])}
    sketches = [simhash.sketch(x * np.uint64(0x9E3779B97F4A7C15)) for x in sets]
    assert all(simhash.may_be_alike(sketches[i], sketches[j], len(sets[i]) + len(sets[j]), p, q) for i, j in alike)
    assert alike and alike <= met and all(roots[i] != roots[j] for i, j in met)


def test_components_of_long_chains(spark):
    links = [(k, k - 1) for k in range(1, 200)] + [(1000 + k, 1000) for k in range(1, 300)] + [(-5, 7), (3, 3)]
    found = simhash.components(spark.createDataFrame(links, "u bigint, v bigint"))
    roots = {r["u"]: r["root"] for r in found.collect()}
    assert all(roots[k] == -5 for k in range(200)) and all(roots[1000 + k] == 1000 for k in range(1, 300))


def test_repeated_rows_count_as_one_document(spark, tmp_path):
    docs = spark.read.parquet(f"{tables.write(spark, tmp_path)}/documents.parquet")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 1 and max(ids.values()) == 1

"""Each operator against brute force, and on rows that are awkward: nulls in any column, empty and very long texts, ties,
repeated rows, empty tables, columns whose names clash with the operator's own."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import components, langid, media, mixing, packing, repair, sharding, simhash, tokens, toxicity, urllist, vecdedup

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ["id", "fp", "rank", "size", "pattern", "taken", "slot", "shard", "part", "row", "seq", "label", "score", "component_id", "u", "k0", "nid"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    long = words(rng, 30_000)
    plain = [words(rng, rng.randint(1, 60)) for _ in range(12)]
    near = plain[3] + " " + words(rng, 1)
    return [None, "", " \n\t", "a", "%%% 123", "é ñ ß", long, *plain, plain[0], plain[0], near, "x" * 50_000, "line\n\n  two   gaps \n", "<|endoftext|> # end", "ünï\x1ccode 中文 🙂"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    rows += [rows[8], (None, None, None, None, None), (None, "null id", None, "s1", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(ids, linked):
    """The smallest id reachable from each, by brute force."""
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(ids))]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 30)] + [(rng.randint(40, 60), rng.randint(40, 60)) for _ in range(12)] + [(5, 5), (100, 90)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    links = {frozenset(p) for p in pairs}
    assert [got[n] for n in nodes] == groups(nodes, lambda a, b: frozenset((nodes[a], nodes[b])) in links) and len(got) == len(nodes)
    assert components.components(df.where("false")).count() == 0


# ---- 6


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    for t in [*texts, "A b C d E", "one two three", "a a a a a a a"]:
        if len(t or "") < 60_000:
            assert simhash.fingerprint(t) == brute_print(t), t


def test_simhash(docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(docs).collect()
    prints = [simhash.fingerprint(r["text"]) for r in rows]
    expected = groups([r["doc_id"] for r in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert Counter(map(tuple, got)) == Counter(zip([r["doc_id"] for r in rows], signed, expected, strict=True))
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_near_links_find_all(spark, bucket, monkeypatch):
    """Also with hot buckets cut into blocks, and more masks."""
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = random.Random(5)
    bases = [rng.getrandbits(64) for _ in range(40)]
    prints = set()
    for _ in range(500):
        p = rng.choice(bases[:3] if rng.random() < 0.4 else bases)
        for _ in range(rng.randint(0, 9)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.near_links(df, bucket=bucket)).collect()}
    assert [found.get(p, p) for p in prints] == groups(prints, lambda a, b: ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 4)


# ---- 2


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "BLOCK", 20)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, 6))
    v = [(base[i % 8] + rng.normal(size=6) * rng.choice([0.02, 0.1, 1])).tolist() for i in range(150)]
    rows = [(i, x, int(i % 3)) for i, x in enumerate(v)] + [(200 + i, v[0], 0) for i in range(30)] + [(250, [2 * y for y in v[0]], 0), (250, v[0], 0), (251, v[0], 1)]
    rows += [(300, None, 0), (301, [0.0] * 6, 0), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (303, [float("nan")] * 6, 0), (304, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], 0), (305, [], 0), (306, v[0], None), (307, v[0][:5], 0), (None, v[0], 0), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "h1", "mult", "cell", "sound", "least")})
    sound = [x is not None and lab is not None and len(x) > 0 and all(y is not None and np.isfinite(y) for y in x) and any(x) for _, x, lab in rows]

    def linked(a, b):
        (_, x, p), (_, y, q) = rows[a], rows[b]
        return bool(sound[a] and sound[b] and p == q and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98)

    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    expected = groups([r[0] for r in rows], linked)
    got = vecdedup.near_vectors(df).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], k, e, r[0] == e) for r, k, e in zip(rows, n, expected, strict=True))
    assert vecdedup.near_vectors(df.where("false")).count() == 0


# ---- 1 and 4


def test_languages(spark, docs, nothing):
    rng = random.Random(2)
    kinds = {"en": "abcdeft", "de": "ghijklt", "fr": "mnopqét", "es": "rsñuvwt", "xx": "ωψχφυτ"}
    rows = [(i, words(rng, rng.randint(5, 40), kinds[lang]), lang, None, 0) for i, lang in enumerate(sorted(kinds) * 40)]
    train = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit_languages(train)
    lang, score = model.predict(pa.array([words(rng, 20, kinds[k]) for k in sorted(kinds)]))
    assert lang.tolist() == sorted(kinds) and (score > 0.5).all() and (score <= 1).all()
    out = docs.withColumn("p", langid.predicted(model, F.col("text"))).select("text", "p.lang", "p.score").collect()
    assert len(out) == docs.count()
    assert all((r["lang"] == "und" and r["score"] == 0) == (not any(c.isalpha() for c in r["text"] or "")) for r in out)
    none = langid.fit_languages(nothing)
    assert none.predict(pa.array(["abc", None]))[0].tolist() == ["und", "und"]
    assert langid.fit_languages(train.where("lang = 'en'")).predict(pa.array(["ωψ"]))[0].tolist() == ["en"]
    # a text scores the same whole or in chunks
    long = pa.array([words(rng, 3000, kinds["de"])])
    before, langid.CHUNK = langid.CHUNK, 500
    try:
        parts = langid.margins(long, model.weights)
    finally:
        langid.CHUNK = before
    assert np.allclose(parts, langid.margins(long, model.weights))


def test_toxicity(spark, docs, nothing):
    rng = random.Random(4)
    bad = ["idiotic", "wretched", "scumbag"]

    def text(toxic):
        w = words(rng, rng.randint(20, 120), "aehinorst").split()
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), None, None, 0) for i in range(600)]
    train = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (3, 0, None), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(train, labels)
    score = model.score(pa.array([text(i % 2 == 0) for i in range(100)]))
    assert ((score >= 0.5) == (np.arange(100) % 2 == 0)).mean() > 0.95
    # what was never seen shares n-grams with what was; one word among thousands counts; repeating a harmless one does not
    plain = [words(rng, 30, "aehinorst") for _ in range(3)]
    assert model.score(pa.array([plain[0] + " idiotik scumbagg " + plain[1]]))[0] > model.score(pa.array([plain[0] + " " + plain[1]]))[0]
    long = words(rng, 4000, "aehinorst")
    assert model.score(pa.array([long + " idiotic scumbag wretched " + long]))[0] >= 0.5 > model.score(pa.array(["the " * 500]))[0]
    out = docs.withColumn("s", toxicity.toxicity(model, F.col("text"))).select("text", "s").collect()
    assert len(out) == docs.count() and all(0 <= r["s"] <= 1 for r in out)
    assert len({r["s"] for r in out if not (r["text"] or "").strip()}) == 1
    assert len(set(toxicity.fit_toxicity(nothing, labels).score(pa.array(["a", None, "b"])).tolist())) == 1
    assert toxicity.fit_toxicity(train, labels.where("false")).score(pa.array(["a"]))[0] == 0.5
    before, toxicity.CHUNK = toxicity.CHUNK, 2000
    try:
        parts = model.score(pa.array([long, None, plain[0]]))
    finally:
        toxicity.CHUNK = before
    assert np.allclose(parts[2], model.score(pa.array([plain[0]])))


# ---- 3


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 70):
        for data in (rng.integers(0, 256, 64 * n).astype(np.uint8), np.arange(64 * n).astype(np.uint8)):
            png = media.encode_png(data.tobytes())
            assert media.decode_png(png).tobytes() == data.tobytes()
            broken = bytearray(png)
            broken[len(png) // 2] ^= 1
            with pytest.raises(ValueError):
                media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.encode_png(b"")


def test_png_filters():
    """All five filters, against a filter written out by pixels."""
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (12, 9)).astype(int)
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 2, 2, 1, 0, 4], np.uint8)
    stored = np.zeros_like(image)
    for r in range(12):
        for c in range(9):
            a, b, d = image[r, c - 1] if c else 0, image[r - 1, c] if r else 0, image[r - 1, c - 1] if r and c else 0
            paeth = min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
            stored[r, c] = (image[r, c] - [0, a, b, (a + b) // 2, paeth][kinds[r]]) % 256
    assert (media._unfilter(kinds, stored.astype(np.uint8)) == image).all()


def test_media(docs, nothing):
    rows = media.with_media(docs, F.col("text"), "score").select("text", media.features(F.col("score")).alias("f")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        data = media.padded(r["text"])
        assert (r["f"]["payload_bytes"], r["f"]["payload_sha256"], r["f"]["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert len(r["f"]["low_hash"]) == 8
    assert media.with_media(nothing, F.col("text")).count() == 0
    assert media.padded(None) == bytes(64) and len(media.padded("x" * 64)) == 64


# ---- 5


def test_url_list(spark):
    rng = random.Random(6)
    entries = ["a.com", "b.a.com", "a.com/x", "c.org", "10.0.0.1", "0.1"]
    events = [(rng.choice(entries), rng.random() < 0.6, rng.randint(0, 90) * 86_400) for _ in range(40)] + [(None, True, 5), ("a.com", None, 5), ("a.com", True, None)]
    urls = ["http://a.com/x/y", "https://u:p@Z.B.A.com:80/X?q", "ftp://a.com", "http://aa.com/x", "http://c.org./", "http://10.0.0.1/x", "http://[::1]/x", "nonsense", "", None]
    captures = [(i, rng.choice(urls), rng.randint(-5, 95) * 86_400) for i in range(150)] + [(7, urls[0], 86_400), (7, urls[0], 86_400), (8, urls[0], None), (None, None, None)]
    sites = {"http://a.com/x/y": ("a.com", "x"), urls[1]: ("z.b.a.com", "x"), "ftp://a.com": ("a.com", None), "http://aa.com/x": ("aa.com", "x"), "http://c.org./": ("c.org", None), "http://10.0.0.1/x": ("10.0.0.1", "x"), "http://[::1]/x": ("[::1]", "x")}

    def active(entry, t):
        state, since = False, None
        for at in sorted({e[2] for e in events if e[0] == entry and None not in e and e[2] <= t}):
            add = any(e[1] for e in events if e[0] == entry and e[2] == at and e[1] is not None)
            since = at if add and not state else since
            state = add
        return since if state else None

    def expected(i, url, t):
        host, segment = sites.get(url, (None, None))
        if host is None or t is None:
            return (i, host, t, False, 0, None, None)
        labels = host.split(".")
        domains = [host] if re.fullmatch(r"[0-9.]+|\[.*\]", host) else [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))]
        hits = [(len(e), e, active(e, t)) for e in domains + ([f"{d}/{segment}" for d in domains] if segment else []) if active(e, t) is not None]
        top = max(hits, default=(0, None, None))
        return (i, host, t, bool(hits), len(hits), top[1], top[2])

    df = spark.createDataFrame(captures, "page_id long, url string, at long").withColumns({c: F.lit("x") for c in ("id", "host", "entry", "since", "stretch", "spans")})
    list_ = spark.createDataFrame(events, "entry string, add boolean, at long")
    got = urllist.active_entries(df, list_).collect()
    assert Counter(map(tuple, got)) == Counter(expected(*c) for c in captures)
    assert urllist.active_entries(df, list_.where("false")).where("blocked").count() == 0
    assert urllist.active_entries(df.where("false"), list_).count() == 0


# ---- 7 and 10


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder(library):
    rng = random.Random(1)
    bits = ["a", "b", "'s", " ", "  ", "\n", "\t", "é", "1", "23", "!", "<|endoftext|>", " ", "中", "🙂", "\x1c", "\r\n", "The", "?).", ",", "²", "ª", "'", "\0", " ", "​"]
    some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    encoder = tokens.Encoder.of(TOKENIZER)
    for _ in range(2):
        ids, n = encoder.encode(some)
        at = 0
        for text, size in zip(some, n, strict=True):
            assert ids[at : at + size].tolist() == library(text), repr(text)
            at += size


def test_blocks():
    rng = np.random.default_rng(3)
    for docs_ in (1, 30):
        parts = [np.concatenate((rng.choice([5, 6, 7, 2, 70_000], rng.integers(0, 900), p=[0.4, 0.3, 0.2, 0.05, 0.05]), [2])).astype(np.uint32) for _ in range(docs_)]
        data = repair.compress(np.concatenate(parts), np.array([len(p) for p in parts]))
        block = repair.Block(data)
        ids, n = block.all()
        assert (ids == np.concatenate(parts)).all() and n.tolist() == [len(p) for p in parts]
        for k in range(docs_):
            a, b = sorted(rng.integers(0, len(parts[k]) + 3, 2).tolist())
            assert block.ids(k, a, b).tolist() == parts[k][a:b].tolist() and block.ids(k).tolist() == parts[k].tolist()
        with pytest.raises(ValueError):
            repair.Block(data[:40] + bytes([data[40] ^ 1]) + data[41:])
    many = np.tile(np.array([5, 6, 7, 8], np.uint32), 5000)
    assert len(repair.compress(np.append(many, 2).astype(np.uint32), np.array([20_001]))) < 2000


def test_token_file(docs, nothing, library):
    rows = docs.select("doc_id", "text").collect()
    got = repair.read_tokens(repair.write_tokens(docs, TOKENIZER)).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    start, expected = 0, []
    for r in order:
        ids = np.array([*library(r["text"]), 2], "<u4")
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert Counter(tuple(r)[:4] for r in got) == Counter(expected)
    assert repair.read_tokens(repair.write_tokens(nothing, TOKENIZER)).count() == 0


def test_packing(docs, nothing, library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    rows = docs.select("doc_id", "text").collect()
    got = packing.pack(docs, TOKENIZER, window=64).collect()
    length = Counter()
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        length[at] += 1
    assert max(length) <= 64 and sum(n for k, n in length.items() if k < 64) <= 1
    # the pieces of each document, whichever of equal ones they belong to
    expected = Counter((r["doc_id"], zlib.crc32(np.array([*library(r["text"]), 0], "<u4").tobytes())) for r in rows)
    assert sum(r["length"] for r in got) == sum(len(library(r["text"])) + 1 for r in rows)
    single = {k[0] for k, n in Counter((r["doc_id"],) for r in rows).items() if n == 1}
    for r in rows:
        if r["doc_id"] in single:
            ids, at = np.array([*library(r["text"]), 0], "<u4"), 0
            for p in sorted((p for p in got if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"]) if "doc_id" in got[0] else sorted((p for p in got if p["id"] == r["doc_id"]), key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
    assert expected and packing.pack(nothing, TOKENIZER).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(2)
    histogram = np.bincount(np.concatenate((rng.integers(1, 128, 4000), np.full(3000, 50))), minlength=128)
    combos, counts = packing.solve(histogram, 128)
    used = np.zeros(128, np.int64)
    for c, n in zip(combos, counts, strict=True):
        assert c.sum() == 128
        for x in c[c > 0]:
            used[x] += n
    assert (used <= histogram).all() and (used * np.arange(128)).sum() > 0.3 * (histogram * np.arange(128)).sum()


# ---- 8


def test_water_fill():
    from fractions import Fraction as Q

    assert mixing.water_fill([Q(1), Q(2)], [Q(100), Q(3)], Q(30)) == [27, 3]
    assert mixing.water_fill([Q(1), Q(1)], [Q(1), Q(1)], Q(30)) == [1, 1]
    assert mixing.water_fill([], [], Q(0)) == []


def test_overlapping_sources():
    """Fresh tokens first, repeats spread, and every quota met that can be."""
    flow = mixing.route([(("a",), 100), (("a", "b"), 100), (("b",), 10)], {"a": 150, "b": 80})
    assert sum(f.get("a", 0) for f in flow) == 150 and sum(f.get("b", 0) for f in flow) == 80
    assert all(sum(f.values()) <= n + 20 for f, n in zip(flow, (100, 100, 10), strict=True))


def test_mixing(spark, docs, nothing):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for r in rows:
        total[r["source"]] += size(r["text"])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    share, open_, left = {}, set(names), sum(total.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    while True:
        given = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if given[s] >= 3 * total[s]}
        share |= given | {s: 3 * total[s] for s in full}
        if not full or full == open_:
            break
        left, open_ = left - sum(3 * total[s] for s in full), open_ - full
    got = mixing.mix(docs).collect()
    assert Counter((r["id"], r["size"]) for r in got) == Counter((r["doc_id"], size(r["text"])) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_target = Counter()
    for r in got:
        by_target[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s in names:
        assert abs(by_target[total[s], round(share[s], 6)] - share[s]) <= 1
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mix(nothing).count() == 0
    several = spark.createDataFrame([(1, "a b c", ["x", "y", None]), (2, "d e", ["x"]), (3, "f", []), (4, "g", None)], "doc_id long, text string, source array<string>")
    assert mixing.mix(several).count() == 4


def test_mixing_ties(spark, monkeypatch):
    """Thousands of equal rows are cut where they must be."""
    monkeypatch.setattr(mixing, "FEW", 5)
    df = spark.range(300).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 50, "p").otherwise("q").alias("source"))
    got = mixing.mix(df).groupBy("target").agg(F.sum("taken")).collect()
    assert {round(r[0]): r[1] for r in got} == {200: 200, 400: 400}


# ---- 9


def test_sharding(spark, docs, nothing):
    names, slots = ("a", "b", "c"), 31
    table = {r["slot"]: r["shard"] for r in sharding.lookup_table(spark, names, slots).collect()}
    h = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    free, owner = set(range(slots)), {}
    for t in range(slots):
        s = names[t % 3]
        a, b = 1 + h(f"{s}:step") % (slots - 1), h(f"{s}:offset") % slots
        pick = min(free, key=lambda x: (a * x + b) % slots)
        free.remove(pick)
        owner[pick] = s
    assert table == owner and max(Counter(owner.values()).values()) - min(Counter(owner.values()).values()) <= 1
    fewer = {r["slot"]: r["shard"] for r in sharding.lookup_table(spark, names[:2], slots).collect()}
    assert sum(table[s] != fewer[s] for s in table if table[s] != "c") <= 12
    out = sharding.place(docs, F.col("doc_id"), names, slots)
    assert len(out.columns) == len(docs.columns) and out.count() == docs.count()
    assert all(r["shard"] == owner[h("" if r["doc_id"] is None else str(r["doc_id"])) % slots] for r in out.select("doc_id", "shard").collect())
    assert sharding.place(nothing, F.col("doc_id"), names, slots).count() == 0
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.lookup_table(spark, bad, slots)
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 30)


# ---- the pipeline


def test_pipeline(spark, docs, nothing, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(8, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (plain, nothing):
        now = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = now.count()
            now = stage(spark, now, str(tmp_path))
            if i < 4:
                assert now.columns == plain.columns, name
                assert name == "mixing" or now.count() <= before
        if start is nothing:
            assert now.count() == 0
    kept = corpus_pipeline.drop_copies(spark, plain, str(tmp_path)).select("doc_id", "text").collect()
    prints = [simhash.fingerprint(r["text"]) for r in kept]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_pipeline_drops_near_copies(spark, tmp_path):
    """Pairs of similarity 0.8 to 0.95 are found, those below stay, and what stays is what brute force leaves."""
    import corpus_pipeline

    rng = random.Random(11)
    texts = []
    for k in range(300):
        w = words(rng, rng.randint(60, 200)).split()
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 1, 1, 2])):
            v = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 30))):
                v[rng.randrange(len(v))] = "changed" + str(rng.randrange(10**6))
            texts.append(" ".join(v))
    texts += [texts[0], texts[0].upper(), "one two", "one  two", "one three"]
    hot = words(rng, 120).split()
    texts += [" ".join([*hot[: 60 + i % 60], f"t{i}", *hot[60 + i % 60 :]]) for i in range(80)]
    rng.shuffle(texts)
    near = {(a, b): j for a in range(len(texts)) for b in range(a) if (j := jaccard(texts[a], texts[b])) >= 0.8}
    assert sum(0.8 <= j < 0.95 for j in near.values()) > 100
    far = [(simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 4 for a, b in near]
    assert sum(far) > 50
    least = groups(list(range(len(texts))), lambda a, b: (a, b) in near)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = corpus_pipeline.drop_copies(spark, df, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(least))
    assert all(r["text"] == texts[r["doc_id"]] for r in got)


def test_pipeline_drops_what_is_no_language(spark, tmp_path):
    """Garbled, foreign and half-and-half texts and junk with a few letters go; short clean ones stay."""
    import corpus_pipeline

    rng = random.Random(12)
    parts = {"en": ["the", "and", "ing", "tion", "ow", "th"], "de": ["ein", "sch", "ung", "der", "ü", "zu"], "fr": ["eau", "ou", "que", "les", "é", "ment"], "es": ["ción", "os", "el", "ado", "ñ", "ar"]}

    def prose(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    clean = [(prose(lang, rng.randint(30, 120)), lang) for lang in sorted(parts) * 100] + [(prose(lang, 4), lang) for lang in sorted(parts) * 10]
    bad = [words(rng, 40, "abcdefghijklmnopqrstuvwxyz") for _ in range(10)]
    bad += ["Все люди рождаются свободными и равными в своем достоинстве", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van", "人人生而自由,在尊严和权利上一律平等"]
    bad += ["@@## 12345678 and 5567 %% x 99 $$$ 4711 ###", "12345 67890", "", None]
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(clean)] + [(1000 + i, t, None, "s", 0) for i, t in enumerate(bad)]
    halves = [prose(a, 60) + " " + prose(b, 60) for a, b in (("en", "fr"), ("de", "es"), ("en", "de"), ("fr", "es")) for _ in range(10)]
    rows += [(2000 + i, t, None, "s", 0) for i, t in enumerate(halves)]
    out = corpus_pipeline.keep_languages(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    kept = {r["doc_id"]: r["lang"] for r in out}
    assert len(out) == len(kept)
    assert [kept.get(i) for i in range(len(clean))] == [lang for _, lang in clean]
    assert not [bad[i - 1000] for i in kept if 1000 <= i < 2000]
    assert sum(i >= 2000 for i in kept) <= len(halves) // 4


def test_pipeline_drops_toxic(spark, tmp_path):
    """Exactly the rows whose text the model scores below TOXIC, and null texts, stay."""
    import corpus_pipeline

    rng = random.Random(13)
    toxic = [i % 4 == 0 for i in range(400)]
    texts = []
    for bad in toxic:
        w = words(rng, rng.randint(20, 80), "aehinorst").split()
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiotic", "wretched", "scumbag"]))
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(900, None, "en", "s", 0), (5, texts[5], "en", "s", 0)], SCHEMA)
    spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic) if i < 300], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter(map(tuple, corpus_pipeline.keep_clean(spark, df, str(tmp_path)).collect()))
    model = toxicity.fit_toxicity(df, spark.read.parquet(str(tmp_path / "labels.parquet")))
    rows = [tuple(r) for r in df.collect()]
    score = [0 if r[1] is None else model.score(pa.array([r[1]]))[0] for r in rows]
    assert got == Counter(r for r, x in zip(rows, score, strict=True) if x < 0.5)
    kept = {r[0] for r in got}
    assert sum((i in kept) == (not toxic[i]) for i in range(400)) >= 390


def test_pipeline_mixes(spark, tmp_path):
    """Copies of each document, with one source far larger than the rest."""
    import corpus_pipeline

    rng = random.Random(14)
    rows = [(i, words(rng, rng.randint(0, 30)), "en", "hot" if i % 10 else rng.choice(["a", "b", None]), 0) for i in range(300)]
    size = {r[0]: len(r[1].split()) for r in rows}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    share, open_, left = {}, set(names), sum(total.values())
    while open_:
        weight = {s: names.index(s) % 3 + 1 for s in open_}
        given = {s: left * weight[s] / sum(weight.values()) for s in open_}
        full = {s for s in open_ if given[s] >= 3 * total[s]}
        if not full:
            share |= given
            break
        share |= {s: 3 * total[s] for s in full}
        left, open_ = left - sum(3 * total[s] for s in full), open_ - full
    expected = Counter()
    for s in names:
        passes, rest = divmod(min(3 * total[s], round(share[s])), total[s])
        own = [r for r in rows if r[3] == s]
        for r in sorted(own, key=lambda r: int(hashlib.md5(f"0:{r[0]}".encode()).hexdigest()[:15], 16)):
            n = size[r[0]]
            extra = min(n, rest)
            rest -= extra
            if n and (copies := int((passes * n + extra) / n + 0.5)):
                expected[r] += copies
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert Counter(map(tuple, corpus_pipeline.mix_sources(spark, df, str(tmp_path)).collect())) == expected


# ---- 7, beyond round trips


def textbook(docs_, least):
    """(rules, symbols left) of Re-Pair, one most frequent pair at a time, on lists of ids."""
    docs_, rules = [list(d) for d in docs_], 0
    while True:
        counts: Counter = Counter()
        for d in docs_:
            last = {}
            for i, pair in enumerate(zip(d, d[1:], strict=False)):
                if pair[0] != pair[1] or last.get(pair) != i - 1:
                    counts[pair] += 1
                    last[pair] = i
        if not counts or max(counts.values()) < least:
            return rules, sum(map(len, docs_))
        best = max(sorted(counts), key=counts.get)
        for k, d in enumerate(docs_):
            out, i = [], 0
            while i < len(d):
                out.append(-1 - rules if tuple(d[i : i + 2]) == best else d[i])
                i += 2 if tuple(d[i : i + 2]) == best else 1
            docs_[k] = out
        rules += 1


@pytest.mark.parametrize("least", [2, 4])
def test_blocks_are_compressed_to_the_end(least):
    """No pair is left that occurs `least` times, and the grammar is about as small as the textbook's."""
    rng = np.random.default_rng(5)
    for letters in (2, 4, 9, 40):
        docs_ = [rng.integers(3, 3 + letters, rng.integers(0, 250)).tolist() for _ in range(25)]
        docs_ += docs_[:4] + [docs_[5] * 3, [3] * 100, []]
        flat = np.array([x for d in docs_ for x in [*d, 2]], np.uint32)
        block = repair.Block(repair.compress(flat, np.array([len(d) + 1 for d in docs_]), least=least))
        assert (block.all()[0] == flat).all()
        counts: Counter = Counter()
        for k in range(len(docs_)):
            seq, last = block.seq[block.starts[k] : block.starts[k + 1] - 1].tolist(), {}
            for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
                if pair[0] != pair[1] or last.get(pair) != i - 1:
                    counts[pair] += 1
                    last[pair] = i
        assert max(counts.values(), default=0) < least
        rules, left = textbook(docs_, least)
        ours = 2 * (len(block.size) - len(block.terminals) - 1) + len(block.seq) - len(docs_)
        assert ours <= 1.15 * (2 * rules + left)


def test_blocks_of_any_size(monkeypatch):
    """Where places and symbols do not fit one number, sorting goes another way to the same grammar."""
    rng = np.random.default_rng(6)
    ids = np.append(np.repeat(rng.integers(3, 50, 3000), rng.integers(1, 4, 3000)), 2).astype(np.uint32)
    data = repair.compress(ids, np.array([len(ids)]))
    plain = repair._sorted

    def other(a, b, at, out, n):
        key, place, bits = plain(a, b, at, out, 1 << 31)
        assert bits is None
        return key >> np.uint64(32) << np.uint64(n.bit_length()) | key & np.uint64((1 << 32) - 1), place, None

    monkeypatch.setattr(repair, "_sorted", other)
    assert repair.compress(ids, np.array([len(ids)])) == data


def test_token_file_of_one_id(spark, library):
    """Rows that share an id, null among them, are dealt to several tasks and lose none."""
    df = spark.range(0, 400, 1, 4).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("same text "), (F.col("id") % 3).cast("string"))).alias("text"))
    blocks = repair.write_tokens(df, TOKENIZER, parts=8)
    assert blocks.select("part").distinct().count() > 4
    got = repair.read_tokens(blocks).collect()
    want = Counter((r["doc_id"], zlib.crc32(np.array([*library(r["text"]), 2], "<u4").tobytes())) for r in df.collect())
    assert Counter((r["id"], r["ids_crc32"]) for r in got) == want
    run = sorted((r["start"], r["n_tokens"], r["id"] is not None) for r in got)
    assert [r[0] for r in run] == np.cumsum([0, *(r[1] for r in run)])[:-1].tolist() and [r[2] for r in run] == sorted(r[2] for r in run)


# ---- tokenizers that split otherwise


def test_encoder_of_another_tokenizer(tmp_path):
    """A file that asks for other splitting has its texts encoded whole."""
    from tokenizers import Tokenizer, pre_tokenizers

    some = ["a b  c", "the end.\nNext", "", "it's 23,5", "x" * 40]
    other = Tokenizer.from_file(TOKENIZER)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    for path in (str(tmp_path / "other.json"), public_tokenizers.path("word_bpe_49k.json")):
        encoder = tokens.Encoder.of(path)
        assert not encoder.by_parts
        ids, n = encoder.encode(some)
        assert ids.tolist() == [x for t in some for x in Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids] and n.sum() == len(ids)


def test_encoder_forgets(library, monkeypatch):
    """Parts beyond what a worker keeps are learned anew."""
    monkeypatch.setattr(tokens, "PARTS", 5)
    encoder = tokens.Encoder(TOKENIZER)
    for text in ["one two three four five six", "one two", "seven. eight, nine\nten"] * 2:
        assert encoder.encode([text])[0].tolist() == library(text)


def test_encoder_keeps_what_it_meets_again(library, monkeypatch):
    """Beyond what a worker keeps, parts that were met once make room, and those that come again are not learned twice."""
    monkeypatch.setattr(tokens, "PARTS", 60)
    encoder, learned = tokens.Encoder(TOKENIZER), Counter()
    plain = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: (learned.update(new.to_pylist()), plain(new))[1])
    for k in range(30):
        text = "some short and some considerably longer " + " ".join(f"{random.Random(100 * k + i).randbytes(5).hex().translate(str.maketrans('0123456789', 'ghijklmnop'))}" for i in range(20))
        assert encoder.encode([text])[0].tolist() == library(text)
    assert {learned[x] for x in ("some", " short", " and", " some", " considerably", " longer")} == {1}
    assert len(encoder.short.names) + len(encoder.long.names) <= 60 + 26


def test_encoder_of_short_and_long_parts(library):
    """Parts about the length up to which they are numbers, NUL bytes included, each new and then known."""
    some = [f"{x}{'a' * k}{y}" for k in range(12) for x in ("", " ", "\0", "é", " é", "\0\0") for y in ("", "\0", "é", "\0\0", " \0", "\n")]
    encoder = tokens.Encoder(TOKENIZER)
    for _ in range(2):
        ids, n = encoder.encode(some)
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [library(t) for t in some]


# ---- near-copies in hot buckets


@pytest.mark.parametrize("few, block", [(16, 500), (0, 7), (3, 7)])
def test_near_sets_of_hot_buckets(spark, monkeypatch, few, block):
    """Groups of which many are copies, some are copies of copies, and some only look alike: what brute force connects."""
    from quadrille.llm import shingles

    monkeypatch.setattr(shingles, "FEW", few)
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(21)
    texts = []
    for _ in range(4):
        base = words(rng, 100).split()
        now = base
        for i in range(30):
            v = list(base if i % 3 else now)
            for _ in range(rng.choice([0, 1, 1, 1, 2, 2, 4])):
                v[rng.randrange(len(v))] = f"w{rng.randrange(10**6)}"
            now = v
            texts.append(" ".join(v))
    texts += [words(rng, 80) for _ in range(20)] + [None, "", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    kept = shingles.with_bands(df, F.col("text"), "s").groupBy("s.key").agg(F.min("id").alias("id"), F.first("s.fp").alias("fp"), F.first("s.bands").alias("bands"))
    ids = sorted(r["id"] for r in kept.select("id").collect())
    got = {r["node"]: r["root"] for r in shingles.near_sets(df, kept.select("id", "fp", "bands")).collect()}
    near = {(a, b) for a in ids for b in ids if b < a and texts[a] and texts[b] and jaccard(texts[a], texts[b]) >= 0.8}
    want = groups(ids, lambda a, b: (ids[a], ids[b]) in near)
    assert [got.get(i, i) for i in ids] == want and len(set(want)) > 30 and len(ids) - len(set(want)) > 30


# ---- rows that are told apart by little, and columns of any name


def test_mixing_patterns_with_nulls(spark):
    """Arrays that differ by a null alone are patterns of their own, and no row is doubled."""
    rows = [(1, "a b c", ["x"]), (2, "d e", ["x", None]), (3, "f", [None, "x"]), (4, "g h", [None]), (5, "i", []), (6, "j k", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), targets={"x": 4, None: 3}).collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3, 4, 5, 6]
    by = {r["id"]: r for r in got}
    assert by[1]["target"] == 4 and by[2]["target"] == by[3]["target"] == 7 and by[4]["target"] == by[5]["target"] == 3
    assert by[2]["source_size"] == by[3]["source_size"] and sum(r["taken"] for r in got) == 7


def test_mixing_rows_of_one_id(spark, monkeypatch):
    """Rows that share an id are cut by text, then by place, in steps; the words taken still add up."""
    monkeypatch.setattr(mixing, "FEW", 3)
    df = spark.range(0, 500, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("w"), (F.col("id") % 90).cast("string")).alias("text"), F.when(F.col("id") < 90, "p").otherwise("q").alias("source"))
    got = mixing.mix(df).collect()
    assert len(got) == 500 and {round(t): sum(r["taken"] for r in got if round(r["target"]) == round(t)) for t in {r["target"] for r in got}} == {333: 333, 667: 667}
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(3)).collect()))


def test_route_is_least_cost():
    """Flows against all ways to take whole words of small patterns."""
    from itertools import product

    rng = random.Random(8)
    for _ in range(40):
        patterns = [(p, rng.randint(1, 2)) for p in rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)]
        targets = {s: rng.randint(0, 4) for s in "abc"}
        flow = mixing.route(patterns, targets, 2)
        out = [sum(f.values()) for f in flow]
        into = {s: sum(f.get(s, 0) for f in flow) for s in "abc"}
        assert all(into[s] <= targets[s] for s in "abc") and all(x <= 2 * w for x, (_, w) in zip(out, patterns, strict=True))
        cost = sum(max(0, x - w) for x, (_, w) in zip(out, patterns, strict=True))
        best = None
        for split in product(*[[c for c in product(*[range(2 * w + 1) for _ in p]) if sum(c) <= 2 * w] for p, w in patterns]):
            got = Counter()
            for (p, _), c in zip(patterns, split, strict=True):
                got.update(dict(zip(p, c, strict=True)))
            if all(got[s] <= targets[s] for s in "abc"):
                key = (-sum(got.values()), sum(max(0, sum(c) - w) for (_, w), c in zip(patterns, split, strict=True)))
                best = key if best is None else min(best, key)
        assert best == (-sum(out), cost)


def test_sharding_clashes(spark):
    """Columns of the operator's own names stay what they are."""
    df = spark.range(20).select("id", F.lit("a").alias("__slot"), F.lit("b").alias("slot_"), F.lit("c").alias("Slot"), F.lit("d").alias("shard__"))
    out = sharding.place(df, F.col("id"), ("x", "y"), 11, ("at", "of"))
    assert out.columns == ["id", "__slot", "slot_", "Slot", "shard__", "at", "of"]
    assert {tuple(r)[1:5] for r in out.collect()} == {("a", "b", "c", "d")} and out.count() == 20


def test_languages_of_one_id(spark, monkeypatch):
    """Rows that share an id, or the text too, teach like any others, and no more than a bounded number of them is taken."""
    rng = random.Random(3)
    texts = [(words(rng, 20, "abcdeft"), "en") for _ in range(60)] + [(words(rng, 20, "ghijklt"), "de") for _ in range(60)]
    for same in (None, 7):
        df = spark.createDataFrame([(same, t, lang) for t, lang in texts] + [(same, "abc def", "en")] * 500, "doc_id long, text string, lang string")
        taken = []
        plain = langid.LanguageModel.fit
        monkeypatch.setattr(langid.LanguageModel, "fit", classmethod(lambda cls, rows, seed=0: taken.append(len(rows)) or plain(rows, seed)))
        model = langid.fit_languages(df, per_lang=25)
        monkeypatch.undo()
        assert taken == [50]
        lang, _ = model.predict(pa.array([words(rng, 20, "abcdeft"), words(rng, 20, "ghijklt"), "abc def"]))
        assert lang.tolist() == ["en", "de", "en"]


def test_languages_held_out(spark):
    """Accuracy on the test tables' rows that taught nothing."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    from quadrille.llm.queries import QUERIES

    said = QUERIES["op1_langid"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = said.where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert got[1] > 100 and got[0] > 0.97


def test_toxicity_of_one_id(spark, monkeypatch):
    """An id that occurs many times teaches once, and what reaches the driver is bounded in rows and bytes."""
    rng = random.Random(5)
    rows = [(i, words(rng, 20, "aehinorst") + (" idiotic scumbag" if i % 3 == 0 else "")) for i in range(90)]
    rows += [(3, f"text {k}") for k in range(300)] + [(6, rows[6][1])] * 300 + [(9, "x" * 9000)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, share, **more: taken.append((texts, y.tolist(), share)))
    toxicity.fit_toxicity(docs_, labels)
    texts, y, share = taken[0]
    assert len(texts) == 90 and sum(y) == 30 and share == 1 / 3 and Counter(texts).most_common(1)[0][1] == 1
    toxicity.fit_toxicity(docs_, labels, per_class=5)
    assert sorted(taken[1][1]) == [0] * 10 + [1] * 5
    toxicity.fit_toxicity(docs_, labels, text_bytes=2000)
    assert sum(len(t) for t in taken[2][0]) <= 2000 and max(map(len, taken[2][0])) <= 250


def test_low_frequencies():
    """The hash against a cosine transform written out, on images that need no resizing."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        image = rng.integers(0, 256, (32, 32)).astype(np.uint8)
        low = np.zeros((8, 8))
        for u in range(8):
            for v in range(8):
                total = sum(float(image[y, x]) * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32))
                low[u, v] = total * np.sqrt((1 if u == 0 else 2) / 32) * np.sqrt((1 if v == 0 else 2) / 32)
        flat = np.round(low.ravel(), 6)
        assert media.low_frequency_hash(image) == np.packbits(flat > np.median(flat[1:])).tobytes()


def test_packing_solver():
    """Repeat counts against non-negative least squares by an active set, on a window that has few combinations."""
    rng = np.random.default_rng(7)
    window = 12
    combos = packing.combinations(window)
    a = np.stack([np.bincount(c[c > 0], minlength=window) for c in combos], 1).astype(float)[1:]
    for _ in range(5):
        histogram = np.concatenate(([0], rng.integers(50, 2000, window - 1)))
        b = histogram[1:].astype(float)
        x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
        while True:
            gradient = a.T @ (b - a @ x)
            j = int(np.argmax(np.where(on, -np.inf, gradient)))
            if on.all() or gradient[j] < 1e-7:
                break
            on[j] = True
            while True:
                z = np.zeros_like(x)
                z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
                if (z[on] > 0).all():
                    break
                low = on & (z <= 0)
                x += (x[low] / (x[low] - z[low])).min() * (z - x)
                on &= x > 1e-9
                x[~on] = 0
            x = z
        ours = np.linalg.norm(b - a @ packing.relaxed(histogram, combos, packing.STEPS))
        assert ours <= 1.01 * np.linalg.norm(b - a @ x) + 0.005 * np.linalg.norm(b)  # steps end at half a use


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns beside those of documents, whatever their names, go along."""
    import corpus_pipeline

    rng = random.Random(15)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["score", "p", "row", "sketch", "n", "__row", "__n", "__score", "__p", "id", "least", "root", "node", "fp", "size", "pattern"]
    df = spark.createDataFrame([(i, words(rng, 30), "en", f"s{i % 2}", 0) for i in range(12)], SCHEMA).withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert sorted(out.columns) == sorted(df.columns), name
        got = out.collect()
        assert got and all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in names), name

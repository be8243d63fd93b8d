"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvarank.llm import cdc, decontam, jaccard, langid, media, packing, queries, sharding, tokens, toxicity, warc

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "a"), (5, "same text here"), (6, "same text here"), (7, LONG), (8, "é́ ß 中文 😀 \x00 x"), (None, "no id at all"), (9, "don't stop, now. <|endoftext|>")]
SCHEMA = "doc_id long, text string"


def words(r, n, vocabulary=4000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def edge(spark):
    """Rows with nulls, empty, blank and very long texts, ties, and extra columns whose names the operators use inside."""
    df = spark.createDataFrame(EDGE, SCHEMA)
    for name in ("label", "n", "start", "length", "shingle", "rep", "unit", "grp", "node", "score", "_rank", "place", "task", "_bad", "_toxic", "_other", "_spans_of", "_y", "_id", "doc", "id", "y", "gone", "spans", "text_key", "span", "upto", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    """Prose with copies, near copies and a passage that many documents share."""
    r, rows = random.Random(11), []
    shared = words(r, 60)
    for _ in range(60):
        rows.append(words(r, r.randint(1, 120)))
    for k in range(25):
        base = list(rows[k % 10])
        for _ in range(r.randint(0, max(1, len(base) // 12))):
            base[r.randrange(len(base))] = f"x{r.randrange(50)}"
        rows.append(base)
    for _ in range(25):
        rows.append(words(r, 40) + shared + words(r, 40))
    rows += [shared] * 3 + [rows[70]] * 5
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizer():
    enc, want = tokens.ChunkEncoder(queries.vocabulary(), keep=50), reference_tokenizer()
    for text in [t for _, t in EDGE if t != LONG] + ["Çà, L'été. A.B,C d..", "ΣΑΣ İstanbul ﬁ ªº µ", "hello <|endoftext|> x", "a<|startoftext|>b<|endoftext|><|endoftext|>.", "<|ENDOFTEXT|> <|endoftext|", "word.<|endoftext|>\n<|startoftext|>word,", "a\tb c d", "Å K ẞ ŸÿÀ."]:
        assert enc.encode(text) == np.asarray(want(text), "<u4").tobytes(), text


def test_token_histogram(spark, edge, none):
    want = Counter(len(reference_tokenizer()(t)) for _, t in EDGE)
    got = {r["length"]: r for r in tokens.token_histogram(edge, queries.vocabulary(), block=2).collect()}
    assert {k: r["documents"] for k, r in got.items()} == want
    total = sum(k * n for k, n in want.items())
    for k, r in got.items():
        assert r["documents_from"] == sum(n for x, n in want.items() if x >= k)
        assert r["tokens_from"] == sum(x * n for x, n in want.items() if x >= k)
        assert r["truncated_tokens"] == sum(min(x, k) * n for x, n in want.items())
        assert r["quantile"] == pytest.approx(sum(n for x, n in want.items() if x <= k) / len(EDGE))
        assert (r["total_tokens"], r["total_documents"]) == (total, len(EDGE))
    hist = tokens.token_histogram(edge, queries.vocabulary())
    assert tokens.truncated_total(hist, 5).first()[0] == sum(min(x, 5) * n for x, n in want.items())
    assert tokens.length_quantile(hist, 0.5).first()[0] == sorted(want.elements())[4]
    assert tokens.token_histogram(none, queries.vocabulary()).count() == 0


def brute_bins(histogram, capacity):
    bins = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fit = [b for b in bins if b >= n]
            bins.append(min(fit) - n if fit else capacity - n)
            if fit:
                bins.remove(min(fit))
    return sorted(bins)


def test_best_fit_against_brute_force():
    for seed in range(200):
        r = random.Random(seed)
        capacity = r.randint(1, 50)
        histogram = {r.randint(1, capacity): r.randint(1, 25) for _ in range(r.randint(0, 10))}
        bins, ranks = {}, {}
        for length, rank, n, start, per, offset in packing.best_fit_decreasing(histogram, capacity):
            for k in range(n):
                bins.setdefault(start + k // per, []).append((offset + k % per * length, length))
                ranks.setdefault(length, []).append(rank + k)
        assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
        assert sorted(capacity - sum(n for _, n in x) for x in bins.values()) == brute_bins(histogram, capacity)


def test_packing(spark, edge, none):
    got = packing.pack(edge, queries.vocabulary(), capacity=64).collect()
    want = reference_tokenizer()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in EDGE:
        ids, at = [*want(text), 1], 0
        for k, r in enumerate(sorted(by_doc.pop(doc), key=lambda r: r["piece"])):
            part = ids[at : at + 64]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
            at += len(part)
        assert at == len(ids)
    assert not by_doc
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none, queries.vocabulary()).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "long page " * 200
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (5, "u", None), (None, "u", big), (6, "u", "é" * 600), (7, "u", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    files = warc.write_warc(pages)
    for split in (97, 4096, 16 << 20):
        got = sorted((tuple(r) for r in warc.page_records(warc.read_warc(files, split)).collect()), key=repr)
        want = []
        for page, _, html in rows:
            raw = (html or "").encode()
            again = page is not None and html == big and page != 2
            want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None))
        assert got == sorted(want, key=repr)
    assert warc.read_warc(warc.write_warc(pages.where("false"))).count() == 0


def test_warc_reader_owns_each_record_once(tmp_path):
    r = random.Random(3)
    made = [warc.record("response", f"urn:page:{i}", "u", "d", r.randbytes(r.randint(0, 3000)) + b"\x1f\x8b\x08\x00", "2020") for i in range(40)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(made))
    size = path.stat().st_size
    for step in (1000, 777, size):
        with open(path, "rb") as f:
            found = [x for s in range(0, size, step) for x in warc.records_in(f, s, min(size, s + step))]
        assert [x[0] for x in found] == [0, *itertools.accumulate(map(len, made))][:-1]
    with open(path, "r+b") as f:
        f.truncate(size - 5)
    with open(path, "rb") as f, pytest.raises(EOFError):
        list(warc.records_in(f, 0, size))


def test_jpeg_round_trip(spark, edge, none):
    got = {r["doc_id"]: r for r in media.media_features(media.store_texts(edge)).collect()}
    for doc, text in EDGE:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 - len(raw) if len(raw) < 576 else -len(raw) % 576)
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[5]["feature"] == got[6]["feature"] and got[5]["media_sha256"] == got[6]["media_sha256"]
    assert media.media_features(media.store_texts(none)).count() == 0


def plain_decoder(data):
    """A bit-by-bit decoder of one-component scans, after the standard's figures, without tables or arrays."""
    jpeg = media.parse_markers(data)
    codes = [{format(c, f"0{n}b"): s for s, (c, n) in media.canonical(jpeg["dht"][k]).items()} for k in (0, 16)]
    pieces, current, k, scan = [], [], 0, jpeg["scan"]
    while k < len(scan):
        if scan[k] == 0xFF and scan[k + 1] != 0:
            pieces.append(current)
            current = []
        else:
            current.append(format(scan[k], "08b"))
        k += 2 if scan[k] == 0xFF else 1
    pieces.append(current)
    blocks, total = [], -(-jpeg["width"] // 8) * -(-jpeg["height"] // 8)
    for piece in pieces:
        bits, at, last = "".join(piece), 0, 0

        def symbol(table):
            nonlocal at
            n = next(n for n in range(1, 17) if bits[at : at + n] in table)
            at += n
            return table[bits[at - n : at]]

        def value(size):
            nonlocal at
            at += size
            raw = bits[at - size : at]
            return 0 if not size else int(raw, 2) if raw[0] == "1" else int(raw, 2) - 2**size + 1

        for _ in range(min(jpeg["restart"] or total, total - len(blocks))):
            block = [0] * 64
            last += value(symbol(codes[0]))
            block[0], z = last, 1
            while z < 64:
                s = symbol(codes[1])
                if s == 0:
                    break
                z += s >> 4
                if s & 15:
                    block[z] = value(s & 15)
                z += 1
            blocks.append(block)
    return np.asarray(blocks)


def test_jpeg_decoders_agree(monkeypatch):
    r = random.Random(1)
    payloads = [r.randbytes(576), b"\xff" * 1152, bytes(576), r.randbytes(5 * 576), "plain prose, and ünïcode ".encode() * 576]
    payloads += [bytes(r.choice(b" etaoin\xff\x00") for _ in range(576 * r.randint(1, 4))) for _ in range(30)]
    images = media.encode_jpegs(payloads)
    assert images == [media.encode_jpeg(p) for p in payloads]
    for apart in (False, True):
        monkeypatch.setattr(media, "SIDE_BY_SIDE", 10**9 if apart else 1)
        for payload, data, (jpeg, got) in zip(payloads, images, media.read_jpegs(images)):
            assert (got.reshape(-1, 64) == plain_decoder(data)).all()
            assert media.decode_payload(jpeg, got) == payload
            assert (media.thumbnail(jpeg, got).ravel()[: len(payload) // 64] == np.frombuffer(payload, np.uint8)[::64]).all()
            small = media.thumbnail(jpeg, got)
            cells = [[small[i * small.shape[0] // 8 : max((i + 1) * small.shape[0] // 8, i * small.shape[0] // 8 + 1), j * small.shape[1] // 8 : max((j + 1) * small.shape[1] // 8, j * small.shape[1] // 8 + 1)].mean() for j in range(8)] for i in range(8)]
            mean = sum(map(sum, cells)) / 64
            plain = "".join("1" if c > mean else "0" for row in cells for c in row)
            assert media.thumbnail_hash(small) == f"{int(plain, 2):016x}"
        for bad in (images[3][:-200] + b"\xff\xd9", images[0].replace(b"payload=576", b"payload=999", 1)[:-40] + b"\xff\xd9"):
            with pytest.raises(ValueError):
                media.read_jpegs([bad])
    wide = r.randbytes(576 * (media.TALLEST + 3))
    jpeg, fast = media.luminance_coefficients(media.encode_jpeg(wide))
    assert jpeg["width"] == 48 and media.decode_payload(jpeg, fast) == wide


def test_jpeg_decoding_is_linear():
    """One scan without restart markers, read symbol by symbol, takes time in proportion to its length."""
    import time

    def image(blocks):
        one = media.encode_jpegs([bytes(64) * 9])[0]
        jpeg = media.parse_markers(one)
        codes = media.canonical(jpeg["dht"][16])
        dc = media.canonical(jpeg["dht"][0])[0]
        block = format(dc[0], f"0{dc[1]}b") + "".join(format(codes[3][0], f"0{codes[3][1]}b") + "101" for _ in range(63))
        bits = block * blocks
        bits += "1" * (-len(bits) % 8)
        scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
        head = one[: one.index(b"\xff\xdd")].replace(media._segment(0xC0, b"\x08\x00\x18\x00\x18\x01\x01\x11\x00"), media._segment(0xC0, b"\x08" + (blocks * 8).to_bytes(2, "big") + b"\x00\x08\x01\x01\x11\x00"))
        return head + media._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"

    took = {}
    for n in (900, 2700):
        data = image(n)
        began = time.process_time()
        _, got = media.luminance_coefficients(data)
        took[n] = time.process_time() - began
        assert got.shape == (n, 1, 64) and (got[:, 0, 1:] == 5).all() and not got[:, 0, 0].any()
    assert took[2700] < 6 * took[900] + 0.1 and took[2700] < 2


def test_jpeg_with_colour():
    """Three components, the first sampled twice each way: blocks of a unit come in turn, each with its component's prediction."""
    dc, ac = {0: 2, 2: 2, 3: 2}, {0x00: 1, 0x01: 2}
    code = lambda t, s: format(*(lambda c: (c[0], f"0{c[1]}b"))(media.canonical(t)[s]))
    block = lambda d: code(dc, 2) + format(d if d > 0 else d + 3, "02b") + code(ac, 0)
    units = [[2, 3, -2, 2, -3, 3], [-2, 2, 2, 2, 2, 2]]
    bits = "".join(block(d) for u in units for d in u)
    scan = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\x00")
    frame = media._segment(0xDB, b"\x00" + b"\x02" * 64) + media._segment(0xC0, b"\x08\x00\x10\x00\x20\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00") + media._dht(0, dc) + media._dht(16, ac)
    data = b"\xff\xd8" + frame + media._segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    _, got = media.luminance_coefficients(data)
    assert got[:, :, 0].tolist() == [[2, 5, 3, 5], [3, 5, 7, 9]]


def test_jpeg_with_zero_runs_and_restarts():
    """A two-block scan with run lengths, an end of block and a restart marker, built bit by bit."""
    dc, ac = {2: 2, 3: 3}, {0x00: 2, 0x21: 2, 0xF0: 3}
    code = lambda t, s: format(*(lambda c: (c[0], f"0{c[1]}b"))(media.canonical(t)[s]))
    first = code(dc, 2) + "11" + code(ac, 0x21) + "1" + code(ac, 0xF0) + code(ac, 0x21) + "0" + code(ac, 0)
    second = code(dc, 3) + "000" + code(ac, 0)
    pack = lambda b: int(b + "1" * (-len(b) % 8), 2).to_bytes(-(-len(b) // 8), "big").replace(b"\xff", b"\xff\x00")
    frame = media._segment(0xDB, b"\x00" + b"\x02" * 64) + media._segment(0xC0, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00") + media._dht(0, dc) + media._dht(16, ac) + media._segment(0xDD, b"\x00\x01")
    data = b"\xff\xd8" + frame + media._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + pack(first) + b"\xff\xd0" + pack(second) + b"\xff\xd9"
    jpeg, got = media.luminance_coefficients(data)
    assert got.shape == (1, 2, 64) and got[0, 0, 0] == 3 and got[0, 1, 0] == -7
    assert {int(k): int(got[0, 0, k]) for k in np.flatnonzero(got[0, 0, 1:]) + 1} == {3: 1, 22: -1}


def test_sharding(spark, edge, none):
    got = sharding.kd_shards(edge, shards=3, metadata=("label",)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in EDGE)
    for r in got:
        text = dict(EDGE)[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert sharding.kd_shards(none.withColumn("lang", F.lit("x")).withColumn("source", F.lit("x")), shards=3).count() == 0


def test_shards_are_even_and_copies_stay(spark):
    r = random.Random(2)
    rows = [(i, "t" * r.randint(20, 400) + str(i), r.choice("ab"), f"s{r.randint(0, 5)}") for i in range(3000)] + [(3000 + i, "copy" * 60, "a", "s0") for i in range(1500)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=7).collect()
    sums = Counter()
    for x in got:
        sums[x["shard"]] += x["size"]
    assert set(sums) == set(range(7)) and max(sums.values()) < 1.04 * min(sums.values())
    by_target = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), target_bytes=200_000)
    assert by_target.agg(F.count_distinct("shard")).first()[0] == -(-sum(sums.values()) // 200_000)


def test_long_metadata_values_are_told_apart(spark):
    """Sources that differ only late are cut apart along their order; a node table of thousands plans in seconds."""
    import time

    rows = [(i, f"{"t" * 60}{i:03d}", "x", f"https://example.org/{i % 4}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.kd_shards(df, shards=4).collect()
    homes = {}
    for r in got:
        homes.setdefault(r["shard"], Counter())[r["doc_id"] % 4] += 1
    assert all(max(c.values()) > 0.9 * sum(c.values()) for c in homes.values()) and len(homes) == 4
    began = time.monotonic()
    nodes = spark.range(5000).select(F.col("id").alias("node"))
    total = nodes.select(sharding._of(F.col("node"), list(range(5000))).alias("x")).agg(F.sum("x")).first()[0]
    assert total == sum(range(5000)) and time.monotonic() - began < 10


def test_language_mixture(spark, edge, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op6_language_mixture(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    model = langid.fit_languages([("en", "the cat and the dog were in the house"), ("fr", "le chat et le chien sont dans la maison")] * 3)
    two = spark.createDataFrame([(1, "the dog and the cat " * 30 + "le chien et la maison " * 30), (2, "the house " * 20), (3, "12 34 !"), (4, None), (5, "")], SCHEMA)
    rows = {r["doc_id"]: r for r in langid.predict_languages(two, model).collect()}
    assert rows[1]["languages"] == 2 and 0.3 < rows[1]["score"] < 0.7 and rows[2]["languages"] == 1 and rows[2]["lang_pred"] == "en"
    assert [rows[k]["lang_pred"] for k in (3, 4, 5)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert langid.predict_languages(edge, model).count() == len(EDGE) and langid.predict_languages(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(edge, langid.fit_languages([])).collect()} == {"und"}


def test_mixture_never_loses_likelihood():
    r = np.random.default_rng(4)
    scores, edges = r.normal(size=(300, 4)) * 5, np.asarray([0, 1, 100, 300])
    share, total = langid.mixture(scores, edges, np.ones((3, 4)), rounds=200)
    assert np.allclose(share.sum(1), 1)
    single = np.add.reduceat(scores, edges[:-1], axis=0).max(1)
    assert (total >= single - 1e-6).all()


def test_toxicity_gradients():
    net = toxicity.Network.fresh(np.zeros(toxicity.WORD_BUCKETS, np.float32), np.zeros(toxicity.CHAR_BUCKETS, np.float32), 0.5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    args = (["ab", "cde", "fg", "h"], np.asarray([[1, 2, 3, 4], [2, 2, 0, 0]]), np.asarray([1.0, 0.0]), np.asarray([1.0, 0.5]))
    grad, _ = net.gradients(*args)
    for name, g in grad.items():
        at = int(np.abs(g).argmax())
        flat, h = net.p[name].reshape(-1), 1e-3
        flat[at] += h
        up = net.gradients(*args)[1]
        flat[at] -= 2 * h
        down = net.gradients(*args)[1]
        flat[at] += h
        assert g.ravel()[at] == pytest.approx((up - down) / (2 * h), rel=2e-2, abs=1e-5)


def test_toxicity_learns(spark, edge, none):
    r, rows = random.Random(6), []
    for k in range(500):
        text = words(r, r.randint(5, 200), 300)
        if k % 5 == 0:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["vilewordone", "vilewordtwo", "Awful,"]))
        rows.append((" ".join(text), int(k % 5 == 0)))
    net = toxicity.fit(rows[:400])
    held = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows[400:])], SCHEMA)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(held, net).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(rows[400:])) >= 95
    scored = {x["doc_id"]: x for x in toxicity.score_toxicity(edge, net).collect()}
    assert len(scored) == len(EDGE) and scored[1]["score"] == scored[2]["score"] == scored[3]["score"] < 0.5
    assert scored[7]["windows"] == len(toxicity.window_starts(len(LONG.split())))
    assert toxicity.score_toxicity(none, net).count() == 0


def test_windows_cover_all_words():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        index, of = toxicity.windows(np.arange(1, n + 1), [n])
        assert set(index.ravel().tolist()) - {0} == set(range(1, n + 1)) and (index[:, 0] > 0).all()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:]))
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_against_brute_force(spark, small):
    df = spark.createDataFrame(small, SCHEMA).repartition(5)
    want = brute_components(small)
    for heavy, pivots in ((65_536, 1024), (1, 0), (65_536, 12), (300, 3)):
        got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(df, heavy_limit=heavy, pivots=pivots, rows_per_part=200).collect()}
        assert got == want, (heavy, pivots)


def test_cells_and_windows(spark):
    """Families around a pivot whose outer members link only with each other, not with the pivot."""
    r, rows = random.Random(3), []
    for family in range(6):
        text = words(r, 100, 50_000)
        for step in range(12):  # each step moves on from the one before
            text = list(text)
            for _ in range(2):
                text[r.randrange(len(text))] = f"z{r.randrange(10**6)}"
            rows.append((100 * family + step, " ".join(text)))
    want = brute_components(rows)
    assert 6 <= len({c for _, c in want.values()}) < len(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for pivots in (5, 20):
        assert {x[0]: (x[1], x[2]) for x in jaccard.jaccard_components(df, pivots=pivots).collect()} == want
    sets = [jaccard.shingle_set(t, jaccard._Hashes()) for _, t in rows]
    net = jaccard.Pivots(sets, 75)
    for s in sets:
        assert all(np.array_equal(jaccard.unpacked(jaccard.packed(x)), x) for x in (s, s[:0]))
    kept = [s for s in sets if net.common(s).max() == len(s)]
    assert len(kept) >= len(net.sizes)


def test_jaccard_edges(spark, edge, none):
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(edge).collect()}
    want = brute_components([r for r in EDGE if r[0] is not None])
    assert {k: v for k, v in got.items() if k is not None} == want and got[None][1] is None
    assert jaccard.jaccard_components(none).count() == 0


def test_copies_in_many_tasks(spark):
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randrange(300)}" for _ in range(draw.choice((3, 20, 60)))) for _ in range(12)]
    texts += [t + " more" for t in texts]
    rows = [(k, t) for k, t in enumerate(texts * 6)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(df, pivots=0, rows_per_part=200).collect()}
    assert got == brute_components(rows)
    ids = df.withColumn("doc_id", F.when(F.col("doc_id") >= 0, F.col("doc_id") % 24))  # an id of several equal rows
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(ids, pivots=0).collect()}
    assert got == brute_components([(k, t) for k, t in enumerate(texts)])


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_decontamination(spark, edge, none):
    r = random.Random(8)
    items = [(i, " ".join(words(r, 40))) for i in range(8)] + [(90, None), (91, ""), (None, "some words here now")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs, want = [], set()
    for d in range(60):
        text = words(r, 150)
        if d % 3 == 0:
            copy = items[d % 8][1].split()
            for k in range(0, len(copy), 7):  # edited copies
                copy[k] = "edited"
            if d % 2:
                copy = [*copy[:20], "two", "more", *copy[20:]]
            at = r.randrange(len(text))
            text = [*text[:at], *(w.upper() + "," for w in copy), *text[at:]]
            want.add((d, d % 8))
        docs.append((d, " ".join(text)))
    df = spark.createDataFrame(docs, SCHEMA)
    got = decontam.contaminated(df, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    blocks = decontam.contaminated(df, bench, words_per_block=50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, blocks))
    assert {x[0] for x in decontam.drop_contaminated(df, bench).select("doc_id").collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.drop_contaminated(edge, bench).count() == len(EDGE)
    assert decontam.contaminated(none, bench).count() == 0 == decontam.contaminated(df, bench.where("false")).count()


def test_alignment_against_brute_force():
    r = random.Random(9)
    for _ in range(100):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 12))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            s = 2 if a[i - 1] == b[j - 1] != 0 else -1
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(np.asarray(a), np.asarray(b))[0] == h.max()


def test_chunks_cover_texts_and_resist_shifts(spark, edge, none):
    r = random.Random(10)
    body = " ".join(words(r, 2000))
    df = spark.createDataFrame([(1, body), (2, "some words put in front " + body), (3, "x" * 50_000), (4, "語" * 9000)], SCHEMA)
    rows = cdc.chunk_texts(df).collect()
    for doc, text in ((1, body), (3, "x" * 50_000), (4, "語" * 9000)):
        at = 0
        for x in sorted((x for x in rows if x["doc_id"] == doc), key=lambda x: x["start"]):
            assert x["start"] == at
            at += x["length"]
            text.encode()[x["start"] : at].decode()
        assert at == len(text.encode())
    one, two = ({(x["hi"], x["lo"]) for x in rows if x["doc_id"] == d} for d in (1, 2))
    assert len(one & two) > 0.95 * len(one)
    assert cdc.chunk_texts(none).count() == 0 and cdc.repeated_passages(edge).count() == 0


def test_repeated_passages(spark):
    r = random.Random(12)
    passages = [" ".join(words(r, 60, 100_000)) for _ in range(15)]
    rows, planted = [], set()
    for d in range(60):
        text = words(r, 200, 100_000)
        if d % 2:
            text.insert(r.randrange(200), passages[d % 15])
        rows.append((d, " ".join(text)))
    first = {}
    for d in range(60):
        if d % 2:
            planted |= {(d, first[d % 15])} if d % 15 in first else set()
            first.setdefault(d % 15, d)
    df = spark.createDataFrame(rows, SCHEMA)
    got = cdc.repeated_passages(df).collect()
    assert {(x["doc_id"], x["first_doc_id"]) for x in got} == planted
    left = dict(map(tuple, cdc.drop_repeats(df).collect()))
    for d, text in rows:
        if d in {x for x, _ in planted}:
            assert len(left[d].split()) < 240 and len(left[d].split()) >= 198
        else:
            assert left[d] == text


def test_rows_that_share_an_id(spark):
    """Null and different texts under one id: cuts belong to the row whose text they are of."""
    r = random.Random(4)
    shared, own = " ".join(words(r, 200)), " ".join(words(r, 200))
    docs = spark.createDataFrame([(1, shared), (2, shared + " " + own), (2, None), (2, own), (2, own), (None, shared), (3, shared)], SCHEMA)
    got = sorted((t[0] or 0, t[1] or "") for t in cdc.drop_repeats(docs).collect())
    assert [g for g in got if g[0] == 0] == [(0, shared)] and (1, shared) in got and not any(g[0] == 3 for g in got)
    two = [t for i, t in got if i == 2]
    assert len(two) == 4 and two[0] == "" and two.count(own) == 2
    assert any(t.endswith(own) and len(t) < len(shared) + len(own) for t in two if t not in ("", own))
    assert cdc.drop_repeats(docs, most=0).count() == len(got)


def test_without_ids(spark, edge):
    from sylvarank.llm.common import without_ids

    gone = spark.createDataFrame([(4,), (4,), (None,), (99,)], "x long")
    for most in (0, 10):
        assert sorted(str(r["doc_id"]) for r in without_ids(edge, gone, most=most).collect()) == sorted(str(i) for i, _ in EDGE if i != 4)


def test_pipeline_edges(spark, edge, tmp_path):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for empty in (False, True):
        at = docs.where("false") if empty else docs
        for _, step in cp.STAGES[:-1]:
            at = step(spark, at, str(tmp_path))
            assert at.columns == docs.columns
        ids = {r[0] for r in at.select("doc_id").collect()}
        assert ids == (set() if empty else {None, 1, 2, 3, 4, 5, 7, 8, 9})
        assert cp.packing(spark, at, str(tmp_path)).select("doc_id").distinct().count() == len(ids)


def test_sketches_of_any_two_lengths(spark):
    """What sketches leave open follows from folded bitmaps, holds every link, and few pairs besides them."""
    rng, sets = np.random.default_rng(1), []
    for n in (1, 3, 400, 512, 513, 700, 1030, 2100, 5000):
        base = np.unique(rng.integers(0, 2**48, n).astype(np.uint64))
        near = np.unique(np.concatenate([base[rng.random(n) < 0.9], rng.integers(0, 2**48, n // 20).astype(np.uint64)]))
        sets += [base, near if len(near) else base]
    rows = [(k, len(s), jaccard.packed(s), jaccard.sketch(s)) for k, s in enumerate(sets)]
    carriers = spark.createDataFrame(rows, "doc_id long, n int, shingles binary, sketch array<long>")
    pairs = spark.createDataFrame([(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b], "x long, p long")
    possible = {(r["x"], r["p"]): r["possible"] for r in jaccard._possible(pairs, carriers, 75, 10).collect()}
    assert len(possible) == len(sets) * (len(sets) - 1)
    for (a, b), told in possible.items():
        x, p = sets[a], sets[b]
        bits = np.uint64(64 * min(len(jaccard.sketch(x)), len(jaccard.sketch(p))) - 1)
        fx, fp = set((x & bits).tolist()), set((p & bits).tolist())
        most = min(len(x) - len(fx - fp), len(p) - len(fp - fx))
        common = len(np.intersect1d(x, p))
        assert told == (175 * most >= 75 * (len(x) + len(p)))
        assert told or 175 * common < 75 * (len(x) + len(p))

"""The training-data operators against brute force, the public libraries, held-out rows and edge cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnstore.llm import bpe, html_text, langid, media, packing, quality_rules, ranker, sharding, simhash, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, score string"
ODD = [None, "", " ", "a", "  a b\n\n c ", "x<|endoftext|> y <|startoftext|>", "ΑΣ Σ İ ﬁ é \x1c a\x1fb 　x", "it's I'LL 123 4½", "日本語😀 ‍ x", "a" * 5000, "é" * 300 + " q" * 3000, "▁a  b▁ ", "<s> x"]
EN, DE = "the cat and the house with this that were over under the tree ", "der hund und das haus mit dieser jener waren über unter dem baum "


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "s", 0, "i", "f", "c") for k, t in enumerate(texts)], SCHEMA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_encode_decode(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(bpe.encode_decode(documents(spark, ODD), public_tokenizers.path("word_bpe_49k.json"), keep_values=True))
    assert len(got) == len(ODD)
    for k, text in enumerate(ODD):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["decoded"] == t.decode(ids, skip_special_tokens=False)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_in_slices(name, monkeypatch):
    t, e = Tokenizer.from_file(public_tokenizers.path(name)), bpe.Encoder(public_tokenizers.path(name))
    monkeypatch.setattr(bpe, "GROUP", 7)
    monkeypatch.setattr(bpe, "MEMO", 5)
    texts = [x or "" for x in ODD]
    assert [x.tolist() for x in e.encode_batch(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_forced_boundaries():
    e = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    pairs = {(a, b) for t in e.vocab for a, b in zip(t, t[1:])}
    symbols = bpe.byte_symbols()
    assert all(((symbols[k >> 8], symbols[k & 255]) in pairs) for k in np.flatnonzero(e.joined).tolist())
    assert 0 < e.joined.mean() < 0.1


def test_token_counts(spark, monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.count_tokens(documents(spark, ODD), path, 100))
    for k, text in enumerate(ODD):
        n = len(model.encode(text or ""))
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"], got[k]["fp"]) == (n, len((text or "").encode()), n > 100, "f")
    monkeypatch.setattr(token_counts, "GROUP_BYTES", 5)
    monkeypatch.setattr(token_counts, "MEMO", 3)
    texts = [x or "" for x in ODD]
    assert token_counts.Counter(path).count(texts) == [len(model.encode(x)) for x in texts]


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for code in (c for b in block[4:] for c in (b & 15, b >> 4)):
        step = int(media.STEPS[index])
        change = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            change += part if code & bit else 0
        value = max(-32768, min(32767, value - change if code & 8 else value + change))
        index = max(0, min(88, index + int(media.MOVES[code & 7])))
        out.append(value)
    return out


def test_audio(spark):
    texts = [*ODD, "a", bytes(range(1, 128)).decode() * 5]
    got = by_id(media.audio(documents(spark, texts), keep_values=True))
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload)) and media.read(bytes(r["media"])) == (media.MU_LAW, payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["media_bytes"] == len(r["media"])
        assert (r["pcm_bytes"], r["pcm_sha256"]) == (len(r["pcm"]), hashlib.sha256(bytes(r["pcm"])).hexdigest())
        assert len(r["pcm"]) == 4 * len(payload) and (np.frombuffer(bytes(r["pcm"]), np.int16)[::2] == media.MU[np.frombuffer(payload, np.uint8)]).all()
    assert got[3]["feature"] == got[len(ODD)]["feature"]
    data = np.random.default_rng(1).integers(0, 256, 192 * 5).astype(np.uint8)
    assert media.adpcm(data).tolist() == [slow_adpcm(data[k * 192 : k * 192 + 192].tobytes()) for k in range(5)]
    assert sorted(set(media.MU.tolist())) == sorted({-x for x in media.MU.tolist()}) and media.MU.max() == 32124 and media.A.max() == 32256
    assert media.read(media.store(data.tobytes(), media.IMA_ADPCM)) == (media.IMA_ADPCM, data.tobytes())
    with pytest.raises(ValueError):
        media.read(b"nothing")


def slow_measures(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    texts = [*ODD, "a b c d e f g h i " * 4, "a b\na b\n\n \na b", "# $ x\n" * 30, " ".join(f"w{k % 11}" for k in range(50)), " ".join(f"w{k}" for k in range(40))]
    measured, name = quality_rules.with_measures(documents(spark, texts))
    got = {r["doc_id"]: r[name] for r in measured.collect()}
    for k, text in enumerate(texts):
        want = slow_measures(text)
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, text
        assert got[k]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def slow_tail(k, n, p):
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return math.fsum(map(math.exp, log)) if k < p * n else 1.0


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 100, 0.05), (30, 7000, 0.005), (2500, 600_000, 0.005), (199_000, 4_000_000, 0.05), (9, 10, 0.5)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first()["x"]
        assert got == pytest.approx(slow_tail(k, n, p), rel=1e-5)


def test_quality_cutoffs(spark):
    """Cutoffs in two strata, each from its own labels; too few labels give none, and nothing is rejected then."""
    text = lambda n, mark: " ".join(f"w{k}{mark}" for k in range(n))
    docs = documents(spark, [text(50, "")] * 150 + [text(50, "#")] * 20 + [text(150, "")] * 150 + [text(150, "%")] * 20 + [text(400, "")] * 40 + [text(400, "&")] * 20 + [None, "short"])
    good = [*range(150), *range(170, 320), *range(340, 380)]
    labels = spark.createDataFrame([(k, int(k in good)) for k in range(400)] + [(5, None), (99999, 0), (None, 1)], "doc_id long, quality int")
    measured, name = quality_rules.with_measures(docs)
    chosen = {r["stratum"]: r for r in quality_rules.cutoffs(measured, name, labels).collect()}
    assert {k: r["symbols"] for k, r in chosen.items()} == {0: 800, 1: 800} and chosen[0]["upper"] is None
    judged, kept = quality_rules.judge(measured, name, quality_rules.cutoffs(measured, name, labels))
    assert {r["doc_id"] for r in judged.where(~F.col(kept)).collect()} == {*range(150, 170), *range(320, 340), 400, 401}
    few = labels.where("doc_id < 100 or doc_id between 150 and 169")
    assert quality_rules.cutoffs(measured, name, few).count() == 0
    assert {r["doc_id"] for r in quality_rules.keep(docs, labels).collect()} == {*range(150), *range(170, 320), *range(340, 402)}
    assert quality_rules.keep(docs, few).count() == 402 and quality_rules.keep(docs.limit(0), labels).count() == 0


def test_quality_price(spark):
    """A rule that costs a good text for fewer than PRICE bad ones doesn't apply; of two labels the worse counts."""
    texts = [" ".join(f"w{k}" for k in range(50))] * 400 + [" ".join(f"w{k}#" for k in range(50))] * 9
    labels = [(k, int(k < 402)) for k in range(409)]
    docs, frame = documents(spark, texts), lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    measured, name = quality_rules.with_measures(docs)
    assert quality_rules.cutoffs(measured, name, frame(labels)).count() == 0
    assert [r["symbols"] for r in quality_rules.cutoffs(measured, name, frame([*labels, (400, 0)])).collect()] == [800]


def many_labels(spark):
    """Documents that have just enough good labels for a cutoff, and their labels, with 1,200,000 of unknown documents beside."""
    docs = documents(spark, [" ".join(f"w{k}" for k in range(50))] * 115 + [" ".join(f"w{k}#" for k in range(50))] * 20)
    return docs, spark.range(1_200_135).select(F.col("id").alias("doc_id"), ((F.col("id") < 115) | (F.col("id") >= 135)).cast("int").alias("quality"))


def test_quality_many_labels(spark):
    """Every label counts, however many there are."""
    docs, labels = many_labels(spark)
    measured, name = quality_rules.with_measures(docs)
    assert [r["symbols"] for r in quality_rules.cutoffs(measured, name, labels).collect()] == [800]
    assert quality_rules.cutoffs(measured, name, labels.where("doc_id > 0")).count() == 0


def test_quality_guarantee():
    """By simulation: cutoffs whose true share of false rejections is above ALPHA pass in fewer than DELTA of all trials."""
    rng, level, n = np.random.default_rng(17), quality_rules.DELTA / quality_rules.CHAINS, 400
    passes = np.array([slow_tail(k, n, quality_rules.ALPHA) <= level for k in range(n + 1)])
    assert passes[0] and (np.diff(passes.astype(int)) <= 0).all()  # more false rejections never pass where fewer fail
    # the stricter cutoffs of each chain: the most lenient one that is bad has a risk just above ALPHA
    risks = quality_rules.ALPHA + np.array([0.0005, 0.002, 0.01, 0.05])
    wrong = 0
    for _ in range(4000):
        draws = rng.random((quality_rules.CHAINS, n))
        wrong += bool(passes[(draws[:, :, None] < risks).sum(1)].any())
    assert wrong / 4000 <= quality_rules.DELTA + 0.01


def test_quality_names(spark):
    """Extra columns that are called as the measures and the working columns are."""
    names = ["n_words", "kept", "base_failed", "h", "W", "s", "lines", "measures", "stratum", "of", "cut_symbols", "id", "good", "m", "x.y"]
    docs = spark.createDataFrame([(k, t, *["mine"] * len(names)) for k, t in enumerate(["a b", None, "c " * 30])], ["doc_id", "text", *names])
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {("mine",) * len(names)} and kept.count() == 3
    measured, name = quality_rules.with_measures(docs)
    judged, verdict = quality_rules.judge(measured, name, quality_rules.cutoffs(measured, name, labels))
    assert judged.columns[: len(docs.columns)] == docs.columns and [r[verdict] for r in judged.orderBy("doc_id").collect()] == [False, False, False]


def test_ranker(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(150)] + [" ".join(f"w{x}&&&" for x in rng.integers(0, 500, 60)) for _ in range(50)] + [None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(200)], "doc_id long, quality int")
    got = by_id(ranker.score(docs, ranker.fit(docs, labels)))
    assert all(got[k]["predicted"] == (k < 150) and 0 <= got[k]["score"] <= 1 and got[k]["fp"] == "f" for k in range(200)) and len(got) == 202
    none = by_id(ranker.score(docs, ranker.fit(docs, labels.where("quality = 1"))))
    assert {r["predicted"] for r in none.values()} == {1}


def test_bradley_terry():
    """The weights are those that plain gradient descent finds on the same pairs; the threshold is the quantile of the bad ones' share."""
    rng = np.random.default_rng(31)
    good = rng.random(400) < 0.7
    x = rng.normal(0, 1, (400, 3)) * [1, 5, 0.2] + good[:, None] * [0.8, -3, 0.0] + [0, 100, 0]
    model = ranker.learn(x, good)
    z, again = (x - x.mean(0)) / x.std(0), np.random.default_rng(7)
    n = min(ranker.PAIRS, int(good.sum()) * int((~good).sum()))
    d = z[again.choice(np.flatnonzero(good), n)] - z[again.choice(np.flatnonzero(~good), n)]
    w = np.zeros(3)
    for _ in range(4000):
        w -= 0.5 * (d.T @ (-1 / (1 + np.exp(d @ w))) / n + ranker.RIDGE * w)
    assert np.allclose(model["weights"] * x.std(0), w, atol=1e-4)
    scores = 1 / (1 + np.exp(-((x - model["mean"]) @ model["weights"] + model["shift"])))
    assert (scores < ranker.THRESHOLD).sum() == (~good).sum()
    assert scores[good].mean() > scores[~good].mean() + 0.1


def test_language(spark):
    texts = [(EN if k % 2 else DE)[k % 20 :] * (1 + k % 9) for k in range(120)] + [None, "", "12 !?", "x" * 100_000]
    docs = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") >= 120, None).when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    net = langid.fit(docs)
    got = by_id(langid.predict(docs, net))
    assert all(got[k]["lang_pred"] == ("en" if k % 2 else "de") and 0.5 < got[k]["score"] <= 1 for k in range(120))
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (120, 121, 122)] == [("und", 0.0)] * 3 and got[123]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs.where("doc_id < 0"))).collect()} == {"und"}
    x = np.random.default_rng(2).integers(0, 256, (9, langid.WINDOW)).astype(np.uint8)
    slow = langid.probabilities(net, langid.forward(net, x)).reshape(langid.WINDOW, 9, -1)
    assert np.allclose(langid.read_windows(net, x), slow.transpose(2, 0, 1), atol=1e-4)


def test_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(4)
    H = langid.HIDDEN
    net = {"x": [rng.normal(0, 0.5, (256, 3 * H)).astype(np.float64)], "u": [rng.normal(0, 0.5, (H, 3 * H)).astype(np.float64)]}
    steps, d = rng.integers(0, 256, (5, 3)).astype(np.uint8), rng.normal(0, 1, (5, 3, H))
    cache = []
    langid.run_direction(net, 0, steps, cache)
    dx, du = langid.back_direction(net, 0, steps, cache, d)
    for w, g, at in ((net["u"][0], du, (1, 2)), (net["u"][0], du, (3, H + 1)), (net["u"][0], du, (0, 2 * H)), (net["x"][0], dx, (int(steps[1, 1]), 4))):
        keep, values = w[at], []
        for e in (1e-2, -1e-2):
            w[at] = keep + e
            values.append(float((langid.run_direction(net, 0, steps) * d).sum()))
        w[at] = keep
        assert g[at] == pytest.approx((values[0] - values[1]) / 2e-2, rel=0.05, abs=0.02)


def test_html(spark):
    w = html_text.model()
    rng, parser, right, n = np.random.default_rng(77), html_text.Parser(), 0, 0
    for _ in range(150):
        x, y = html_text.sample_sequence(rng, parser)
        if len(y):
            p, _ = html_text.label(w, x[:, None], np.array([len(y)]))
            right, n = right + int(((p[:, 0] >= 0.5) == (y > 0)).sum()), n + len(y)
    assert right / n > 0.96
    article = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class=ad>Buy now.</div><article><h1>A  title &amp; more</h1><p><b>First\n paragraph, it is long enough.<br>Second line.<p>Third one here, with words.</p><script>var x='</p>'</script></article><footer>&copy; site</footer>"
    rows = spark.createDataFrame([(1, article, "x"), (2, None, "x"), (3, "", "x"), (4, "<!-- open", "x"), (5, article, "x")], "page_id int, html string, url string")
    got = {r["page_id"]: r for r in html_text.extract(rows, w).collect()}
    assert got[1]["text"] == "A title & more\nFirst paragraph, it is long enough. Second line.\nThird one here, with words." == got[5]["text"]
    assert [got[k]["text"] for k in (2, 3, 4)] == ["", "", ""] and got[1]["n_chars"] == len(got[1]["text"])


def test_encoder_long_and_unknown():
    """Long fragments, many of them, and code points that Unicode tables of other versions may know."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), bpe.Encoder(path)
    texts = ["qwertyuiop" * 4000, " ".join("plokmijn" * 13 + str(k) for k in range(800)), "é" * 20_000]
    texts += [f"a{chr(x)}b B{chr(x)}" for x in (0x558, 0x1C89, 0x378, 0x2FE0, 0xE01, 0x10FFFF, 0xFFFF, 0x1FAFF, 0x323B0)]
    for text in texts:
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids, text[:20]


def test_html_long_attributes():
    long = ' class="ad" style="' + "x" * 200 + '"'
    for order in ((long, ""), ("", long), (long, long.replace("ad", "story"))):
        parser = html_text.Parser()
        for attributes in order:
            assert parser.path_slots("div", attributes) == html_text.Parser().path_slots("div", attributes)
    parser, pages = html_text.Parser(), [f"<div{long}>Buy now.</div>", "<div>A text.</div>", f"<div{long}>Buy now.</div>"]
    plain = lambda blocks: [(b.text, b.path.tolist(), b.linked) for b in blocks]
    assert [plain(parser.blocks(p)) for p in pages] == [plain(html_text.Parser().blocks(p)) for p in pages]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><meta a=b><title>x</title><body><p>Some text.</p></body></html>", ["Some text."]),
        ("<head><title>x</title><link rel=a><script>y</script><h1>Top</h1>text<p>more", ["Top", "text", "more"]),
        ("<head><title>x</title>\n<meta a=b> Bare text<p>more", ["Bare text", "more"]),
        ("<head><title>x<meta a=b><body><p>Some text.</p>", ["Some text."]),
        ("<head><title>x</head><body>Some text.<svg><title>no</title></svg>", ["Some text."]),
        ("<p>a <math><mi>b</mi><mo>+</mo></math> c<p>d", ["a b+ c", "d"]),
        ("<title>x<p>Some text.", ["Some text."]),
        ("<head><title>How <b> is used</title></head><body>Some <title>no</title> text.", ["Some", "text."]),
        ("<html><head><title>x</title><style>p</style></head>\n<body><header>a</header><p>b</body>", ["a", "b"]),
    ],
)
def test_html_open_head(page, want):
    assert [b[0] for b in html_text.Parser().blocks(page)] == want


def slow_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 7)
    assert [simhash.fingerprint((t or "").encode()) for t in ODD] == [slow_fingerprint(t) for t in ODD]
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(documents(spark, ODD)).collect()}
    assert got == {k: int(np.array([slow_fingerprint(t)], np.uint64).view(np.int64)[0]) for k, t in enumerate(ODD)}


@pytest.mark.parametrize("chunk", [4096, 5])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    bases = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = [0, 0]
    for k in range(300):
        x = int(bases[k % 12])
        for bit in rng.integers(0, 64, int(rng.integers(0, 5))):
            x ^= 1 << int(bit)
        fps.append(x)
    fps += [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    parent = [*range(len(fps))]

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([*enumerate(signed)], "doc_id long, fp long").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in simhash.components(df).collect()} == {k: find(k) for k in range(len(fps))}
    assert simhash.components(df.limit(0)).count() == 0


def test_classes():
    assert simhash.classes(4, np.array([1, 2, 0]), np.array([2, 3, 3])).tolist() == [0, 0, 0, 0]
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, m = int(rng.integers(1, 30)), int(rng.integers(0, 40))
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        want = [*range(n)]
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist()):
                want[a] = want[b] = min(want[a], want[b])
        assert simhash.classes(n, u, v).tolist() == want


def test_chain_in_one_group(spark):
    """The links of a chain (2nd-3rd-4th-1st by the pivot's distance) of which one pair shares a single group."""
    chain = [int(simhash.PIVOTS[0]) ^ sum(1 << b for b in bits) for bits in ((0, 1, 2), (3, 14, 26, 27), (0, 3, 13, 14, 26), (0, 1, 2, 13, 14, 26))]
    df = spark.createDataFrame([*enumerate(np.array(chain, np.uint64).view(np.int64).tolist())], "doc_id long, fp long")
    assert {r["component_id"] for r in simhash.components(df).collect()} == {0}


def test_one_of_each(spark):
    docs = documents(spark, ["a b c d", None, "A B c d", "", "x y z", "x y z"])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4]


def test_sharding(spark):
    texts = ODD + ["x" * (k * 37 % 400) for k in range(300)] + ["same"] * 150
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 3"))
    rows = sorted(((r["doc_id"], r["text_crc32"], r["slot"]), r["size"], r["shard"]) for r in sharding.shard_by_bytes(docs).collect())
    want = sorted((k, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for k, t in [*enumerate(texts), (3, texts[3]), (3, texts[3])])
    assert [(a[0], a[1], s) for a, s, _ in rows] == want
    total, before = sum(w[2] for w in want), 0
    for (_, size, shard), w in zip(rows, want):
        assert shard == (2 * before + w[2]) * 8 // (2 * total)
        before += size
    for s in range(8):
        slots = sorted(a[2] for a, _, shard in rows if shard == s)
        assert slots == [*range(len(slots))]
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_packing_ids():
    """The library's ids of whole texts, also of long runs of one kind of character, and of code points in all planes."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = np.random.default_rng(12)
    pool = [*"ab'stre  \n\t.,1٣é\x85\xa0\u2003\x1c漢😀\u0558", "<|endoftext|>", "   ", "'ll", " \n"]
    fuzz = ["".join(rng.choice(pool, int(rng.integers(1, 40)))) for _ in range(1500)]
    whole = lambda x: t.encode(x, add_special_tokens=False).ids
    e = packing.Encoder(path)
    for text in [x or "" for x in ODD] + fuzz:
        assert e.encode(text).tolist() == whole(text), text
    for text in (" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "é " * 700_000, "ab\n\n " * 400_000):
        assert e.encode(text).tolist() == whole(text)
    points = [f"a{chr(x)}b {chr(x)}1" for x in range(0x80, 0x32000, 7) if not 0xD800 <= x < 0xE000]
    for text, known in zip(points, t.encode_batch_fast(points, add_special_tokens=False)):
        assert e.encode(text).tolist() == known.ids, text
    for text in fuzz[:300]:  # long units, specials and unknown code points beside one another
        text = text + "x" * 1500 + text + " " * 1200 + text
        assert e.encode(text).tolist() == whole(text), text


def test_cuts():
    for n in (1, 2, 7, 8, 9, 16, 17):
        at = packing.cuts(n, 8)
        sizes = [b - a for a, b in zip(at, [*at[1:], n])]
        assert sum(sizes) == n and all(x == 8 for x in sizes[1:]) and 1 <= sizes[0] <= 8 and len(sizes) == -(-n // 8)


def test_plan():
    rng = np.random.default_rng(6)
    for n, capacity in ((0, 64), (1, 64), (400, 64), (20_000, 64)):
        counts = Counter(rng.integers(1, capacity + 1, n).tolist())
        found, held = packing.plan(counts, capacity), Counter()
        for config, k in found:
            assert sum(a * m for a, m in config) <= capacity
            for a, m in config:
                held[a] += m * k
        assert held == counts
        least = -(-sum(a * m for a, m in counts.items()) // capacity)
        assert sum(k for _, k in found) <= least * 1.02 + 2


def test_packing(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + ["word " * k for k in range(0, 2500, 50)] + ["copy of this"] * 40
    docs = documents(spark, texts)
    got = packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(texts)
    for k, rows in by_doc.items():
        ids = [*t.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        rows.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in rows] == packing.cuts(len(ids), 1024) and sum(r["length"] for r in rows) == len(ids)
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r["length"] for r in got) // 1024) + 2
    assert packing.pack(packing.pieces(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0

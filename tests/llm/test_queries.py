"""The registered queries opN_ and the pipeline, on small tables of odd rows, against brute force from the contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_copies import slow_components
from tests.llm.test_operators import ODD, many_labels, slow_fingerprint, slow_measures, slow_tail
from turnstore.llm import html_text, langid, packing, quality_rules, queries
from turnstore.llm.common import SENT_IDS, every

EN = "the of and with house river people water morning against between story little under garden while road letter window never".split()
DE = "der die und mit dem haus fluss leute wasser morgen gegen zwischen klein unter garten während straße brief fenster niemals über".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, `n_words` string, `_gone` string, kept string, lang_pred string"


def words(rng, pool, n, mark=""):
    return " ".join(f"{pool[x]}{mark}" for x in rng.integers(0, len(pool), n))


@pytest.fixture(scope="module")
def texts():
    """Position is id: English and German prose, texts full of symbols, copies of both kinds, and odd ones."""
    rng = np.random.default_rng(21)
    out = [words(rng, (EN, DE)[k % 2], int(rng.integers(40, 90))) for k in range(300)]
    out += [words(rng, EN, 60, "#$%") for _ in range(40)]
    for k in range(0, 40, 2):  # near copies, and copies of every fourth text
        near = out[k].split()
        near[int(rng.integers(0, 5))] = "changed"
        out += [" ".join(near)] + [out[k]] * (k % 4 == 0)
    return [*out, *ODD, None, "", "123 456 !?", words(rng, EN, 30_000), words(rng, DE, 3_000) + "\n" * 50_000, "x" * 120_000]


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, t, ("en", "de")[k % 2] if k < 300 and k % 7 else None, "s", 0, "c", "c", "c", "c", "c") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k < 300), 0) for k in range(340) if k % 9] + [(1, None, 0), (None, 1, 0), (10**9, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &lt;b&gt; title</h1><p>One sentence here,\n and more.</p><p>Another   one with words.</p></article><footer>&copy; us</footer></body></html>"
    pages = [(1, "u", page), (2, "v", None), (3, "v", ""), (4, "w", page), (5, "x", page.replace("Another", "Another " * 40_000)), (6, "y", "<div>" * 5000 + "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def rows_of(query, spark, folder, columns):
    df = query(spark, folder)
    assert df.columns[: len(columns.split())] == columns.split()
    return df.collect()


def test_empty_tables(spark, empty_dir):
    for name, query in queries.queries().items():
        assert query(spark, empty_dir).count() == 0, name


def test_op1(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in rows_of(queries.op1_quality_ranking, spark, sf_dir, "doc_id held_out score predicted")}
    assert len(got) == len(texts) and all(r["held_out"] == held_out(k) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for k, r in got.items())
    right = [got[k]["predicted"] == (k < 300) for k in range(340) if held_out(k)]
    assert sum(right) / len(right) > 0.95
    same = defaultdict(set)
    for k, t in enumerate(texts):
        same[t or ""].add(got[k]["score"])
    assert all(max(x) - min(x) < 1e-12 for x in same.values())


def test_op2(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in rows_of(queries.op2_quality_rules, spark, sf_dir, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept")}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = slow_measures(t)
        assert tuple(got[k])[1:6] == want and got[k]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[k]["base_failed"] and got[k]["kept"])
    assert all(got[k]["kept"] != got[k]["base_failed"] for k in range(300)) and not any(got[k]["kept"] for k in range(300, 340))


def test_op3(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in rows_of(queries.op3_language_id, spark, sf_dir, "doc_id held_out lang_pred score")}
    assert len(got) == len(texts) and all(r["held_out"] == held_out(k) and 0 <= r["score"] <= 1 for k, r in got.items())
    right = [got[k]["lang_pred"] == ("en", "de")[k % 2] for k in range(300) if held_out(k)]
    assert sum(right) / len(right) > 0.95
    letter = langid.LETTER
    assert all((got[k]["lang_pred"] == "und") == (not letter.search(t or "")) for k, t in enumerate(texts))


def test_op4(spark, sf_dir, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in rows_of(queries.op4_bpe_round_trip, spark, sf_dir, "doc_id n_tokens ids_sha256 decoded_sha256")}
    assert len(got) == len(texts)
    for k, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[k])[1:4] == want


def test_op5(spark, sf_dir, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in rows_of(queries.op5_token_counts, spark, sf_dir, "doc_id n_bytes n_tokens over_limit")}
    assert {k: tuple(r)[1:4] for k, r in got.items()} == {k: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for k, t in enumerate(texts)}


def test_op6(spark, sf_dir):
    got = {r["page_id"]: r for r in rows_of(queries.op6_html_text, spark, sf_dir, "page_id url text n_chars")}
    text = "A <b> title\nOne sentence here, and more.\nAnother one with words."
    assert got[1]["text"] == got[4]["text"] == text and got[2]["text"] == got[3]["text"] == "" and len(got) == 6
    assert got[5]["text"] == text.replace("Another", " ".join(["Another"] * 40_000)) and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_op7(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in rows_of(queries.op7_simhash, spark, sf_dir, "doc_id fingerprint component_id")}
    fps = [slow_fingerprint(t) for t in texts]
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{x:016x}" for k, x in enumerate(fps)}
    x, label = np.array(fps, np.uint64), np.arange(len(fps))
    linked = np.bitwise_count(x[:, None] ^ x) <= 3
    for _ in range(20):
        label = np.array([label[row].min() for row in linked])
    assert {k: r["component_id"] for k, r in got.items()} == dict(enumerate(label.tolist()))


def test_op8(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in rows_of(queries.op8_media_audio, spark, sf_dir, "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature")}
    features = defaultdict(set)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert tuple(got[k])[1:5] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        features[raw].add((got[k]["media_bytes"], got[k]["media_sha256"], got[k]["feature"]))
    assert len(got) == len(texts) and all(len(x) == 1 for x in features.values())


def test_op9(spark, sf_dir, texts):
    got = sorted(rows_of(queries.op9_sharding, spark, sf_dir, "doc_id size text_crc32 law shard slot grown_shard"))
    assert [tuple(r)[:4] for r in got] == [(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes") for k, t in enumerate(texts)]
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) <= set(range(8)) and all(sorted(x) == [*range(len(x))] for x in slots.values()) and {r["grown_shard"] for r in got} == {None}


def check_packing(rows, texts):
    """Pieces are those of the library's ids, places are gapless, and sequences are as few as can be, but for a few."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for k, mine in by_doc.items():
        ids = np.array([*t.encode(texts[k] or "", add_special_tokens=False).ids, 2], "<u4")
        starts = packing.cuts(len(ids), 1024)
        want = [(p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in mine) == want
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= math.ceil(sum(r["length"] for r in rows) / 1024) + 2


def test_op10(spark, sf_dir, texts):
    check_packing(rows_of(queries.op10_packing, spark, sf_dir, "doc_id piece start length ids_crc32 sequence_id offset"), dict(enumerate(texts)))


def slow_language(net, text):
    """The network's mean probabilities over the letters' bytes, by the plain forward pass."""
    if not langid.LETTER.search(text or ""):
        return "und", 0.0
    data = text.lower().encode()
    data += bytes(-len(data) % langid.WINDOW)
    windows = np.frombuffer(data, np.uint8).reshape(-1, langid.WINDOW)
    p = langid.probabilities(net, langid.forward(net, windows))
    on = langid.IS_LETTER[windows.T].reshape(-1)
    mean = p[on].mean(0) if on.any() else np.zeros(len(net["names"]))
    return net["names"][int(mean.argmax())], float(mean.max())


def slow_rules(text):
    """Stratum and rule values of a text."""
    n, chars, symbols, lines, repeats = slow_measures(text)
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    upper, stale = len(re.findall("[A-Z]", text or "")), n - len(set(found))
    per = {r: 1000 * v // max(n, 1) for r, v in dict(symbols=symbols, dup_lines=lines, repeats=repeats, stale=stale, word_chars=chars).items()}
    return sum(n >= x for x in quality_rules.STRATA) - 1, per | {"upper": 1000 * upper // max(chars, 1)}


def slow_cutoffs(texts, labels):
    """The cutoff of each stratum and rule, from the docstring's law."""
    rows, out = [(*slow_rules(texts[k]), good) for k, good in labels.items() if k in texts], {}
    for s in range(len(quality_rules.STRATA)):
        n = sum(good for stratum, _, good in rows if stratum == s)
        for rule, grid in quality_rules.RULES.items():
            best = 0
            for c in sorted(grid, reverse=True):
                over = [good for stratum, v, good in rows if stratum == s and v[rule] > c]
                k, bad = sum(over), len(over) - sum(over)
                if not n or slow_tail(k, n, quality_rules.ALPHA) > quality_rules.DELTA / quality_rules.CHAINS:
                    break  # the chain ends at its first failure
                if bad - quality_rules.PRICE * k > best:
                    best, out[s, rule] = bad - quality_rules.PRICE * k, c
    return out


def test_pipeline(spark, sf_dir, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "pack"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    net = langid.fit(docs)
    left = {}
    for k, t in enumerate(texts):
        lang, score = slow_language(net, t)
        assert abs(score - corpus_pipeline.LEAST_SCORE) > 1e-3
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            left[k] = t
    assert 300 < len(left) < len(texts)
    labels = {k: int(k < 300) for k in range(340) if k % 9}
    cut = slow_cutoffs(left, labels)
    assert cut[0, "symbols"] == 800
    kept = {}
    for k, t in left.items():
        s, values = slow_rules(t)
        if not any(values[r] > cut.get((s, r), math.inf) for r in quality_rules.RULES):
            kept[k] = t
    assert set(range(300)) <= set(kept) and not set(range(300, 340)) & set(kept)
    ids = sorted(kept)
    label = slow_components([kept[k] for k in ids])
    alone = {k: kept[k] for place, k in enumerate(ids) if label[place] == place}
    assert len(alone) < len(kept) - 20
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), alone)


def test_quality_stage_many_labels(spark, tmp_path):
    """The stage takes every label, also if their ids are too many to be sent to all tasks."""
    docs, labels = many_labels(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert labels.count() > SENT_IDS
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(115)]


def test_stages_keep_odd_rows_apart(spark, sf_dir):
    """Nulls in any column, repeated rows and ids, and ties go through every stage."""
    docs = spark.createDataFrame([(None, "the house and the river with the garden", None), (7, None, "a"), (7, None, "a"), (8, "the house and the river with the garden", "b"), (8, "the house and the river with the garden", "b"), (9, "the house and the river with the garden", None)], "doc_id long, text string, `x.y` string").withColumn("lang", F.lit("en"))
    assert corpus_pipeline.quality(spark, docs, sf_dir).count() == 6
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).select(*every(docs)).collect()]
    assert sorted(kept, key=str) == sorted([tuple(r) for r in docs.collect() if r["doc_id"] != 9], key=str)
    assert corpus_pipeline.language(spark, docs, sf_dir).count() == 4
    assert corpus_pipeline.pack(spark, docs, sf_dir).count() == 6


def test_html_gradients():
    """Backpropagation through time of the LSTM against differences."""
    rng, H = np.random.default_rng(6), html_text.HIDDEN
    w = {"x": [rng.normal(0, 0.4, (5, 4 * H))], "u": [rng.normal(0, 0.4, (H, 4 * H))], "b": [rng.normal(0, 0.4, 4 * H)]}
    x, d = rng.normal(0, 1, (6, 3, 5)), rng.normal(0, 1, (6, 3, H))
    cache = []
    html_text.lstm(w, 0, x, cache)
    grads = dict(zip("xub", html_text.lstm_back(w, 0, x, cache, d)))
    for name, at in (("x", (2, 1)), ("x", (4, 3 * H + 2)), ("u", (1, H + 3)), ("u", (0, 2 * H)), ("u", (3, 3 * H)), ("b", (5,)), ("b", (3 * H + 1,))):
        p, values = w[name][0], []
        keep = p[at]
        for e in (1e-3, -1e-3):
            p[at] = keep + e
            values.append(float((html_text.lstm(w, 0, x) * d).sum()))
        p[at] = keep
        assert grads[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, rel=0.02, abs=0.02)


def test_html_blocks_by_definition():
    """Depth costs memory once for each element; drawings and formulas stay in their block; a batch changes nothing."""
    n = 20_000
    blocks = html_text.Parser().blocks("<div class=a>" * n + "<p>x" * 50 + "</span>" * n)
    assert len(blocks) == 50 and len({id(b.path) for b in blocks}) == 50 and blocks[0].path.max() == 2
    parts = "<p>a <math><mi>x</mi><mo>=</mo></math> <svg><text>y</text></svg><noscript>z</noscript><video>v</video><canvas>c</canvas><object>o</object></p><select><option>no</option></select><button>no</button><textarea>no</textarea><p>b</p>"
    assert [b.text for b in html_text.Parser().blocks(parts)] == ["a x= yzvco", "b"]
    w, rng = html_text.model(), np.random.default_rng(3)
    pages = ["".join(x for x, _ in html_text.sample_page(rng)) for _ in range(30)]
    together = html_text.main_texts(w, html_text.Parser(), pages)
    assert together == [html_text.main_texts(w, html_text.Parser(), [p])[0] for p in pages]

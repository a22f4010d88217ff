"""Near copies against all pairs of shingle sets, in small groups and chunks, and the defined cases."""

import numpy as np
import pytest

from tests.llm.test_operators import ODD, documents
from turnstore.llm import near_copies, simhash


def slow_components(texts):
    """The least position reachable by pairs whose sets of five-word shingles have a cosine of 0.8 or more."""
    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = [*range(len(texts))]
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) and 25 * len(sets[a] & sets[b]) ** 2 >= 16 * len(sets[a]) * len(sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def copies(rng, n=240):
    """Texts with one to eight changed words in each of a few, so that similarities lie on both sides of the bound."""
    bases = [[f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 200)))] for _ in range(6)]
    shared = [f"s{x}" for x in range(120)]
    texts = []
    for k in range(n):
        words = list(bases[k % 6]) + (shared if k % 3 == 0 else [])
        for at in rng.integers(0, len(words), int(rng.integers(0, 12))):
            words[at] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("chunk", [4096, 5])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies, "CHUNK_SHINGLES", 200 * chunk)
    texts = ODD + copies(np.random.default_rng(3)) + ["word " * 9000, "WORD " * 9000]
    want = slow_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(documents(spark, texts)).collect()}
    assert got == dict(enumerate(want)) and 10 < len(set(want)) < len(texts) - 50


def slow_possible(a, b):
    """Whether sizes and parity fingerprints let two sets be similar, from the definition."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    width = min(8 * near_copies.fingerprint(x).nbytes for x in (a, b))
    odd = [np.bincount((x % np.uint64(width)).astype(int), minlength=width) % 2 for x in (a, b)]
    most = min(len(a), len(b), (len(a) + len(b) - int((odd[0] != odd[1]).sum())) / 2)
    return most > 0 and 25 * most * most >= 16 * len(a) * len(b)


def test_classes_and_bounds():
    """Fingerprints of all widths never rule out a linked pair; classes are those of the possible links."""
    rng = np.random.default_rng(9)
    sets = [near_copies.shingle_set(t.encode()) for t in copies(rng, 90)] + [near_copies.shingle_set(" ".join(f"a{x}" for x in range(k)).encode()) for k in (0, 1, 3, 9, 20, 21, 36, 37, 68, 70, 132, 134, 140)]
    n = np.array([len(h) for h in sets])
    possible = np.array([[slow_possible(a, b) for b in sets] for a in sets])
    similar = np.array([[25 * len(np.intersect1d(a, b)) ** 2 >= 16 * len(a) * len(b) if len(a) * len(b) else len(a) == len(b) for b in sets] for a in sets])
    assert (possible | ~similar).all() and (possible & ~similar).any() and not possible.all()
    label = np.arange(len(sets))
    for _ in sets:
        label = np.array([label[row].min() for row in possible])
    assert near_copies.classes(n, [near_copies.fingerprint(h).tobytes() for h in sets]).tolist() == label.tolist()


def test_linked_texts():
    texts = ODD + copies(np.random.default_rng(6), 80)
    assert near_copies.linked_texts(texts).tolist() == slow_components(texts)


def test_no_listed_pairs(spark):
    """A family of 300 different texts gives back a link for each row of a group at most."""
    texts = copies(np.random.default_rng(7), 1800)[::6]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "g long, id long, text string")
    found = near_copies.links_in_groups(rows, lambda group: near_copies.linked_texts(group.column(2).to_pylist()))
    assert 200 < found.count() < 300


def test_slices(monkeypatch):
    text = copies(np.random.default_rng(5), 1)[0].encode()
    h = near_copies.shingle_set(text)
    least = near_copies.least_hashes(h)
    monkeypatch.setattr(near_copies.simhash, "GROUP", 7)
    monkeypatch.setattr(near_copies, "GROUP", 7 * len(least))
    assert near_copies.shingle_set(text).tolist() == h.tolist()
    assert near_copies.least_hashes(h).tolist() == least.tolist()


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(100))
    docs = documents(spark, [text, None, text.upper() + " more", "", "x y z", "x y z", "other words are in this one"])
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4, 6]
    nameless = docs.selectExpr("if(doc_id = 2, null, doc_id) as doc_id", "text")
    assert near_copies.one_of_each(nameless).count() == 5
    # one id with two texts that are each a copy of another document's
    twice = docs.where("doc_id in (0, 4)").selectExpr("doc_id + 10 as doc_id", "text").unionByName(spark.createDataFrame([(10, "x y z")], "doc_id long, text string"))
    assert [r["doc_id"] for r in near_copies.one_of_each(twice).select("doc_id").distinct().collect()] == [10]
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("of", [near_copies.one_of_each, simhash.one_of_each])
def test_clashing_names(spark, of):
    """Extra columns that are called as the working columns are."""
    names = ["gone", "Gone_", "_gone", "id", "key", "a", "b", "node", "root", "fp", "_fp", "same", "n", "g", "c", "x.y"]
    rows = [(k, t, *[7] * len(names)) for k, t in enumerate(["a b c d e f", "other words", "A b c d e f", None])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = of(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3] and kept.first()["x.y"] == 7

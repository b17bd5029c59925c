"""Canonical values, near copies and components, against brute force."""

import random

import numpy as np
import pytest

from larder.llm import boilerplate, canonical, neardup
from larder.llm.components import components
from larder.llm.staging import may_hold, staged
from larder.llm.words import WORD, WordHasher, hash64, word_hashes

ALIASES = [("zinc", "min_zinc"), ("Zink", "min_zinc"), ("Kalium", "min_potassium"), ("potassium", "min_potassium"), ("vitamin B1", "vit_b1"), ("Vitamin B12", "vit_b12"), ("thiamine", "vit_b1"), ("Vitamin E", "vit_e"), ("gesättigte Fettsäuren", "mac_sfa"), ("einfach ungesättigte Fettsäuren", "mac_mufa"), ("Omega-3-Fettsäuren", "fa_omega3"), ("Omega-6-Fettsäuren", "fa_omega6"), ("Magnesium", "min_magnesium"), ("Mangan", "min_manganese"), ("riboflavin", "vit_b2")]
MEANT = [
    ("ZINK", "min_zinc"), ("  zinc", "min_zinc"), ("„Zink“", "min_zinc"), ("davon Kalium", "min_potassium"), ("poatssium", "min_potassium"), ("p0tassium", "min_potassium"), ("VITAMINB12", "vit_b12"), ("Vit. B-1", "vit_b1"),
    ("B12 (Vitamin)", "vit_b12"), ("Vtiamin E", "vit_e"), ("VITAMINE", "vit_e"), ("Fettsäuren (gesättigte)", "mac_sfa"), ("gesaettigte fettsauren", "mac_sfa"), ("omega-6-fettsäuren", "fa_omega6"), ("Magnan", "min_manganese"), ("mangesium", "min_magnesium"),
    ("Histamin", None), ("Isoflavone", None), ("Koffein", None), ("?", None), ("  ", None), ("Vitamin B7", None), ("Vitamin", None), ("x" * 5000, None),
]


def test_match_values(spark):
    values = spark.createDataFrame([(v,) for v, _ in MEANT] * 2, "value string")
    reference = spark.createDataFrame([*ALIASES, (None, "x"), ("zinc", "min_zinc")], "alias string, entry_id string")
    got = {r["value"]: r["entry_id"] for r in canonical.match_values(values, reference).collect()}
    assert got == dict(MEANT)
    assert canonical.match_values(values.where("false"), reference).count() == 0
    assert {r["entry_id"] for r in canonical.match_values(values, reference.where("false")).collect()} == {None}


def test_edits():
    assert canonical.edits("kpufer", "kupfer") == 1 and canonical.edits("", "abc") == 3 and canonical.edits("abc", "abc") == 0


def sequences(text):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def corpus():
    chosen = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(120):
        base = [chosen.choice(words) for _ in range(chosen.choice([4, 9, 20, 60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(chosen.randrange(4)):
            copy = list(base)
            for _ in range(chosen.randrange(1 + len(copy) // 12)):
                at = chosen.randrange(len(copy))
                copy[at : at + chosen.randrange(2)] = [chosen.choice(words)]
            texts.append(" ".join(copy))
    texts += [texts[3]] * 5 + [None, "", "a b", "Nur zwei", "A b c", "a, B; c!", "wort " * 3000]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def truth():
    rows = corpus()
    sets = {i: sequences(t) for i, t in rows if t}
    sets = {i: s for i, s in sets.items() if s}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_pairs(spark, truth):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows + rows[:40]], "chunk_id bigint, text string, text_key string").repartition(5)
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in neardup.found_pairs(df).collect()}
    assert got <= truth and len(got) >= 0.99 * len(truth)
    assert neardup.found_pairs(df.where("false")).count() == 0


def test_classes(spark, truth):
    rows = corpus()
    got = {r["chunk_id"]: r for r in neardup.classes(spark.createDataFrame(rows, "chunk_id bigint, text string")).collect()}
    links = {}
    for a, b in truth:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    assert sum(r["links"] == links.get(i, 0) for i, r in got.items()) >= 0.99 * len(got)
    assert all(got[a]["class_id"] == got[b]["class_id"] <= a for a, b in truth)


def test_components(spark):
    chosen = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in chosen.integers(0, 300, (230, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    expected = {x: find(x) for x in list(root)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges * 2, "a bigint, b bigint")).collect()}
    assert got == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_filter_loses_nothing(spark):
    held = may_hold(spark.range(0, 1000, 7), "id", 1 << 16)
    passed = {r["id"] for r in spark.range(3000).where(held("id")).collect()}
    assert passed >= set(range(0, 1000, 7)) and len(passed) < 700
    assert spark.range(10).where(may_hold(spark.range(0), "id")("id")).count() == 0
    assert staged(spark.range(5)).count() == 5


def test_every_pair_at_the_bound(spark):
    """Pairs just at and just below the share, of like and unlike sizes and with columns of every frequency: all and only those."""
    chosen = random.Random(11)
    words = [f"w{int(chosen.paretovariate(0.7))}" for _ in range(3000)]
    rows = []
    for size in (30, 60, 130, 260):
        for _ in range(60):
            base = [chosen.choice(words) for _ in range(size)]
            rows.append(" ".join(base))
            rows.append(" ".join(base[: int(size * chosen.uniform(0.57, 0.7))]))
            copy = list(base)
            for at in range(0, size, chosen.choice([9, 10, 11, 12, 13])):
                copy[at] = f"x{chosen.randrange(10**6)}"
            rows.append(" ".join(copy))
    sets = [sequences(t) for t in rows]
    expected = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in neardup.found_pairs(spark.createDataFrame(list(enumerate(rows)), "chunk_id bigint, text string")).collect()}
    assert len(expected) > 150 and got == expected


def test_short_copies(spark):
    """A text of 14 words and its copies with words added, up to the longest that is still near."""
    base = [f"k{i}" for i in range(14)]
    rows = [" ".join(base)] + [" ".join(base + [f"m{n}x{i}" for i in range(n)]) for n in (1, 4, 8, 9)]
    got = {tuple(r) for r in neardup.found_pairs(spark.createDataFrame(list(enumerate(rows)), "chunk_id bigint, text string")).collect()}
    assert {(0, 1), (0, 2), (0, 3)} <= got and (0, 4) not in got


def test_all_texts_are_counted(spark):
    """Every text counts in the order of the columns and in the number of entries."""
    rows = corpus()
    steps, entries = neardup._frequencies(spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(3))
    values = [v for _, t in rows if t for v in neardup._sequences([t])[1].tolist()]
    n = np.bincount(np.array(values) % neardup.BUCKETS, minlength=neardup.BUCKETS)
    assert entries == len(values) and (steps == np.minimum(255, 8 * np.log2(1 + n)).astype(np.uint8)).all()
    assert neardup._frequencies(spark.createDataFrame([], "chunk_id bigint, text string"))[1] == 0


def test_many_copies(spark, monkeypatch):
    """Texts that stand many times are made into features once, and every copy is in the pairs; also those of an id with two texts."""
    base = [f"k{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(base[:-2] + ["m", "n"]), " ".join(f"z{i}" for i in range(30)), "a b", None]
    rows = [(10 * copy + i, t) for copy in range(12) for i, t in enumerate(texts)] + [(0, texts[2]), (0, texts[2])]
    kept, made = neardup._without_copies(spark.createDataFrame(rows, "chunk_id bigint, text string"))
    assert made == 4 and kept.count() < len(rows) / 4
    sets = {}
    for i, t in rows:
        if t and len(t.split()) > 2:
            sets.setdefault(i, []).append(sequences(t))
    near = lambda a, b: any(len(x & y) >= 0.6 * len(x | y) for x in sets[a] for y in sets[b])
    expected = sorted((a, b) for a in sets for b in sets if a < b and near(a, b))
    df = spark.createDataFrame(rows, "chunk_id bigint, text string")
    assert sorted(tuple(r) for r in neardup.found_pairs(df).collect()) == expected
    monkeypatch.setattr(neardup, "REPEATED", 10**9)
    assert sorted(tuple(r) for r in neardup.found_pairs(df).collect()) == expected


def test_words_without_objects():
    """Hashes of words equal each other where the words do, whatever the script, also over the ends of blocks."""
    texts = ["", None, "a", "Ab1 ª² _x_y ÄÖ\ud800x İstanbul ΣΑΣ ΑΣ. Σ", "x" * 300_000 + " y", "\n\n", "٣٤ x ab1", "y-Äö A"] * 3
    hashes, counts = word_hashes(texts)
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    assert counts.tolist() == list(map(len, words))
    pairs = set(zip((w for ws in words for w in ws), hashes.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    many = ["".join(chr(97 + i // 26**k % 26) for k in range(8)) for i in range(300_000)]
    assert len(np.unique(word_hashes([" ".join(many)])[0])) == len(many)


def test_hashes_do_not_collide():
    """A million words of one length keep a million hashes."""
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(8)) for i in range(1_000_000)]
    flat, counts = WordHasher().flat([words])
    assert len(np.unique(flat)) == len(words) == counts.sum()
    assert hash64("gnyijstj") != hash64("etislvlf") and boilerplate.path_key("gnyijstj") != boilerplate.path_key("etislvlf")


@pytest.mark.parametrize(("words", "every", "choices", "entries"), [(130, 13, 30, None), (280, 14, 30, None), (130, 14, 3, None), (130, 13, 30, 500)])
def test_template_families(spark, monkeypatch, words, every, choices, entries):
    """Texts of one template, which differ in some words, lose no link, also where their columns swell a part of the product."""
    if entries:
        # one part, which is far beyond its share
        steps = neardup._frequencies
        monkeypatch.setattr(neardup, "_frequencies", lambda chunks: (steps(chunks)[0], 1))
        monkeypatch.setattr(neardup, "TASK_ENTRIES", entries)
    chosen = random.Random(words + every + choices)
    template = [f"wort{k}" for k in range(words)]
    texts = [" ".join(f"{chosen.randrange(choices)}s{k}" if k % every == 0 else w for k, w in enumerate(template)) for _ in range(120)]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    expected = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in neardup.found_pairs(spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string")).collect()}
    assert got == expected and len(expected) > 100

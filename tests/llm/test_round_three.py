"""Fill-in-the-middle, ranked search and MinHash: against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import lexical, middle, minhash

DOCS = "doc_id long, text string, form string, n long, node long, token long, score double, rank int"


def row(doc_id, text):
    return (doc_id, text, "f", 1, 2, 3, 0.5, 4)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([row(*r) for r in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["alpha", "beta", "été", "Straße", "漢字", "🙂", "x1", "don't", "A", "é"]
    texts = [None, "", " ", "a", "<P>", "has <M> in it", "<", "<P", "x" * 40000, "🙂é" * 30000]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(120)]
    return [(k, t) for k, t in enumerate(texts)] + [(7, "again"), (7, "again"), (9, texts[9]), (None, "lost"), (-3, "less than zero")]


def plain_middle(doc_id, text):
    h = hashlib.sha256(b"1:" + str(doc_id).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k * 8 : k * 8 + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return (doc_id, len(text), "plain", None, None, sha(text), sha(text))
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return (doc_id, len(text), form, a, b - a, sha(out), sha(text))


@pytest.mark.parametrize("chunk", [1, 7, middle.CHUNK])
def test_fill_in_middle(spark, rows, chunk):
    own = [r for r in rows if r[1] is None or len(r[1]) < 1000 or chunk > 100]
    got = sorted(map(tuple, middle.digests(frame(spark, own), chunk).collect()), key=str)
    expected = sorted((plain_middle(k, t or "") for k, t in own if k is not None), key=str)
    assert got == expected
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_middle_texts_restore(spark, rows):
    docs = frame(spark, rows)
    out = middle.transformed(docs)
    assert out.columns == [c for c in docs.columns if c != "form"] + ["form", "prefix_chars", "middle_chars"]
    back = middle.restored(out)
    assert sorted((r.doc_id, r.text) for r in back.collect() if r.doc_id is not None) == sorted((k, t or "") for k, t in rows if k is not None)
    assert middle.digests(frame(spark, [])).count() == 0 and middle.transformed(frame(spark, [])).count() == 0


def test_middle_takes_the_same_keys_in_any_order(spark):
    same = [(5, "one text")] * 4 + [(5, "other")] * 2
    key = lambda docs: sorted((r.content, r.copy) for r in middle.pieces(docs).collect())
    one, two = (spark.createDataFrame([row(*r) for r in order], DOCS).coalesce(1) for order in (same, same[::-1]))
    assert key(one) == key(two) and len(set(key(one))) > 6 - 1


def plain_minhash(rows):
    """All pairs, on rows that may repeat a doc_id."""
    found = [(k, minhash.shingles((t or "").encode())) for k, t in rows if k is not None]
    root = {k: k for k, _ in found}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for at, (a, one) in enumerate(found):
        for b, two in found[:at]:
            if one and two and 100 * len(one & two) >= 80 * len(one | two):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return sorted((k, len(s), top(k) if s else k, (top(k) if s else k) == k) for k, s in found)


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(13)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, t) for k, t in enumerate([None, "", " \t\x0b", "one", "ONE", "one two", "One\x0ctwo\n", "a b c d e", "a b c d e f", "a b a b a b", "é É", "\x1c"])]
    for group in range(30):
        base = rng.choices(words, k=rng.randint(20, 120))
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 12)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows + [(None, "one"), (max(k for k, _ in rows) + 1, "long " * 50000)]


def test_minhash(spark, near_rows):
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, near_rows)).collect()))
    expected = plain_minhash(near_rows)
    assert got == expected
    assert 20 < sum(not r[3] for r in got) < len(got) - 30
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_minhash_of_repeated_ids(spark, near_rows):
    rows = [r for r in near_rows if r[0] is not None][:60]
    rows += [(rows[0][0], rows[5][1]), rows[7], rows[7], (rows[9][0], "a text of its own, of many words that are here alone")]
    assert sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect())) == plain_minhash(rows)


def chained(n, words=60):
    """n texts, each similar to the next alone: a component that no leader is in the middle of."""
    return [(k, " ".join(f"w{j}" for j in range(k * 5, k * 5 + words))) for k in range(n)]


def test_minhash_of_a_chain_and_of_a_large_group(spark):
    base = [f"v{j}" for j in range(200)]
    group = [(1000 + k, " ".join(base[:k] + [f"own{k}"] + base[k + 1 :])) for k in range(150)]
    rows = chained(40) + group
    expected = plain_minhash(rows)
    assert {r[2] for r in expected} == {0, 1000}
    assert sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect())) == expected


def altered(rng, base, n, most):
    """n texts of base, each with up to `most` of its words gone, replaced or with another put in."""
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(text))
            text[at : at + rng.choice((1, 1, 0))] = rng.choice(([f"x{rng.randrange(60)}"], [f"y{k}_{at}"], []))
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_near_groups_lose_no_link_and_make_few_pairs(spark, monkeypatch, seed):
    """Many members aren't similar to the leader; some of them are similar to one another."""
    seen, rng = [], random.Random(seed)
    whole = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, texts: seen.append(pairs.count()) or whole(pairs, texts))
    base = [f"v{j}" for j in range(120)]
    texts = altered(rng, base, 150, 22)
    second = altered(rng, texts[-1].split(), 25, 3) + altered(rng, base[:88], 12, 2) + altered(rng, base[20:] + [f"z{k}" for k in range(15)], 12, 2)
    rows = list(enumerate(texts + second))
    expected = plain_minhash(rows)
    assert sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect())) == expected
    assert 3 < len({r[2] for r in expected}) < 150 and sum(seen) < len(rows) * (len(rows) - 1) // 2 / 3


def test_differences_find_each_link():
    """All pairs of a leader's group: a similar pair with a straggler has at least as many differences in common as either calls for."""
    rng, n = random.Random(5), 0
    for _ in range(12):
        base = [f"v{j}" for j in range(rng.randint(6, 80))]
        found = [minhash.shingles(t.encode()) for t in [" ".join(base), *altered(rng, base, 40, len(base) // 4), *altered(rng, base[: len(base) * 3 // 4], 15, 2)]]
        found = [s for s in found if s]
        met = [minhash.differences(s, found[0]) for s in found]
        for i, (one, (linked_one, least_one, first)) in enumerate(zip(found, met, strict=True)):
            for two, (linked_two, least_two, second) in list(zip(found, met, strict=True))[:i]:
                if minhash.similar(one, two) and one != two and not (linked_one and linked_two):
                    n += 1
                    assert len(set(first) & set(second)) >= max(least_one, least_two) >= 1
    assert n > 200


def inserted(rng, base, groups, n, passage):
    """Near copies of base, of which each group has a passage of its own somewhere, and some have the passages of two."""
    held = [[f"g{g}_{j}" for j in range(passage)] for g in range(groups)]
    out = []
    for g in range(groups):
        for k in range(n):
            text = list(base)
            text[rng.randrange(len(text))] = f"own{g}_{k}"
            at = len(base) // 2
            out.append(" ".join(text[:at] + held[g] + (held[g - 1] if k % 8 == 7 else []) + text[at:]))
    return out


def test_groups_within_a_group_lose_no_link(spark):
    """Near copies that share a passage which their leader lacks."""
    rng = random.Random(2)
    base = [f"v{j}" for j in range(60)]
    rows = list(enumerate([" ".join(base), *altered(rng, base, 60, 2), *inserted(rng, base, 5, 48, 18)]))
    expected = plain_minhash(rows)
    assert sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect())) == expected
    assert len({r[2] for r in expected}) > 5


@pytest.mark.parametrize("seed", range(3))
def test_stragglers_meet_where_their_sizes_allow(spark, seed):
    """Every similar pair with a straggler meets, and few of the pairs that share a first difference do."""
    rng = random.Random(seed)
    base = [f"v{j}" for j in range(60)]
    texts = [" ".join(base), *altered(rng, base, 90, 9), *inserted(rng, base, 4, 30, 20), *altered(rng, inserted(rng, base, 1, 1, 12)[0].split(), 40, 4)]
    found = {k: minhash.shingles(t.encode()) for k, t in enumerate(texts)}
    frames = [spark.createDataFrame(rows, form).repartition(3) for rows, form in (([(0, k) for k in found if k], "leader long, node long"), (list(enumerate(texts)), "node long, text string"))]
    near = minhash.common.written(minhash.measured(*frames), "measured")
    loose = {r.node for r in near.where("not linked").collect()}
    met = [tuple(r) for r in minhash._stragglers(near).collect()]
    links = {(a, b) for b in found for a in range(1, b) if found[a] != found[b] and (a in loose or b in loose) and minhash.similar(found[a], found[b])}
    assert len(loose) > 60 and len(links) > 100 and links <= set(met)
    assert len(set(met)) < 2 * len(links) and len(met) < 10 * len(links)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_search(docs, items, top=20):
    own = [(k, Counter(TERM.findall((t or "").translate(LOWER)))) for k, t in docs if k is not None]
    own = [(k, c) for k, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, want in asked.items():
        scores = []
        for k, c in own:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in want.items() if t in c)
            if s > 0:
                scores.append((-s, k))
        out += [(i, r, k, -s) for r, (s, k) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def search_rows():
    rng = random.Random(12)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)] + ["été", "Straße", "漢字", "🙂", "Don't", "x_1"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(700)]
    docs += [(1000 + k, docs[5][1]) for k in range(90)] + [(2000, None), (2001, ""), (2002, "!?"), (None, "w1 w2"), (3, "w1"), (3, "w1"), (2003, "w1 " * 30000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(25)]
    return docs, [*items, (50, docs[5][1]), (51, None), (52, "nowhere"), (None, "w1"), (7, "w1 w1"), (53, "W1 w2 É é")]


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "d", 0.1) for i, t in items], "item_id long, text string, rank int, doc_id string, score double")


def test_lexical_search(spark, search_rows):
    docs, items = search_rows
    got = sorted(map(tuple, lexical.search(frame(spark, docs), item_frame(spark, items)).collect()))
    assert got == plain_search(docs, items)
    assert not {51, 52, None} & {r[0] for r in got}


def test_lexical_search_in_groups_of_items(spark, search_rows, monkeypatch):
    docs, items = search_rows
    monkeypatch.setattr(lexical, "ITEM_TERMS", 100)
    assert sorted(map(tuple, lexical.search(frame(spark, docs[:200]), item_frame(spark, items), 3).collect())) == plain_search(docs[:200], items, 3)
    none, no_items = frame(spark, []), item_frame(spark, [])
    assert lexical.search(none, item_frame(spark, items)).count() == 0 and lexical.search(frame(spark, docs[:9]), no_items).count() == 0


def block_of(docs, number):
    counts = [Counter(number[t] for t in TERM.findall(t) if t in number) for _, t in docs]
    lists = pa.list_(pa.int32())
    return pa.table([pa.array([k for k, _ in docs]), pa.array([len(TERM.findall(t)) for _, t in docs]), pa.array([list(c) for c in counts], lists), pa.array([list(c.values()) for c in counts], lists)], names=["doc_id", "n", "terms", "tfs"])


def test_tree_bounds_leave_branches_out(monkeypatch):
    """Bounds hold in every node, and most documents are never scored."""
    rng = random.Random(1)
    topics = [[f"t{k}x{j}" for j in range(60)] for k in range(40)]
    docs = [(k, " ".join(rng.choices(topics[k % 40], k=40))) for k in range(4000)]
    number = {t: n for n, t in enumerate(sorted({t for own in topics for t in own}))}
    rank = np.arange(len(number))
    tree = lexical.tree_of(block_of(docs, number), rank, 4000, 160000)
    ranks, weights = np.arange(0, len(number), 7), np.arange(1, len(number) // 7 + 2)

    def check(node):
        bounds = node.bounds(ranks, weights)
        if node.docs is not None:
            return bounds.max()
        below = [check(b) for b in node.branches]
        assert all(x <= y for x, y in zip(below, bounds, strict=True))
        return max(below)

    check(tree.root)
    want, best = np.array(sorted(number[t] for t in topics[3][:20])), []
    scored = tree.search(want, np.ones(20, np.int64), best, 20)
    assert len(best) == 20 and scored < len(docs) / 4


def test_deep_trees_and_equal_paths():
    """Each document lacks one more of the commonest terms, so every level branches; and many documents have equal terms."""
    words = [f"w{k:04}" for k in range(700)]
    number, rank = {t: k for k, t in enumerate(words)}, np.arange(700)
    docs = [(k, " ".join(words[: 700 - k])) for k in range(690)] + [(1000 + k, "w0001 w0002") for k in range(300)]
    tree, best = lexical.tree_of(block_of(docs, number), rank, 990, 10**6), []
    tree.search(np.array([1, 2, 500]), np.array([5, 5, 1]), best, 20)
    scores = Counter()
    for k, t in docs:
        own, m = t.split(), 75 + 25 * len(t.split()) * 990 // 10**6
        scores[k] = sum(w * (10**9 // (1000 + 12 * m)) for x, w in ((1, 5), (2, 5), (500, 1)) if words[x] in own)
    assert sorted(best, reverse=True) == [(s, -k) for s, k in sorted(((s, k) for k, s in scores.items()), key=lambda x: (-x[0], x[1]))[:20]]


def test_search_of_several_trees_keeps_the_best_of_all():
    """The heap is full after the first tree; what is better in the next must still be found."""
    number, best = {"w": 0}, []
    for first, times in ((0, 1), (100, 9), (200, 4)):
        docs = [(first + k, " ".join(["w"] * times + ["x"] * (10 - times))) for k in range(30)]
        lexical.tree_of(block_of(docs, number), np.arange(1), 90, 900).search(np.array([0]), np.array([5000]), best, 20)
    assert sorted(-k for _, k in best) == list(range(100, 120))


def test_lexical_search_of_tasks_with_several_blocks(spark):
    """One task has more documents than a block holds; the best ones are in the last."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, k=4 + k % 9) + ["w7", "w9"] * (k // 3000))) for k in range(3 * lexical.BLOCK_DOCS)]
    items = [(k, f"w{k} w7 w9") for k in range(5)]
    expected = plain_search(docs, items)
    assert max(r[2] for r in expected) > 2 * lexical.BLOCK_DOCS
    assert sorted(map(tuple, lexical.search(frame(spark, docs, 1), item_frame(spark, items)).collect())) == expected

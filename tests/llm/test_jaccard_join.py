import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from bazaarflow.llm import components, jaccard_join as jj
from bazaarflow.llm.shingles import shingle_set


def plain_set(text, width):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def plain_components(rows, scheme):
    sets = [plain_set(t, scheme.width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and scheme.whole * len(sets[i] & sets[j]) >= scheme.share * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[root(i)] = min(ident, least.get(root(i), ident))
    return Counter((ident, len(sets[i]), least.get(root(i)) if sets[i] else ident) for i, (ident, _) in enumerate(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", "\n", "É", "\t", " ", "c d ", "\x1f"]), max_size=40).map("".join), st.integers(1, 5))
def test_shingles_are_the_plain_ones(text, width):
    assert len(shingle_set(text, width)) == len(plain_set(text, width))
    assert np.array_equal(shingle_set(text, width), shingle_set(text.replace("\n", " ").replace("B", "b"), width))


@pytest.mark.parametrize("scheme", [jj.Scheme(), jj.Scheme(width=3, share=90), jj.Scheme(n2=4, k2=2), jj.Scheme(share=60), jj.Scheme(n2=1, k2=0)])
def test_similar_sets_share_a_signature(scheme):
    rng = np.random.default_rng(5)
    for size in [*range(2, 60), 90, 133, 300, 1000]:
        for _ in range(6):
            pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            a = np.unique(pool[:size])
            # as different as the similarity lets them be
            common = next(c for c in range(size + 1) if scheme.reaches(c, 2 * size))
            swapped = size - common
            b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - swapped], pool[size : size + swapped]]))
            smaller = np.unique(rng.permutation(a)[: -(-size * scheme.share // scheme.whole)])
            for other in (b, smaller):
                if len(other) and not np.array_equal(a, other):
                    shared = set(scheme.signatures(a)) & set(scheme.signatures(other))
                    assert len(shared) >= max(scheme.needed(a), scheme.needed(other)) >= 1, (size, len(other))


def varied(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("scheme", [jj.Scheme(), jj.Scheme(width=3, share=90)])
def test_components_equal_brute_force(spark, scheme):
    rng = random.Random(8)
    rows, n = [], 0
    for group in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 15, 40, 120, 300]))]
        for copy in range(rng.choice([1, 2, 5])):
            rows.append((rng.randrange(10**9), varied(rng, words, rng.randrange(1 + len(words) // 25))))
    hub = [f"h{i}" for i in range(200)]
    rows += [(rng.randrange(10**9), varied(rng, hub, rng.randrange(4))) for _ in range(70)]
    chain = [f"c{i}" for i in range(150)]
    for step in range(30):  # each is like the one before, the ends are not alike
        rows.append((rng.randrange(10**9), " ".join([*chain[step:], *(f"d{i}" for i in range(step))])))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(rng.randrange(10**9), passage + " " + varied(rng, ["x"] * 9, 9)) for _ in range(60)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "two words"), (None, "two words"), (None, None), (6, "two words"), (7, "é " * 30000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, sig int")
    found = Counter((r.id, r.size, r.component_id) for r in jj.linked(docs, scheme).collect())
    assert found == plain_components(rows, scheme)
    assert jj.linked(docs.limit(0), scheme).count() == 0


def test_large_buckets_compare_across_components_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "SMALL", 1)
    monkeypatch.setattr(jj, "BLOCK", 8)
    monkeypatch.setattr(jj, "STRAYS", 4)
    monkeypatch.setattr(jj, "FLUSH", 50)
    rng = random.Random(4)
    scheme = jj.Scheme()
    base = [f"h{i}" for i in range(60)]
    rows = [(i, varied(rng, base, rng.randrange(5))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r.id, r.size, r.component_id) for r in jj.linked(docs, scheme).collect()) == plain_components(rows, scheme)


def test_hash_clashes_are_noticed(spark, monkeypatch):
    honest = jj.node_of
    monkeypatch.setattr(jj, "node_of", lambda elements, seed=0: 7 if seed == 0 else honest(elements, seed))
    rows = [(i, f"a b c d e f {i % 3}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.id, r.size, r.component_id) for r in jj.linked(docs).collect()) == plain_components(rows, jj.Scheme())


def test_component_labels(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = {r.node: r.label for r in components.labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: root(x) for x in list(parent)}


def test_one_row_of_a_component_stays_where_ids_are_null_or_repeat(spark):
    base, other = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    a, near, same, b, c = " ".join(base), " ".join([*base, "x"]), " ".join([*base, "y"]), " ".join(other), " ".join([*other[:30], *base[:30]])
    solo = [f"z{i}" for i in range(60)]
    rows = [(1, a), (7, near), (7, b), (None, same), (None, c), (5, " ".join(solo)), (5, " ".join([*solo, "x"])), (9, None), (9, None), (None, "")]
    lone = [f"n{i}" for i in range(60)]
    rows += [(None, " ".join(lone)), (None, " ".join([*lone, "x"])), (8, "twice the same row here"), (8, "twice the same row here")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, more int")
    kept = jj.representatives(docs).collect()
    found = Counter((r.doc_id, r.text) for r in kept)
    assert found[1, a] == found[7, b] == found[None, c] == found[8, "twice the same row here"] == found[None, ""] == 1 and found[9, None] == 2
    assert not found[7, near] and not found[None, same]
    assert sum(n for (i, _), n in found.items() if i == 5) == 1
    assert sum(n for (i, t), n in found.items() if t and t.startswith("n0")) == 1 and sum(found.values()) == 9
    assert all(rows[r.more] == (r.doc_id, r.text) for r in kept)
    assert jj.representatives(docs.limit(0)).count() == 0


def test_sketches_of_long_sets_differ_at_most_by_the_difference(spark):
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**63, 6000, dtype=np.uint64))
    sets = [pool[:2000], pool[150:2100], pool[:1700], pool[1000:3000], pool[:600], pool[:5000]]
    pairs = [(i, j, *(jj.deep_sketch(x).tolist() for x in (sets[i], sets[j]))) for i in range(6) for j in range(6)]
    frame = spark.createDataFrame(pairs, "i int, j int, a array<long>, b array<long>").select("i", "j", jj._bits_apart(jj.F.col("a"), jj.F.col("b")).alias("bits"))
    bits = {(r.i, r.j): r.bits for r in frame.collect()}
    for (i, j), found in bits.items():
        apart = len(np.setxor1d(sets[i], sets[j]))
        assert found <= apart and found % 2 == apart % 2 and found == bits[j, i]
    assert bits[0, 3] > 1200 and jj.deep_sketch(pool[:256]) is None and jj.deep_sketch(pool[:0]) is None


def test_only_wanted_texts_are_cut_into_words_again(spark, monkeypatch):
    """Bodies come from rows whose id leads to a wanted node; ids that repeat or are null lose none."""
    words = [f"w{i}" for i in range(60)]
    near = lambda n: " ".join([*words[:-1], f"x{n}"])
    rows = [(1, near(1)), (1, "alone one two three"), (None, near(2)), (None, near(3)), (7, near(1)), (8, "other words that meet nothing"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, plain = [], jj.write_and_reload

    def noted(frame, purpose):
        if purpose == "bodies":
            plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return plain(frame, purpose)

    monkeypatch.setattr(jj, "write_and_reload", noted)
    run = jj._Join(docs, jj.Scheme(), "doc_id", "text")
    nodes = run.shape.select("node")
    assert run.bodies(nodes).count() == nodes.count() == 3
    assert plans and all(p.rindex("LeftSemi") > p.index("MapInArrow") for p in plans)
    found = sorted((r.id is None, r.id or 0, r.size, r.component_id) for r in jj.linked(docs).collect())
    assert found == [(False, 1, 1, 1), (False, 1, 56, 1), (False, 7, 56, 1), (False, 8, 1, 8), (False, 9, 0, 9), (True, 0, 56, 1), (True, 0, 56, 1)]


def test_members_reach_their_blocks_once_and_alone(spark, monkeypatch):
    """Sketches are shuffled to the blocks once, without the shuffles of the steps before."""
    monkeypatch.setattr(jj, "SMALL", 1)
    rng = random.Random(5)
    base = [f"h{i}" for i in range(60)]
    rows = [(i, varied(rng, base, rng.randrange(7))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plans, plain = [], jj.write_and_reload

    def noted(frame, purpose):
        if purpose == "across":
            plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return plain(frame, purpose)

    monkeypatch.setattr(jj, "write_and_reload", noted)
    assert Counter((r.id, r.size, r.component_id) for r in jj.linked(docs).collect()) == plain_components(rows, jj.Scheme())
    assert plans and all(p.count("RepartitionByExpression") == p.count("Join") == 1 for p in plans)


def test_blocks_tell_long_sets_apart_before_their_pairs_are_sent(spark, monkeypatch):
    """Long sets that share large buckets but are far apart leave no pair; near ones of another component do."""
    monkeypatch.setattr(jj, "SMALL", 1)
    rng = random.Random(8)
    base = [f"h{i}" for i in range(1500)]
    rows = []
    for i in range(12):
        words = list(base)
        at = rng.randrange(1500)
        for k in range(500):  # a third in one run is exchanged, so sets share most small parts by chance only
            words[(at + k) % 1500] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*base[:1400], *(f"y{i}_{k}" for k in range(100))])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scheme = jj.Scheme()
    run = jj._Join(docs, scheme, "doc_id", "text")
    sets = {n.node: n.first_id for n in run.nodes.collect()}
    spread = spark.createDataFrame([(1, n) for n in sets], "sig long, node long")
    alone = spark.createDataFrame([], "node long, label long")
    run.wide = run.sets.select("node", "size", "wide", "deep")
    found = {tuple(sorted((sets[r.u], sets[r.v]))) for r in run._across(spread, alone).collect()}
    held = {i: jj.shingle_set(t, scheme.width) for i, t in rows}
    linked = {(i, j) for i in held for j in held if i < j and scheme.reaches(len(np.intersect1d(held[i], held[j])), len(held[i]) + len(held[j]))}
    assert linked <= found and len(linked) >= 3
    far = [p for p in found if len(np.intersect1d(held[p[0]], held[p[1]])) < 0.65 * len(np.union1d(held[p[0]], held[p[1]]))]
    assert not far
    assert Counter((r.id, r.size, r.component_id) for r in jj.linked(docs).collect()) == plain_components(rows, scheme)


def test_folds_are_the_sketches_of_their_length():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (5, 700, 300, 5000, 256)]
    lengths = [256, 1024, 512, 8192, 256]
    folds = jj._Folds(np.concatenate([jj.sketch_of(s, n) for s, n in zip(sets, lengths)]), np.array(lengths) // 64)
    assert (folds.narrow() == np.array([jj.sketch_of(s) for s in sets])).all()
    i, j = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(5)))
    wanted = [int(np.bitwise_count((jj.sketch_of(sets[a], n) ^ jj.sketch_of(sets[b], n)).view(np.uint64)).sum()) for a, b in zip(i, j) for n in [min(lengths[a], lengths[b])]]
    assert folds.differing(i, j).tolist() == wanted


def test_similar_sets_share_one_of_their_first_elements():
    rng = np.random.default_rng(6)
    for share in (55, 80, 90):
        scheme = jj.Scheme(share=share)
        met = 0
        for _ in range(400):
            a = rng.choice(400, int(rng.integers(1, 90)), replace=False)
            b = np.union1d(a[int(rng.integers(0, 1 + len(a) // 8)) :], rng.choice(400, int(rng.integers(0, 9))))
            if not len(b) or not scheme.reaches(len(np.intersect1d(a, b)), len(a) + len(b)):
                continue
            met += 1
            order = rng.permutation(400)
            first = [set(s[np.argsort(order[s])][: scheme.rarest(len(s))].tolist()) for s in (a, b)]
            assert first[0] & first[1]
        assert met > 50


def test_families_with_much_text_in_common_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Half of each text is its family's, so all share large buckets; only copies of two of them are near."""
    rng = random.Random(12)
    base = [f"h{i}" for i in range(150)]
    texts = [[*base, *(f"o{i}_{k}" for k in range(150))] for i in range(60)]
    for i in (5, 40):
        for k in range(4):
            at = rng.randrange(len(texts[i]))
            texts.append([*texts[i][:at], f"n{i}_{k}", *texts[i][at:]])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    met, across = [], jj._Join._across

    def noted(self, buckets, known):
        counts = [r["count"] for r in buckets.groupBy("sig").count().collect()]
        met.append(sum(n * n for n in counts))
        return across(self, buckets, known)

    monkeypatch.setattr(jj._Join, "_across", noted)
    # as if the nearest pairs had not been found by other ways
    monkeypatch.setattr(jj._Join, "_within", lambda self: self.shape.select(jj.F.col("node").alias("u"), jj.F.col("node").alias("v")).limit(0))
    assert Counter((r.id, r.size, r.component_id) for r in jj.linked(docs).collect()) == plain_components(rows, jj.Scheme())
    assert met and max(met) < len(rows) ** 2

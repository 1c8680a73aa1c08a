"""Mixing sources, ranked search, Merkle manifest: against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpulse.llm import merkle, mixing, search
from tillpulse.llm.common import stored
from tillpulse.llm.running import running_sums

from .conftest import DOCS, ODD, as_docs

SEARCH_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def test_running_sums_equal_sorted_sums(spark):
    pick = random.Random(1)
    rows = [(pick.choice([None, "a", "b"]), pick.choice([None, 1, 2, 3]), pick.randint(0, 5)) for _ in range(400)] + [("a", 7, 2)] * 900
    df = stored(spark.createDataFrame(rows, "g string, k long, w long").repartition(5), "test")
    found = running_sums(df, ["g"], ["k", "w"], {"n": F.lit(1).cast("long"), "s": F.col("w")}).collect()
    groups = defaultdict(list)
    for g, k, w in rows:
        groups[g].append((k is not None, k or 0, w))
    for g, own in groups.items():
        mine = sorted((r for r in found if r["g"] == g), key=lambda r: r["n_before"])
        assert [(r["k"] is not None, r["k"] or 0, r["w"]) for r in mine] == sorted(own)
        assert [r["n_before"] for r in mine] == list(range(len(own))) and {r["n_total"] for r in mine} == {len(own)}
        assert [r["s_before"] for r in mine] == [sum(x[2] for x in sorted(own)[:i]) for i in range(len(own))]
        assert {r["s_total"] for r in mine} == {sum(x[2] for x in own)}


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    values = (doc_id, source, lang, n_chars, text)
    return plain_hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests):
    """The one digest that is left, and for every leaf its steps (before, after)."""
    levels, steps, place = [digests], [[] for _ in digests], list(range(len(digests)))
    while len(levels[-1]) > 1:
        last = levels[-1]
        for i, at in enumerate(place):
            run = last[at // 8 * 8:at // 8 * 8 + 8]
            steps[i].append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
        place = [at // 8 for at in place]
        levels.append([plain_hash(*last[i:i + 8]) for i in range(0, len(last), 8)])
    return levels[-1][0], steps


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append((row[0] is not None, row[0] or 0, plain_leaf(*row), row))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: plain_tree([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])]) for lang in langs}
    root, above = plain_tree([trees[lang][0] for lang in langs])
    out = []
    for lang, up in zip(langs, above):
        for (_, _, leaf, row), steps in zip(sorted(by_lang[lang], key=lambda x: x[:3]), trees[lang][1]):
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = plain_leaf(*row[:4], text)
            for before, after in steps + up:
                node = plain_hash(before, node, after)
            proof = plain_hash(*(b + a for b, a in steps + up))
            out.append((row[0], leaf, trees[lang][0], root, proof, node, node == root))
    return out


def manifest_rows(docs):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return [tuple(r[c] for c in columns) for r in merkle.manifest(docs).collect()]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, None: 8, "é": 1}, {"en": 4100, "de": 513, None: 512, "": 64}])
def test_manifest_equals_brute_force(spark, sizes):
    pick = random.Random(5)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = pick.choice([None, "", "Some Text", "é TEXT", "plain"])
            rows.append((pick.choice([None, *range(2 * n)]), pick.choice([None, "s:1", ""]), lang, pick.choice([None, 3]), text))
    pick.shuffle(rows)
    docs = spark.createDataFrame([(d, t, lang, s, n, "x") for d, s, lang, n, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rank string")
    assert Counter(manifest_rows(docs.repartition(7))) == Counter(plain_manifest(rows))


def test_manifest_of_many_languages_and_odd_rows(spark, odd, nothing):
    rows = [(i, "s", f"l{i % 700}", 1, "A") for i in range(1400)]
    docs = spark.createDataFrame([(d, t, lang, s, n) for d, s, lang, n, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(manifest_rows(docs)) == Counter(plain_manifest(rows))
    expected = plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd.collect()])
    assert Counter(manifest_rows(odd)) == Counter(expected) and len(expected) == len(ODD)
    assert manifest_rows(nothing) == []


def test_manifest_has_no_join_below_the_ranks(spark, odd):
    nodes = odd.select(F.lit("t").alias("tree"), F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("n"), F.lit("d").alias("digest"), F.lit("p").alias("payload"))
    paths = spark.createDataFrame([], f"tree string, block long, steps array<{merkle._STEP}>, subroot string, root string")
    plan = merkle.with_paths(merkle.rolled_up(nodes), paths)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def plain_terms(text):
    return SEARCH_TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items):
    """docs: (doc_id, text); items: (item_id, text) -> Counter of (item_id, rank, doc_id, score)"""
    used = [(d, Counter(plain_terms(t))) for d, t in docs]
    used = [(d, c) for d, c in used if c]
    n_docs, n_terms = len(used), sum(sum(c.values()) for _, c in used)
    df = Counter(t for _, c in used for t in c)
    out = Counter()
    for item_id, text in items:
        found = []
        for d, c in used:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in plain_terms(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, -1 if d is None else d, d))
        for rank, (score, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:10], 1):
            out[item_id, rank, d, -score] += 1
    return out


def random_texts(pick, n, words):
    return [" ".join(pick.choice(words) for _ in range(pick.choice([0, 1, 3, 12, 60]))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_shards_find_the_best_of_all(monkeypatch, seed):
    """One process: small blocks, several shards, the threshold carried on."""
    monkeypatch.setattr(search, "BLOCK", 4)
    pick = random.Random(seed)
    words = [f"w{int(pick.paretovariate(0.7))}" for _ in range(300)]
    docs = list(enumerate(random_texts(pick, 400, words)))
    items = [(i, t) for i, t in enumerate(random_texts(pick, 30, words[:200] + ["unknown"]))]
    used = [(d, search.terms_of(t)) for d, t in docs if search.terms_of(t)]
    documents, terms = len(used), sum(len(t) for _, t in used)
    df = Counter(t for _, own in used for t in set(own))
    size = pick.choice([17, 100, 1000])
    rows = [search.index_row([d for d, _ in part], [len(t) for _, t in part], [w for _, t in part for w in t])
            for part in (used[i:i + size] for i in range(0, len(used), size))]
    found, unpacked, blocks = Counter(), 0, 0
    bests = {i: search.Best() for i, _ in items}

    class Ids(list):
        def as_py(self):
            return self

    for row in rows:
        shard = search.Shard({**row, "doc_ids": Ids(row["doc_ids"])}, documents, terms)
        places = {w: i for i, w in enumerate(row["words"])}
        for i, text in items:
            weights = {w: n * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1))) for w, n in Counter(search.terms_of(text)).items() if df[w]}
            shard.search([(places[w], n) for w, n in weights.items() if w in places and n], bests[i])
        assert not shard.sums.any()
    for i, best in bests.items():
        for rank, (d, s) in enumerate(zip(best.ids.tolist(), best.scores.tolist()), 1):
            found[i, rank, d, s] += 1
    assert found == plain_search(docs, items)


def test_blocks_are_rejected_before_they_are_unpacked():
    """A common term cannot bring a document up once a rare one has filled the ten."""
    words = [b"common"] * 5000
    row = search.index_row(list(range(5000)), [1] * 4980 + [2] * 20, words[:4980] + [b"common", b"rare"] * 20)

    class Ids(list):
        def as_py(self):
            return self

    shard, best = search.Shard({**row, "doc_ids": Ids(row["doc_ids"])}, 5000, 5020), search.Best()
    places = {w: i for i, w in enumerate(row["words"])}
    shard.search([(places[b"common"], 1), (places[b"rare"], 9000)], best)
    assert sorted(best.ids) == list(range(4980, 4990)) and shard.unpacked <= 3 < len(shard.first)


def test_wide_values_are_packed():
    counts = [70_000, 1, 300]
    words = [b"a"] * 70_000 + [b"a"] + [b"b"] * 300
    row = search.index_row([5, 6, 7], counts, words)

    class Ids(list):
        def as_py(self):
            return self

    shard = search.Shard({**row, "doc_ids": Ids(row["doc_ids"])}, 3, sum(counts))
    docs, impacts = shard.block(0)
    assert shard.ids[docs].tolist() == [6, 5]
    assert impacts.tolist() == [1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * 3 // sum(counts))) for tf, n in ((1, 1), (70_000, 70_000))]


def test_ranked_search(spark, odd, nothing):
    pick = random.Random(9)
    words = [f"W{int(pick.paretovariate(0.8))}" for _ in range(200)] + ["É", "日本", "a_b"]
    docs = [(pick.choice([None, *range(500)]), t) for t in random_texts(pick, 600, words)] + ODD + [(4, "same words")] * 30
    items = [(i, t) for i, t in enumerate(random_texts(pick, 25, words))] + [(3, "same words"), (3, "SAME, words!"), (None, "word end"), (8, None), (9, "")]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    found = Counter(map(tuple, search.ranked(as_docs(spark, docs).repartition(6), queries).collect()))
    assert found == plain_search(docs, items)
    assert search.ranked(nothing, queries).count() == 0
    assert search.ranked(odd, queries.limit(0)).count() == 0


def plain_targets(sizes):
    """source -> target, shared out as the rule is worded."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    whole, targets, following = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        rest = whole - sum(targets.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in following) for s in following}
        above = {s for s in following if share[s] > 2 * sizes[s]}
        if not above:
            return {**targets, **share}
        targets.update({s: 2.0 * sizes[s] for s in above})
        following -= above


def check_mix(rows, texts):
    """rows of the operator; texts: (doc_id, source, text)"""
    words = lambda t: len([w for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w])
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, words(t)) for d, _, t in texts)
    sizes = Counter()
    for _, source, text in texts:
        sizes[source] += words(text)
    targets = plain_targets(dict(sizes))
    expected = Counter((d, words(t), sizes[s], round(targets[s], 6)) for d, s, t in texts)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in rows) == expected
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    wanted, sources = Counter(), Counter()
    for source, size in sizes.items():
        wanted[round(targets[source], 6), size] += targets[source]
        sources[round(targets[source], 6), size] += 1
    for key, n in sources.items():
        assert abs(taken[key] - wanted[key]) <= n * mixing.BLOCK_WORDS


@pytest.mark.parametrize("seed", range(2))
def test_mix_meets_its_targets(spark, seed):
    pick = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", ""]
    texts = [(pick.choice([None, *range(300)]), pick.choice(sources + ["b"] * 4), " ".join(["w"] * pick.choice([0, 1, 5, 40, 900]))) for _ in range(700)]
    texts += [(1, "copies", "one two three")] * 400 + [(2, "empty", None), (3, "empty", " \n")]
    docs = spark.createDataFrame([(d, s, t, 1, "x") for d, s, t in texts], "doc_id long, source string, text string, size int, taken string")
    rows = mixing.mixed(docs.repartition(5)).collect()
    check_mix(rows, texts)
    again = mixing.mixed(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_mix_of_odd_documents(spark, odd, nothing):
    check_mix(mixing.mixed(odd).collect(), [(d, "s", t) for d, t in ODD])
    assert mixing.mixed(nothing).count() == 0
    assert mixing.mixed(as_docs(spark, [(1, None), (2, "")])).collect() == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_slots_of_the_mix(spark):
    docs = [(i, "word " * (i % 50), None, f"s{i % 4}") for i in range(800)]
    places, sources = mixing.placed_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    draws = mixing.drawn_blocks(sources)
    rows = draws.collect()
    positions = sorted(r["shard"] * mixing.SHARD_SLOTS + r["slot"] for r in rows)
    assert positions == list(range(len(rows)))
    wanted = {r["source_no"]: (r["draws"], r["blocks"]) for r in sources.collect()}
    times = Counter((r["source_no"], r["block"]) for r in rows)
    for source, (n, blocks) in wanted.items():
        own = [times[source, b] for b in range(blocks)]
        assert sum(own) == n and max(own) - min(own) <= 1
    assert sum(r["slots"] for r in mixing.shard_counts(draws).collect()) == len(rows)
    # Neither the sources nor the blocks of a source come in order.
    by_slot = sorted(rows, key=lambda r: r["slot"])
    numbers = [r["block"] for r in by_slot if r["source_no"] == 0]
    assert abs(np.corrcoef(numbers, range(len(numbers)))[0, 1]) < 0.3
    spans = mixing.mixed_spans(places, draws).collect()
    assert all(0 < r["words"] <= mixing.BLOCK_WORDS and 0 <= r["first_word"] for r in spans)


def test_permutations_of_many_sizes(spark):
    sizes = [1, 2, 3, 5, 63, 64, 65, 1000]
    rows = spark.createDataFrame([(n, t, i) for n in sizes for t in (0, 1) for i in range(n)], "n long, turn long, i long")
    found = defaultdict(dict)
    for r in mixing.permuted(rows, "i", "p", "n", ["turn"], rows.select("n", "turn").distinct()).collect():
        found[r["n"], r["turn"]][r["i"]] = r["p"]
    assert all(sorted(p.values()) == list(range(n)) for (n, _), p in found.items())
    assert found[1000, 0] != found[1000, 1]


def test_mixing_plan_has_no_python(spark, odd):
    plan = mixing.mixed(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shared_columns_do_not_clash(spark):
    """``odd`` has columns that the operators use themselves; so do these."""
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, 1, "y")], DOCS.split(", fingerprint")[0] + ", row long, digest string")
    assert mixing.mixed(docs).count() == merkle.manifest(docs).count() == 1

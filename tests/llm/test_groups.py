"""Near-duplicates, repeated units, benchmark items: results that depend on other documents."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tillpulse.llm import decontaminate, lines, resemblance, simhash
from tillpulse.llm.common import map_among, row_identity, rows_without, stored
from tillpulse.llm.components import components

from .conftest import ODD, SENTENCE, as_docs


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_brute_force(monkeypatch):
    pick = random.Random(1)
    monkeypatch.setattr(simhash, "_BLOCK", 7)  # several blocks also for short texts
    for _ in range(300):
        text = "".join(pick.choice(["Aa", "É", " ", "b c", "\x0b", "\x1c", " d"]) for _ in range(pick.randint(0, 60)))
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_hash_is_the_one_of_the_engine(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components_equal_union_find(spark, shape):
    pick = random.Random(2)
    links = {
        "random": [(pick.randrange(300), pick.randrange(300)) for _ in range(220)],
        "path": [(i, i + 1) for i in range(60)],
        "star": [(500, i) for i in range(200)] + [(3, 3)],
        "none": [],
    }[shape]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    real = [(a, b) for a, b in links if a != b]
    expected = roots_of({n for link in real for n in link}, real)
    assert {n: found.get(n, n) for n in expected} == expected


def test_near_pairs_equal_all_pairs(spark):
    pick = random.Random(3)
    values = set()
    for _ in range(40):
        base = pick.getrandbits(64)
        values.add(base)
        for _ in range(8):
            flipped = base
            for b in pick.sample(range(64), pick.randint(1, 4)):
                flipped ^= 1 << b
            values.add(flipped)
    # Many that share one segment.
    values |= {(7 << 32) | pick.getrandbits(6) << pick.randrange(26) for _ in range(200)}
    signed = sorted(v - (v >> 63 << 64) for v in values)
    pairs = {(r["a"], r["b"]) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()}
    assert pairs == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) % 2**64).bit_count() <= 2}


def test_classes_equal_brute_force(spark):
    pick = random.Random(4)
    base = [" ".join(pick.choice(["red", "green", "blue", "one", "two"]) for _ in range(40)) for _ in range(6)]
    docs = []
    for i in range(120):
        words = pick.choice(base).split()
        if pick.random() < 0.7:
            words[pick.randrange(40)] = pick.choice(["red", "mauve"])
        docs.append((pick.randrange(1000), " ".join(words)))
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(as_docs(spark, docs)).collect()}
    prints = {(d, brute_fingerprint(t)) for d, t in docs}
    nodes = {p for _, p in prints}
    roots = roots_of(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 2])
    lowest = defaultdict(lambda: 10**9)
    for d, p in prints:
        lowest[roots[p]] = min(lowest[roots[p]], d)
    assert {(d, p % 2**64): c for (d, p), c in found.items()} == {(d, p): lowest[roots[p]] for d, p in prints}


def test_odd_documents_in_classes(odd, nothing):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    of = defaultdict(set)
    for r in found:
        of[r["fingerprint"]].add(r["component_id"])
    assert of[0] == {1} and all(len(c) == 1 for c in of.values())
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.schema == odd.schema and Counter(ids) == Counter([None, None, 4, 6, 7, 8, 9])
    assert simhash.one_of_each(nothing).count() == 0


def test_one_of_equal_rows_stays(spark):
    kept = simhash.one_of_each(as_docs(spark, [(5, SENTENCE), (5, SENTENCE), (3, "a b c d"), (3, "e f g h")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 3, 5]


def test_near_dedup_stage_equals_all_pairs(spark):
    """Five-word shingles with a similarity of 0.8 or more, linked through others too."""
    pick = random.Random(10)
    docs = [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two")]
    for c in range(25):
        words = words_of(pick, pick.choice([12, 60, 200, 900]))
        for _ in range(8):
            words = list(words)  # each an edit of the one before, so that the first and the last differ much
            for _ in range(pick.randint(0, max(1, len(words) // 50))):
                words[pick.randrange(len(words))] = "changed" + str(pick.random())
            docs.append((len(docs), " ".join(words)))
    pick.shuffle(docs)

    def parts(text):
        words = (text or "").lower().split()
        return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {d: parts(t) for d, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    expected = set(roots_of(sets, links).values())
    kept = corpus_pipeline.near_dedup(spark, as_docs(spark, docs), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected) and 10 < len(expected) < len(docs) / 2


def brute_units(docs, least):
    """doc_id -> removed (start, end), for different doc_ids."""
    units = {d: lines.text_units(t or "") for d, t in docs}
    first = {}
    for d in sorted(units):
        for i, u in enumerate(units[d]):
            first.setdefault(u[:2], (d, i))
    out = {}
    for d, own in units.items():
        later = {i for i, u in enumerate(own) if first[u[:2]] != (d, i)}
        gone = {i for i in later if own[i][4] >= least}
        for i in later:
            for j in range(i, len(own)):
                if j not in later:
                    break
                if sum(own[k][4] for k in range(i, j + 1)) >= 2 * least:
                    gone |= set(range(i, j + 1))
        while more := {i for i in later - gone if i - 1 in gone or i + 1 in gone}:
            gone |= more
        out[d] = [own[i][2:4] for i in sorted(gone)]
    return out


def test_repeated_units_equal_brute_force(spark):
    pick = random.Random(5)
    sentences = [" ".join(pick.choice("abcdefgh") * pick.randint(1, 4) for _ in range(pick.randint(1, 14))) + "." for _ in range(60)]
    docs = [(i, pick.choice([" ", "\n"]).join(pick.choice(sentences) for _ in range(pick.randint(0, 12)))) for i in range(80)]
    found = {r["doc_id"]: list(zip(r["starts"], r["ends"])) for r in lines.repeated_units(as_docs(spark, docs)).collect()}
    assert found == brute_units(docs, lines.LEAST_WORDS) and any(found.values())


def test_passage_inside_a_line_is_cut(spark):
    passage = "Here is a passage of quite a few words. Short. And it goes on for one more long sentence, as planned."
    docs = as_docs(spark, [(1, f"Top line.\n{passage}\nLast."), (2, f"Other words before it. {passage.upper()} Other words after it.")])
    row = lines.repeated_units(docs).where("doc_id = 2").first()
    assert (row["first_docs"], row["n_units"]) == ([1] * 3, 5)
    texts = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs).collect()}
    assert texts[2] == "Other words before it. Other words after it." and passage in texts[1]


def test_repeated_units_of_odd_documents(odd, nothing):
    found = lines.repeated_units(odd).collect()
    assert len(found) == len(ODD)
    removed = {(r["doc_id"], r["row_digest"]): len(r["starts"]) for r in found}
    assert sum(removed.values()) == 2  # of documents 4 and 5; that without an id comes first
    clean = lines.without_repeats(odd)
    assert clean.schema == odd.schema and clean.count() == len(ODD) and clean.where("text is null").count() == 2
    assert lines.repeated_units(nothing).count() == 0 and lines.without_repeats(nothing).count() == 0


def words_of(pick, n):
    return [pick.choice("abcdefghij") * pick.randint(1, 3) for _ in range(n)]


def contained(docs, items, threshold=0.8):
    def words(text):
        return tuple(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", text or "").lower().split(" "))

    def parts(own, n):
        return frozenset(own[i:i + n] for i in range(len(own) - n + 1))

    named, out = {}, {}
    for i, t in items:
        own = tuple(filter(None, words(t)))
        if own:
            named[own] = min(i, named.get(own, (i,))[0]), min(5, len(own))
    for d, t in docs:
        own = tuple(filter(None, words(t)))
        held = {n: parts(own, n) for n in range(1, 6)}
        out[d] = sorted(i for item, (i, n) in named.items() if len(parts(item, n) & held[n]) / len(parts(item, n)) >= threshold)
    return out


def test_contained_items_equal_brute_force(spark):
    pick = random.Random(6)
    items = [(i, " ".join(words_of(pick, pick.choice([3, 5, 12, 30, 60, 150])))) for i in range(30)]
    items += [(99, items[2][1].upper()), (98, None), (97, "!!"), (96, "")]
    docs = []
    for d in range(150):
        words = words_of(pick, pick.choice([0, 3, 40, 400, 3000]))
        if pick.random() < 0.6:
            passage = pick.choice(items[:30])[1].split()
            for _ in range(pick.choice([0, 0, 1, 3])):
                passage[pick.randrange(len(passage))] = "changed"
            at = pick.randrange(len(words) + 1)
            words[at:at] = [w + pick.choice(["", ",", "%%%"]) for w in passage]
        docs.append((d, " ".join(words)))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r["items"] for r in decontaminate.decontamination_report(as_docs(spark, docs), table).collect()}
    expected = contained(docs, items)
    assert found == expected and sum(map(bool, expected.values())) > 40
    clean = decontaminate.clean_documents(as_docs(spark, docs), table)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, i in expected.items() if not i)


def test_decontamination_of_odd_documents(spark, odd, nothing):
    items = spark.createDataFrame([(1, SENTENCE), (2, None)], "item_id long, text string")
    report = decontaminate.decontamination_report(odd, items).collect()
    assert len(report) == len(ODD)
    assert Counter(r["doc_id"] for r in report if r["contaminated"]) == Counter([4, 5, 5, None])
    clean = decontaminate.clean_documents(odd, items)
    assert clean.schema == odd.schema and clean.count() == len(ODD) - 4
    assert decontaminate.decontamination_report(nothing, items).count() == 0
    assert decontaminate.clean_documents(odd, items.limit(0)).count() == len(ODD)


def test_short_and_scattered_items_are_found(spark):
    pick = random.Random(8)
    items = [(i, " ".join(words_of(pick, pick.choice([5, 5, 6, 7, 25])))) for i in range(100)]
    docs = []
    for d, (_, text) in enumerate(items):
        words = words_of(pick, 300)
        # An item of 25 words lies in two pieces, far apart.
        for at, part in ((250, text.split()[:14]), (20, text.split()[10:])):
            words[at:at] = part if d % 2 or len(text.split()) == 25 else text.split()
        docs.append((d, " ".join(words)))
    docs.append((None, items[0][1]))
    expected = contained(docs, items)
    found = {r["doc_id"]: r["items"] for r in decontaminate.decontamination_report(as_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == expected and sum(map(bool, expected.values())) > 80


def test_items_without_an_id_of_their_own(spark):
    pick = random.Random(9)
    texts = [" ".join(words_of(pick, 12)) for _ in range(3)]
    items = spark.createDataFrame([(None, texts[0]), (7, texts[1]), (7, texts[2])], "item_id long, text string")
    docs = as_docs(spark, [(0, texts[0] + " end"), (1, texts[1]), (2, texts[2]), (3, texts[1][:20])])
    report = {r["doc_id"]: (r["contaminated"], r["n_items"], r["items"], r["containment"]) for r in decontaminate.decontamination_report(docs, items).collect()}
    assert report == {0: (True, 1, [], 1.0), 1: (True, 1, [7], 1.0), 2: (True, 1, [7], 1.0), 3: (False, 0, [], None)}
    assert [r["doc_id"] for r in decontaminate.clean_documents(docs, items).collect()] == [3]


def test_items_of_one_to_eight_words(spark):
    """Whole, in documents of any length; and one shingle that all items and most documents have."""
    pick = random.Random(11)
    items = [(i, " ".join(f"w{pick.randrange(10**6)}" for _ in range(1 + i % 8))) for i in range(80)]
    items += [(100 + i, "this line is in all of them " + " ".join(f"v{pick.randrange(10**6)}" for _ in range(12))) for i in range(20)]
    docs = [(1000, "quick brown fox"), (1001, "the Quick, brown fox jumps"), (1002, "quick fox brown")]
    items.append((200, "quick brown fox"))
    for d, (_, text) in enumerate(items):
        words = words_of(pick, pick.choice([0, 2, 300])) + ["this line is in all of them"] * (d % 3)
        words.insert(pick.randrange(len(words) + 1), text if d % 5 else " ".join(text.split()[::-1]))
        docs.append((d, " ".join(words)))
    expected = contained(docs, items)
    assert expected[1000] == expected[1001] == [200] and expected[1002] == [] and sum(map(bool, expected.values())) > 70
    report = decontaminate.decontamination_report(as_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in report.collect()} == expected


def test_pages_of_one_template_are_not_paired(spark):
    """Pages that share half of their words: the pairs looked at grow with the pages, not with their square."""
    template = [f"t{i}" for i in range(60)]
    looked_at = []
    for n in (100, 200):
        pick = random.Random(12)
        docs = as_docs(spark, [(i, " ".join(template + [f"own{pick.random()}" for _ in range(40)])) for i in range(n)])
        texts = docs.select(*row_identity(docs), "text")
        found = stored(resemblance.signatures(texts), "test")
        counts = resemblance.count_sketch(found.where("chunk is not null").select("chunk", "counts"))
        assert counts.sum() == n * 96
        keyed = stored(resemblance.prefixes(texts, counts), "test")
        every = stored(keyed.select("node", "size", F.posexplode("keys").alias("at", "key")), "test")
        members = resemblance.key_members(keyed)
        shared = [r["key"] for r in every.groupBy("key").count().where("count > 1").collect()]
        assert Counter(map(tuple, members.collect())) == Counter(map(tuple, every.where(F.col("key").isin(shared)).collect()))
        none = spark.createDataFrame([], "node long, root long")
        looked_at.append(resemblance.star_pairs(members).count() + resemblance.other_pairs(members, none).count())
    assert looked_at == [0, 0]


def test_rows_without_keep_all_others(spark, odd):
    rows = odd.select(*row_identity(odd)).where("row_id in (3, 5, 8)").distinct()
    left = rows_without(odd, stored(rows, "test"))
    assert left.schema == odd.schema
    assert Counter(map(tuple, left.collect())) == Counter(tuple(r) for r in odd.collect() if r["doc_id"] not in (3, 5, 8))
    among = map_among(odd, stored(rows, "test"), lambda batches: batches, odd.schema)
    assert Counter(r["doc_id"] for r in among.collect()) >= Counter([3, 5, 5, 8])
    assert rows_without(odd, stored(rows.limit(0), "test")).count() == odd.count()


def test_copies_of_a_row_left_out_stay_in_place(spark):
    docs = spark.createDataFrame([(i, "one text for all") for i in range(500)], "doc_id long, text string")
    rows = stored(docs.select(*row_identity(docs)).where("row_id < 2"), "test")
    assert map_among(docs, rows, lambda batches: batches, docs.schema).count() < 10
    assert {r.doc_id for r in rows_without(docs, rows).collect()} == set(range(2, 500))


def test_prefixes_rule_out_no_similar_pair(spark):
    """Edited copies at all distances: what the prefixes leave holds every similar pair, and not all others."""
    pick = random.Random(13)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for n in range(40):
        words = list(base)
        for _ in range(n % 8):
            words[pick.randrange(len(words))] = f"own{pick.random()}"
        texts.append(" ".join(words[:pick.choice([120, 110, 100])]))
    docs = as_docs(spark, list(enumerate(texts)))
    counts = np.zeros(resemblance.SLOTS, np.int32)
    keyed = stored(resemblance.prefixes(docs.select("text"), counts).dropDuplicates(["node"]), "test")
    sets = {}
    for t in texts:
        own = resemblance.shingle_hashes(t)
        sets[int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))] = set(own.tolist())
    every = [(a, b) for a in sets for b in sets if a < b]
    similar = {(a, b) for a, b in every if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    left = {tuple(r) for r in resemblance.alike_prefixes(spark.createDataFrame(every, "a long, b long"), keyed).collect()}
    assert similar <= left and 10 < len(similar) < len(left) < len(every)

"""Packing, sharding, web archives, language-model scores, and the pipeline: whole-corpus results."""

import gzip
import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillpulse.llm import decontaminate, hmm, packing, quality, secret_scan, sharding, warc
from tillpulse.llm.common import stored
from tillpulse.llm.tokens import encoder

from .conftest import ODD, as_docs

TABLES = "/root/testdata/sf0.001"


def placed(histogram, size):
    places = packing.Places(packing.even_out(packing.shortest_pack_first(histogram, size), size))
    sequences = defaultdict(list)
    for rest, docs in histogram.items():
        for rank in range(docs):
            at = 0
            for start, length, sequence, offset in places.of(rest, rank):
                assert start == at and length > 0
                at += length
                sequences[sequence].append((offset, length))
            assert at == rest
    assert set(sequences) == set(range(places.sequences))
    return [sorted(s) for s in sequences.values()]


@pytest.mark.parametrize("seed", range(12))
def test_places_hold_every_token_once(seed):
    pick = random.Random(seed)
    size = pick.choice([64, 2048])
    histogram = Counter(min(size - 1, max(1, int(pick.lognormvariate(math.log(size) - 1, 1)))) for _ in range(pick.choice([0, 1, 2, 30, 3000])))
    padding = 0
    for pieces in placed(histogram, size):
        at = 0
        for offset, length in pieces:
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    total = sum(k * v for k, v in histogram.items())
    assert padding <= 0.01 * total * (2048 / size) + packing.LEAST_FILL


@pytest.mark.parametrize("histogram", [{1500: 1000}, {1025: 7, 1030: 3}, {2047: 5}, {1: 5000}, {1024: 4}])
def test_places_of_one_length(histogram):
    pieces = placed(histogram, 2048)
    assert len(pieces) <= -(-sum(k * v for k, v in histogram.items()) // (2048 - packing.LEAST_FILL)) + 11


def check_pieces(docs, pieces, size):
    """Every id of every document in exactly one piece; sequences without gaps; gives the padding."""
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
    expected = defaultdict(list)
    for doc_id, text in docs:
        expected[doc_id].append(np.frombuffer(encoder().whole(text or ""), "<u2").tolist() + [packing.END_ID])
    assert set(by_doc) == set(expected)
    for doc_id, copies in expected.items():
        whole = sorted(itertools.chain(*([(i, t, len(c)) for i, t in enumerate(c)] for c in copies)))
        assert sorted((start + i, t, n) for start, ids, n in by_doc[doc_id] for i, t in enumerate(ids)) == whole
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packed_documents(spark, odd, nothing):
    docs = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()] + ODD[:-2]
    pieces = packing.pack_documents(as_docs(spark, docs)).collect()
    assert check_pieces(docs, pieces, 2048) < 0.01 * sum(p["length"] for p in pieces)
    assert packing.pack_documents(nothing).count() == 0
    few = packing.pack_documents(as_docs(spark, ODD[:3])).collect()
    assert check_pieces(ODD[:3], few, 2048) == 0


def test_feistel_is_a_permutation_and_walks_end(spark):
    for n in (1, 2, 3, 7, 50, 1000):
        for seed in (1, 2):
            rows = sharding.permute(spark.range(n), "id", "position", n, seed)
            assert sorted(r["position"] for r in rows.collect()) == list(range(n))
    rows = [r["position"] for r in sharding.permute(spark.range(1000), "id", "position", 1000, 3).orderBy("id").collect()]
    assert abs(np.corrcoef(rows, range(1000))[0, 1]) < 0.2


def test_shards_are_even_and_reproducible(spark, odd, nothing):
    docs = [(i, f"text {i}") for i in range(307)] + [(5, "same")] * 400 + ODD
    found = sharding.feistel_shards(as_docs(spark, docs), 40).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in docs)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["position"] == r["slot"] * 40 + r["shard"] and r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.feistel_shards(as_docs(spark, docs[::-1]).repartition(5), 40).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert sharding.feistel_shards(nothing).count() == 0


def test_sharding_plan_has_no_python(spark, odd):
    plan = sharding.feistel_shards(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_copies_are_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 64)
    docs = as_docs(spark, [(None, None)] * 1000 + [(i, "x") for i in range(64)] + [(70, "y")] * 65)
    keys = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    numbered, n = sharding.row_numbers(keys, ["doc_id", "text"])
    rows = numbered.withColumn("part", F.spark_partition_id()).collect()
    assert n == 1129 and sorted(r["row_number"] for r in rows) == list(range(n))
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(map(tuple, keys.collect()))
    sequences = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "+ 64" in sequences and "RepartitionByExpression" in sequences


PAGES = [
    (1, "http://a", "x" * 1500), (9, "http://b", "x" * 1500), (4, None, "x" * 1500), (None, "http://c", "x" * 1500),
    (5, "http://d\r\nX: y", "short"), (6, "http://e", "short"), (7, "http://f", None), (8, "", ""), (2, "http://é", "é日" * 40_000),
    (9, "http://b", "x" * 1500), (3, "u", "a\r\n\r\nb\0"),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra", 1) for p in PAGES], "page_id long, url string, html string, digest string, payload int").repartition(3)
    listed = warc.write_archives(pages)
    found = warc.read_archives(listed).collect()
    assert sum(r["records"] for r in listed.collect()) == len(found) == len(PAGES)
    texts = Counter((i, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in PAGES)
    assert Counter((r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in found) == texts
    revisits = {(r["page_id"], r["refers_to"]) for r in found if r["record_type"] == "revisit"}
    assert revisits == {(1, 9), (4, 9), (None, 9)}
    payloads = {r["page_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response"}
    assert payloads == {i: (h or "").encode() for i, _, h in PAGES if i in (9, 5, 6, 7, 8, 2, 3)}
    urls = {r["page_id"]: r["url"] for r in found}
    assert urls[4] is None and urls[5] == "http://d%0D%0AX: y" and urls[8] == "" and urls[2] == "http://é"
    empty = warc.write_archives(pages.limit(0))
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0


def archive():
    records = [
        warc.page_record(i, "u", payload, hashlib.sha1(payload).hexdigest(), None, False) for i, payload in enumerate([b"", b"abc" * 999, b"\r\n\r\n"])
    ]
    return b"".join(records), records


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_members_are_read_in_blocks(block):
    data, records = archive()
    assert list(warc.members(io.BytesIO(data), block)) == [gzip.decompress(r) for r in records]
    assert [int(r.headers["warc-record-id"][10:-1]) for r in warc.read_records(io.BytesIO(data))] == [0, 1, 2]


def test_broken_archives_are_refused():
    data, records = archive()
    changed = gzip.decompress(records[1]).replace(b"abcabc", b"abcabd", 1)
    short = gzip.decompress(records[1])[:-9] + b"\r\n\r\n"
    for broken in (data[:-5], gzip.compress(changed), gzip.compress(short), gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n")):
        with pytest.raises(warc.BrokenArchive):
            list(warc.read_records(io.BytesIO(broken)))


def brute_likelihood(model, classes):
    """Sum over all state paths."""
    k, total = len(model.start), 0.0
    for path in itertools.product(range(k), repeat=len(classes)):
        p = model.start[path[0]] * model.emit[classes[0], path[0]]
        for t in range(1, len(classes)):
            p *= model.move[path[t - 1], path[t]] * model.emit[classes[t], path[t]]
        total += p
    return math.log10(total)


def small_model(k=3, seed=1):
    pick = np.random.default_rng(seed)
    rows = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(pick.random(shape))
    return hmm.Model(rows(k), rows(k, k), rows(k, hmm.CLASSES).T)


def test_forward_recursion_equals_all_paths():
    model, pick = small_model(), np.random.default_rng(2)
    lengths = np.array([1, 5, 3, 6, 1])
    classes = pick.integers(0, hmm.CLASSES, lengths.sum())
    parts = np.split(classes, np.cumsum(lengths)[:-1])
    assert np.allclose(hmm.log_likelihoods(model, classes, lengths), [brute_likelihood(model, p) for p in parts])


@pytest.mark.parametrize("stretch", [1, 2, 3, 1024])
def test_expected_counts_equal_posteriors(monkeypatch, stretch):
    """Whatever the stretches: documents of one to six tokens, over up to five borders."""
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    model, lengths = small_model(2), np.array([4, 1, 6, 2, 5])
    classes = np.array([1, 2, 1, 3, 2, 3, 1, 2, 2, 1, 3, 1, 1, 3, 2, 1, 3, 3])
    start, move, emit, logs = hmm.expected_counts(model, classes, lengths)
    expected = [np.zeros(2), np.zeros((2, 2)), np.zeros((hmm.CLASSES, 2))]
    for part in np.split(classes, np.cumsum(lengths)[:-1]):
        paths = {}
        for path in itertools.product(range(2), repeat=len(part)):
            p = model.start[path[0]] * model.emit[part[0], path[0]]
            for t in range(1, len(part)):
                p *= model.move[path[t - 1], path[t]] * model.emit[part[t], path[t]]
            paths[path] = p
        for path, p in paths.items():
            p /= sum(paths.values())
            expected[0][path[0]] += p
            for t, s in enumerate(path):
                expected[2][part[t], s] += p
                if t:
                    expected[1][path[t - 1], s] += p
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip((start, move, emit), expected))
    assert abs(logs - hmm.log_likelihoods(model, classes, lengths).sum()) < 1e-4


def test_numbers_survive_packing():
    for numbers in ([], [0], [1, 70_000, 2**31 - 1]):
        assert hmm.unpack_numbers(hmm.pack_numbers(np.array(numbers, np.int32))).tolist() == numbers
    owner, number, sizes = hmm._pieces(np.array([1, hmm.STRETCH, hmm.STRETCH + 1]))
    assert (owner.tolist(), number.tolist(), sizes.tolist()) == ([0, 1, 2, 2], [0, 0, 0, 1], [1, hmm.STRETCH, hmm.STRETCH, 1])


def language(pick, words, n):
    return " ".join(pick.choice(words) + pick.choice(["", "", "."]) for _ in range(n))


def test_scores(spark):
    pick = random.Random(3)
    kinds = [[c * n + e for c in letters for n in (1, 2, 3) for e in ("", "x", "yy")] for letters in ("abcd", "efgh")]
    docs = [(i, language(pick, kinds[i % 2], pick.randint(0, 60)).title()) for i in range(400)] + [(None, None), (3000, "\x1c É\x0b a")]
    found = hmm.hidden_markov_scores(as_docs(spark, docs), states=2, iterations=5).collect()
    lower = {d: [w for w in "".join(c.lower() if c < "\x7f" else c for c in t or "").replace("\x0b", " ").split(" ") if w] + [None] for d, t in docs}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    counts = Counter(itertools.chain(*(w for d, w in lower.items() if not held[d])))
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(docs)
    for r in found:
        words = lower[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), sum(counts[w] > 0 for w in words), n)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) < 1e-9 * len(words)
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.1 * sum(r["n_tokens"] for r in out)


def test_long_documents_count_like_short_stretches(monkeypatch):
    """A document over many borders, against one stretch for the whole of it."""
    model, pick = small_model(4, 5), np.random.default_rng(6)
    lengths = np.array([3000, 10, 1025, 1024])
    classes = pick.integers(0, hmm.CLASSES, lengths.sum())
    cut = hmm.expected_counts(model, classes, lengths)
    monkeypatch.setattr(hmm, "STRETCH", 10**6)
    whole = hmm.expected_counts(model, classes, lengths)
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-3) for a, b in zip(cut, whole))
    assert abs(cut[1].sum() - (lengths - 1).sum()) < 1e-2 and abs(cut[0].sum() - 4) < 1e-3


def test_training_raises_the_likelihood(spark):
    pick = random.Random(4)
    kinds = [[c * n for c in letters for n in (1, 2, 3, 4)] for letters in ("abcd", "efgh")]
    blocks = stored(hmm.encoded_blocks(as_docs(spark, [(i, language(pick, kinds[i % 2], 30)) for i in range(200)]), block_tokens=500), "test")
    assert blocks.count() > 5
    class_counts = np.zeros(hmm.CLASSES)
    for row in blocks.collect():
        np.add.at(class_counts, row["classes"], row["counts"])
    model, logs = hmm.Model.initial(class_counts, 2), []
    for _ in range(4):
        model, before = hmm.baum_welch_step(blocks, model)
        logs.append(before)
    assert logs == sorted(logs) and logs[-1] > logs[0]
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_scores_of_odd_documents(spark, odd, nothing):
    found = hmm.hidden_markov_scores(odd).collect()
    assert len(found) == len(ODD) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert hmm.hidden_markov_scores(nothing).count() == 0
    held_out = next(i for i in range(100) if hmm.is_held_out(i))
    alone = hmm.hidden_markov_scores(as_docs(spark, [(held_out, "a b")])).first()
    assert (alone["n_known"], alone["train_tokens"], alone["base_score"]) == (0, 0, 0.0)


def brute_pipeline(spark, docs):
    """doc_id -> final text of the documents that the pipeline keeps; each decision made without Spark, but for the fit."""
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    rules = quality.fit(docs, labels)
    kept = {}
    for r in docs.select("doc_id", "text").collect():
        row = np.array([quality.statistics(r["text"])])
        n, repeats = row[0, 0], row[0, 4]
        if n >= 20 and 100 * repeats <= 30 * n and not any(quality._covered(rule, quality._features(row))[0] for rule in rules):
            kept[r["doc_id"]] = r["text"]
    def five(text):
        words = re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").strip(" \t\n\x0b\x0c\r"))
        return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words != [""] else frozenset()

    sets, group = {d: five(t) for d, t in kept.items()}, {d: d for d in kept}
    for a, b in itertools.combinations(sorted(kept), 2):
        if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {d: low if g == high else g for d, g in group.items()}
    kept = {d: t for d, t in kept.items() if group[d] == d}
    items = [decontaminate.shingles(r["text"]) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    parts = lambda s: {s[0][a:b] for a, b in zip(s[1], s[2])}
    items = [parts(s) for s in items]
    for d in list(kept):
        own = parts(decontaminate.shingles(kept[d]))
        if any(len(i & own) >= 0.8 * len(i) for i in items):
            del kept[d]
    return {d: secret_scan.redact(t, secret_scan.find_spans(t), "[SECRET]") for d, t in kept.items()}


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    expected = brute_pipeline(spark, docs)
    pieces = corpus_pipeline.run(spark, TABLES).collect()
    assert 100 < len(expected) < docs.count()
    assert check_pieces(list(expected.items()), pieces, 2048) < 0.02 * sum(p["length"] for p in pieces)


@pytest.mark.parametrize("table", ["odd", "nothing"])
def test_stages_keep_columns(spark, request, table):
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, TABLES), "test-stage")
        assert docs.schema == request.getfixturevalue(table).schema, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES)
    assert pieces.select("doc_id").distinct().count() == docs.count() == (table == "odd")


def test_redaction_updates_the_length(spark):
    docs = as_docs(spark, [(1, "token = " + "0f" * 20), (2, None), (3, "plain")]).withColumn("n_chars", F.col("n_chars").cast("int"))
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.secret_redaction(spark, docs, TABLES).collect()}
    assert rows == {1: ("[SECRET]", 8), 2: (None, None), 3: ("plain", 5)}

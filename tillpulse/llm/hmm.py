"""Language-model scores: a hidden Markov model beside an add-one unigram base.

Tokens are lower-cased words and one end per document. A hidden state emits a word class, and the class emits the word:
P(text) = sum over state paths of the product of transitions, P(class | state) and P(word | class). Classes are a fixed
function of the word (its ending and length), so the table of P(class | state) has a fixed size, while P(word | class)
comes from the corpus counts of all words, however many there are.

Texts are encoded once, in blocks of about three million tokens with a dictionary each. Word counts are summed over the blocks'
dictionaries and joined back to them, so a word travels once per block and not once per occurrence; the counts are
written before that join, so that the adaptive join can split a word that every block has. The blocks themselves are never
shuffled: the known counts of a block are written to a folder of its own, and the task that holds the block reads them.

Baum-Welch runs over the blocks: every task adds up expected counts, Spark sums them per class, and the driver gets one row per
class. The counts are those of whole documents. For speed a task works on stretches of ``STRETCH`` tokens side by side: the products
of the transfer matrices of the stretches carry the forward and backward vectors over their borders, and the move across a border
is counted like any other. Scoring runs the scaled forward recursion over whole documents and gives the exact likelihood
under the model.

Documents with crc32(doc_id as text) mod 7 = 2 are held out of all counts.

Cases: a null or empty text is its end alone; a null doc_id counts as the empty text; repeated rows count and score once
each; an empty table gives no rows; without training documents all words are unknown.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpulse.llm.common import keyed_text, map_batches, stored
from tillpulse.llm.warc import open_folder
from tillpulse.session import shared_dir

END = b""
CLASSES = 16384
STATES = 8
ITERATIONS = 4
BLOCK_TOKENS = 3_000_000
# Tokens of whole documents that a task works on at a time.
PART_TOKENS = 500_000
STRETCH = 1024
# Pseudo-counts: of a word within its class, of a class within a state, of a transition.
WORD_PRIOR, CLASS_PRIOR, MOVE_PRIOR = 0.5, 0.01, 1.0


def word_class(word: bytes) -> int:
    """0 for the end; otherwise by the last four bytes and the length."""
    return 1 + zlib.crc32(word[-4:], min(len(word), 16)) % (CLASSES - 1) if word else 0


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _tokens(text: str) -> list[bytes]:
    words = text.encode("utf-8").lower().split()
    words.append(END)
    return words


def pack_numbers(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes: the upper ones are nearly constant and compress well."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


_BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
    ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())),
    ("classes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])
_BLOCK_SQL = (
    "block long, doc_ids array<long>, held_out array<boolean>, lengths array<int>, tokens binary, "
    "words array<binary>, classes array<int>, counts array<long>"
)


def encoded_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block: its documents, their tokens as numbers in the block's dictionary, and the dictionary with its
    classes and counts over training documents."""

    def encode(batches):
        part = TaskContext.get().partitionId()
        serial = itertools.count()

        def flush():
            lengths = np.array([len(i) for i in ids], np.int32)
            tokens = np.concatenate(ids)
            train = np.repeat(~np.array(held, bool), lengths)
            words = list(number)
            row = {
                "block": part * (1 << 24) + next(serial), "doc_ids": doc_ids, "held_out": held, "lengths": lengths,
                "tokens": pack_numbers(tokens), "words": words, "classes": [word_class(w) for w in words],
                "counts": np.bincount(tokens[train], minlength=len(words)),
            }
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _BLOCK], schema=_BLOCK)

        doc_ids, held, ids, size = [], [], [], 0
        number = defaultdict(itertools.count().__next__)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = _tokens(text.as_py())
                ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                doc_ids.append(doc_id)
                held.append(is_held_out(doc_id))
                size += len(words)
                if size >= block_tokens:
                    yield flush()
                    doc_ids, held, ids, size = [], [], [], 0
                    number = defaultdict(itertools.count().__next__)
        if doc_ids:
            yield flush()

    return map_batches(keyed_text(docs), encode, _BLOCK_SQL)


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def initial(class_counts: np.ndarray, states: int, seed: int = 7) -> Model:
        noise = np.random.default_rng(seed).gamma(1.0, 1.0, (len(class_counts), states))
        emit = (class_counts[:, None] + CLASS_PRIOR) * (0.2 + noise)
        move = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + MOVE_PRIOR, move + MOVE_PRIOR, emit + CLASS_PRIOR
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first; how many are still running at each step; and where each begins."""
    order = np.argsort(-lengths, kind="stable")
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    running = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
    return order, running, begins


def log_likelihoods(model: Model, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 P(classes) of each sequence: the scaled forward recursion, one step of all running sequences at a time."""
    order, running, begins = _lanes(lengths)
    total = np.zeros(len(lengths))
    state = np.broadcast_to(model.start, (len(lengths), len(model.start)))
    for step, n in enumerate(running):
        if step:
            state = state[:n] @ model.move
        state = state * model.emit[classes[begins[:n] + step]]
        scale = state.sum(axis=1)
        total[:n] += np.log10(scale)
        state = state / scale[:, None]
    out = np.empty(len(lengths))
    out[order] = total
    return out


def _pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ``STRETCH`` tokens at most that documents are cut into: document, number within it, length."""
    parts = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    return owner, number, np.minimum(lengths[owner] - number * STRETCH, STRETCH)


def _carried(move, emit, start, classes, begins, number, sizes):
    """For each stretch the forward vector before it (the start for the first of a document, else the state at the end of the one
    before) and, up to a factor, the backward vector at its end."""
    k, n = len(start), len(sizes)
    before, after = np.tile(start, (n, 1)), np.ones((n, k), np.float32)
    cut = np.flatnonzero(np.append(number[1:], 0) > 0)  # stretches with another one behind them
    if not len(cut):
        return before, after
    # From before a stretch to its end; of the first of a document from its first token on.
    asked = np.union1d(cut, cut + 1)
    order = asked[np.argsort(-sizes[asked], kind="stable")]
    running = np.searchsorted(-sizes[order], -np.arange(sizes[order].max()), side="left")
    product = np.tile(np.eye(k, dtype=np.float32), (len(order), 1, 1))
    relative = emit / emit.max(axis=1, keepdims=True)
    first = number[order] == 0
    for step, m in enumerate(running):
        part = product[:m]
        if step:
            part = (part.reshape(-1, k) @ move).reshape(m, k, k)
        else:
            part = np.where(first[:m, None, None], part, move)
        np.multiply(part, relative[classes[begins[order[:m]] + step]][:, None, :], out=product[:m])
        if step % 2:  # two steps in a row stay far from the least number of this precision
            product[:m] /= product[:m].reshape(m, -1).max(axis=1)[:, None, None]
    place = np.full(n, -1)
    place[order] = np.arange(len(order))
    for level in range(1, int(number.max()) + 1):
        at = np.flatnonzero(number == level)
        vector = np.einsum("nk,nkj->nj", before[at - 1], product[place[at - 1]])
        before[at] = vector / vector.sum(axis=1, keepdims=True)
    for level in range(int(number.max()), 0, -1):
        at = np.flatnonzero(number == level)
        vector = np.einsum("nkj,nj->nk", product[place[at]], after[at])
        after[at - 1] = vector / vector.sum(axis=1, keepdims=True)
    return before, after


def expected_counts(model: Model, classes: np.ndarray, lengths: np.ndarray):
    """Baum-Welch: expected starts, moves and emissions over whole sequences, and their log10 likelihood."""
    k = len(model.start)
    move, emit, start = model.move.astype(np.float32), model.emit.astype(np.float32), model.start.astype(np.float32)
    _, number, sizes = _pieces(lengths)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before, after = _carried(move, emit, start, classes, begins, number, sizes)
    order, running, begins = _lanes(sizes)
    before, after, later_ones = before[order], after[order], number[order] > 0
    seen, states, scales = [], [], []
    state, logs = np.where(later_ones[:, None], before @ move, before), 0.0
    for step, n in enumerate(running):
        now = classes[begins[:n] + step]
        state = (state[:n] @ move if step else state) * emit[now]
        scale = state.sum(axis=1, keepdims=True)
        state = state / scale
        logs += float(np.log10(scale).sum())
        seen.append(now)
        states.append(state)
        scales.append(scale)
    moves = np.zeros((k, k))
    later = None
    for step in range(len(running) - 1, -1, -1):
        n = running[step]
        m = 0 if later is None else len(later)
        back = np.empty((n, k), np.float32)
        if m:
            ahead = emit[seen[step + 1]] * later / scales[step + 1]
            moves += states[step][:m].T @ ahead
            back[:m] = ahead @ move.T
        # Stretches that end here: scaled so that the states of the last token add up to one.
        ends = after[m:n]
        back[m:] = ends / (states[step][m:] * ends).sum(axis=1, keepdims=True)
        later = back
        states[step] = states[step] * back
    crossed = (emit[seen[0]] * later / scales[0])[later_ones]
    moves += before[later_ones].T @ crossed
    gamma, now = np.concatenate(states), np.concatenate(seen)
    emitted = np.stack([np.bincount(now, gamma[:, s], minlength=CLASSES) for s in range(k)], axis=1)
    return states[0][~later_ones].sum(axis=0, dtype=float), moves * model.move, emitted, logs


def _blocks(batches):
    """Rows one by one, as functions that give a column's value; lists as arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            def value(name, arrow=False, batch=batch, i=i):
                cell = batch.column(name).slice(i, 1)
                if not pa.types.is_list(cell.type):
                    return cell[0].as_py()
                return cell.flatten() if arrow else cell.flatten().to_numpy(zero_copy_only=False)

            yield value


def _parts(lengths: np.ndarray):
    """(documents, tokens) as slices of about ``PART_TOKENS`` tokens, in order."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART_TOKENS, side="right")) - 1)
        yield slice(at, to), slice(int(ends[at]), int(ends[to]))
        at = to


def baum_welch_step(blocks: DataFrame, model: Model) -> tuple[Model, float]:
    """The model after one pass over all training documents, and the log10 likelihood before it."""
    k = len(model.start)
    columns = [f"s{i}" for i in range(k)]

    def count(batches):
        start, moves, emitted, logs = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k)), 0.0
        for row in _blocks(batches):
            lengths, train = row("lengths").astype(np.int64), ~row("held_out").astype(bool)
            tokens = unpack_numbers(row("tokens"))[np.repeat(train, lengths)]
            classes, lengths = row("classes"), lengths[train]
            for docs, part in _parts(lengths):
                found = expected_counts(model, classes[tokens[part]], lengths[docs])
                start, moves, emitted, logs = start + found[0], moves + found[1], emitted + found[2], logs + found[3]
        used = np.flatnonzero(emitted.sum(axis=1))
        kinds = np.concatenate([used, [-1], -2 - np.arange(k), [-2 - k]])
        values = np.concatenate([emitted[used], start[None], moves, np.full((1, k), logs)])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), *[pa.array(v) for v in values.T]], ["kind", *columns])

    narrow = blocks.select("held_out", "lengths", "tokens", "classes")
    parts = map_batches(narrow, count, "kind int, " + ", ".join(f"{c} double" for c in columns))
    # One row per class and state at most, whatever the input.
    sums = {r[0]: np.array(r[1:]) for r in parts.groupBy("kind").agg(*[F.sum(c).alias(c) for c in columns]).collect()}
    emitted = np.zeros((CLASSES, k))
    for kind, values in sums.items():
        if kind >= 0:
            emitted[kind] = values
    zero = np.zeros(k)
    moves = np.stack([sums.get(-2 - i, zero) for i in range(k)])
    return Model.from_counts(sums.get(-1, zero), moves, emitted), float(sums.get(-2 - k, zero)[0])


def hidden_markov_scores(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document, log10."""
    blocks = stored(encoded_blocks(docs), "token-blocks")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "classes", "counts")).alias("place", "entry"))
    counted = entries.groupBy(F.col("entry.words").alias("word")).agg(
        F.first("entry.classes").alias("class"), F.sum("entry.counts").alias("count")
    )
    counted = stored(counted.where("count > 0"), "word-counts")
    by_class = counted.groupBy("class").agg(F.sum("count"), F.count(F.lit(1))).collect()  # CLASSES rows at most
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for kind, tokens, words in by_class:
        class_tokens[kind], class_words[kind] = tokens, words
    train_tokens, train_words = int(class_tokens.sum()), int(class_words.sum())

    model = Model.initial(class_tokens, states)
    for _ in range(iterations if train_tokens else 0):
        model, _ = baum_welch_step(blocks, model)

    looked_up = entries.select("block", "place", F.col("entry.words").alias("word")).join(counted.select("word", "count"), "word")
    known = looked_up.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "count"))).alias("known"))
    folder = shared_dir(docs.sparkSession, "known-counts")
    known = known.select("block", F.col("known.place").alias("known_places"), F.col("known.count").alias("known_counts"))
    known.write.partitionBy("block").parquet(folder)

    def counts_of(block: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of the words of a block that training documents have."""
        store, path = open_folder(folder)
        found = store.get_file_info(pa.fs.FileSelector(f"{path}/block={block}", allow_not_found=True))
        tables = [pa.parquet.read_table(f.path, filesystem=store, partitioning=None) for f in found if f.path.endswith(".parquet")]
        if not tables:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = pa.concat_tables(tables)
        return tuple(whole.column(c).combine_chunks().flatten().to_numpy() for c in ("known_places", "known_counts"))

    def score(batches):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for row in _blocks(batches):
            tokens, classes, lengths = unpack_numbers(row("tokens")), row("classes"), row("lengths").astype(np.int64)
            counts = np.zeros(len(classes))
            places, known_counts = counts_of(row("block"))
            counts[places] = known_counts
            base = np.log10((counts + 1) / (train_tokens + train_words + 1))
            inside = np.log10((counts + WORD_PRIOR) / (class_tokens + WORD_PRIOR * (class_words + 1))[classes])
            for docs, part in _parts(lengths):
                own, n = tokens[part], lengths[docs]
                begins = np.concatenate([[0], np.cumsum(n)[:-1]])
                total = log_likelihoods(model, classes[own], n) + np.add.reduceat(inside[own], begins)
                yield pa.RecordBatch.from_arrays([
                    row("doc_ids", arrow=True)[docs], pa.array(row("held_out")[docs].astype(bool)), pa.array(n),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64)[own], begins)),
                    pa.array(np.full(len(n), train_tokens, np.int64)),
                    pa.array(np.add.reduceat(base[own], begins)), pa.array(total),
                ], names)

    return map_batches(
        blocks.select("block", "doc_ids", "held_out", "lengths", "tokens", "classes"), score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )

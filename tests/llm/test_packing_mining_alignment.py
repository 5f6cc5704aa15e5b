"""Packing, hard negatives and token alignment against brute force, with nulls, empty tables, repeats and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import alignment, encoders, hard_negatives, packing, pieces, registry

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: doc_id, text, and columns whose names the operators use inside.
DOCS = "doc_id long, text string, piece int, length long, ids string, task int, nth long, n_a long, pairs string, dim int, chunk int, row long, b long"
CLASH = (1, 2, "x", 3, 4, 5, "y", 6, 7, 8, 9)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], DOCS)


def texts():
    r = random.Random(5)
    alphabet = [*"aB1.,'!<\n\t  ", "\n\n", "   ", " \n ", "é", "ß", "中", "🎉", " ", "　", " ", "\u0085", "\x1c", "don't", "we'll", " the", " Über", "1234", "<|endoftext|>", "</s>", "<0x41>", "hello world", "\r\n", "x=(y)"]
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(400)]
    words = ["".join(r.choice("abcdehilnorstu") for _ in range(r.randint(1, 9))) for _ in range(300)]
    out += [" ".join(r.choice(words) for _ in range(n)) for n in (1, 5, 400, 3000, 20_000)]
    return [*out, None, "", " ", "\n", "a▁b", "▁", "a" * 5000, "word " * 900, " lead", "trail "]


@pytest.fixture(scope="module")
def brute():
    """For every text: A's ids with special tokens, A's ids as plain text of space and text, B's ids."""
    library, plain = Tokenizer.from_file(BYTE), Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    return [(library.encode(t or "", add_special_tokens=False).ids, plain.encode(" " + (t or ""), add_special_tokens=False).ids, model.encode(t or "")) for t in texts()]


def test_pieces_of_texts_have_the_tokens_of_whole_texts(brute):
    import pyarrow as pa

    which, first, distinct = pieces.cut(pa.array(texts(), pa.string()))
    ids, at = encoders.ByteLevel(BYTE, special=True).pieces(distinct)
    for i, (want, _, _) in enumerate(brute):
        assert b"".join(distinct[w] for w in which[first[i] : first[i + 1]]).decode() == (texts()[i] or "")
        assert [x for w in which[first[i] : first[i + 1]] for x in ids[at[w] : at[w + 1]]] == want
    assert pieces.cut(pa.array([], pa.string()))[2] == [] and pieces.cut(pa.array(["", None]))[1].tolist() == [0, 0, 0]


def test_remembered_pieces_are_bounded():
    calls = []
    of = pieces.Remembered(lambda x: calls.append(len(x)) or [p * 2 for p in x], len, room=60, longest=8)
    assert of([b"ab", b"c" * 9]) == [b"abab", b"c" * 18] and of([b"ab", b"c" * 9]) == [b"abab", b"c" * 18] and calls == [2, 1]
    for i in range(50):
        assert of([str(i).encode()]) == [str(i).encode() * 2]
    assert sum(len(k) + len(v) for half in (of.known, of.older) for k, v in half.items()) <= 60


def best_fit(lengths, size):
    """Sequences that best-fit decreasing makes, one piece at a time."""
    free, made = collections.Counter(), 0
    for n in sorted(lengths, reverse=True):
        f = min((f for f, many in free.items() if f >= n and many), default=None)
        if f is None:
            f = size
            made += 1
        else:
            free[f] -= 1
        free[f - n] += 1
    return made


def check_plan(counts, size):
    rows = packing.plan(counts, size)
    filled, seen = collections.defaultdict(list), collections.Counter()
    for length, first, count, sequence, offset in rows.tolist():
        assert first == seen[length] and count > 0
        seen[length] += count
        for k in range(count):
            filled[sequence + k].append((offset, length))
    assert dict(seen) == {n: int(c) for n, c in enumerate(counts) if c}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(filled) == list(range(len(filled)))
    return len(filled)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_and_packs_well(seed):
    r = np.random.default_rng(seed)
    size = (64, 64, 50, 64, 128, 64)[seed]
    lengths = [r.integers(1, size + 1, 3000), np.minimum(size, r.geometric(0.05, 4000)), r.choice([7, 11, 26, 50], 900), r.integers(1, 9, 5000), np.array([100] * 500 + [60] * 300 + [28] * 310), np.array([1])][seed]
    counts = np.bincount(lengths, minlength=size + 1)
    made, usual, least = check_plan(counts, size), best_fit(lengths.tolist(), size), -(-int(lengths.sum()) // size)
    assert made <= usual + 2 and made >= least


def test_patterns_carry_most_pieces_and_fit_is_the_least_squares():
    r = np.random.default_rng(1)
    counts = np.bincount(r.integers(1, 33, 20_000), minlength=33).astype(float)
    rows = packing.patterns(np.arange(1, 33), 32)
    assert (rows.sum(1) == 32).all() and len({tuple(x) for x in rows.tolist()}) == len(rows)
    x = packing.fitted(rows, counts, 3000)
    used = np.bincount(rows.ravel(), np.repeat(x, 3), 33)
    used[0] = 0
    gradient = ((rows > 0) * (used - counts)[rows]).sum(1)
    assert x.min() >= 0 and gradient.min() > -5 and np.abs(gradient[x > 1]).max() < 5  # the conditions of an optimum
    assert packing.plan(np.zeros(33), 32).shape == (0, 5)
    assert packing.fitted(np.zeros((0, 3), np.int64), counts).shape == (0,)


def test_packing_equals_brute_force(spark, brute):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, texts()[3]), (None, "null id"), (9000, "same"), (9001, "same")]
    docs = docs_of(spark, rows).repartition(7)
    cut = packing.cut_documents(docs, BYTE)
    placed = packing.place(cut.drop("ids").join(cut.select("task", "nth", "length", F.crc32("ids").alias("ids_crc32")), ["task", "nth", "length"]))
    got = placed.toPandas()
    library = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, to in enumerate(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)):
            want[i, k, at, to - at, zlib.crc32(ids[at:to].tobytes())] += 1
            at = to
    assert want == collections.Counter((None if x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= best_fit(got.length.tolist(), 1024)
    whole = packing.sequences(packing.place(cut)).toPandas()
    assert sorted(whole.length) == sorted(got.groupby("sequence_id").length.sum())
    one = whole.iloc[0]
    assert len(one.ids) == 4 * one.length and one.ends[-1] == one.length
    assert packing.place(packing.cut_documents(docs_of(spark, []), BYTE).drop("ids")).count() == 0


def test_packing_query(spark):
    got = registry.QUERIES["op11_packing"](spark, DATA)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    rows = got.toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    library = Tokenizer.from_file(BYTE)
    n = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in zip(docs.doc_id, docs.text)}
    assert rows.groupby("doc_id").length.sum().to_dict() == n
    assert rows.sequence_id.nunique() <= 1.01 * sum(n.values()) / 1024 + 1


def mined(rows, positives=5, negatives=10):
    """Hard negatives pair by pair with whole numbers of any size."""
    use = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, label, q in use:
        if i % 100:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(q, w)), j, l == label, j == i) for j, l, w in use if len(w) == len(q)})
        best = []
        for s, j, alike, self_ in scored:
            if alike and not self_ and (s, j) not in best and len(best) < positives:
                best.append((s, j))
        for s, j in best:
            among = list(dict.fromkeys((t, k) for t, k, alike, _ in scored if not alike and 30 * -s <= 100 * -t <= 90 * -s))
            out |= {(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(among[:negatives], 1)}
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, *CLASH) for i, label, v in rows], "vec_id long, embedding array<double>, label int, " + DOCS.split("text string, ")[1])


def vectors():
    r = np.random.default_rng(3)
    center = r.normal(0, 0.3, (4, 12))
    rows = [(i, int(r.integers(0, 4)), (center[r.integers(0, 4)] + r.normal(0, 0.2, 12)).tolist()) for i in range(700)]
    rows += [(100_000 + i, 1, rows[200][2]) for i in range(30)]  # copies: ties by id
    rows += [(205, *rows[205][1:]), (200, *rows[200][1:]), (300, 2, rows[301][2])]  # repeats, and an id with two vectors
    bad = [None, [], [0.0] * 12, [float("nan")] + [0.1] * 11, [float("inf")] + [0.1] * 11, [None] + [0.1] * 11, [0.3] * 5, [0.2] * 5]
    rows += [(800 + 100 * k, 1, v) for k, v in enumerate(bad)] + [(2100, None, [0.1] * 12), (None, 1, [0.1] * 12), (2200, 1, [1e5] * 12), (2201, 1, [1e5] * 12), (2202, 2, [6e4] * 12), (-100, 3, [0.25] * 12)]
    return rows


@pytest.mark.parametrize("block, chunk", [(2048, 8192), (50, 3)])
def test_hard_negatives_equal_brute_force(spark, block, chunk):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine_negatives(vectors_of(spark, vectors()).repartition(3), F.col("vec_id") % 100 == 0, label, block=block, chunk=chunk)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == mined(vectors())
    empty = hard_negatives.mine_negatives(vectors_of(spark, []), F.col("vec_id") % 100 == 0, label)
    assert empty.count() == 0 and empty.columns == got.columns


def test_hard_negatives_query_gives_the_rows_of_its_sql(spark, duck):
    same(registry.QUERIES["op12_hard_negatives"](spark, DATA), duck, registry.ORACLE_SQL["op12_hard_negatives"])


def test_bounds_enclose_scores_and_tighten():
    r = np.random.default_rng(0)
    q = r.integers(-300, 300, (40, 13))
    b = hard_negatives.Block(hard_negatives._packed(np.arange(40), np.zeros(40, np.int64), q))
    exact, everything = b.q @ b.q.T, np.arange(40)
    width = []
    for level in range(2):
        low, high = hard_negatives._bounds(b, b, level, everything)
        assert (low <= exact).all() and (exact <= high).all()
        width.append((high - low).mean())
    assert width[1] < width[0]
    near = q + r.integers(-3, 4, q.shape)  # the bounds leave few rows to vectors close to an anchor's own
    rows = hard_negatives.Block(hard_negatives._packed(np.arange(4000), np.zeros(4000, np.int64), np.concatenate((near, r.integers(-30, 30, (3960, 13))))))
    left, live = hard_negatives._possible(b, rows, lambda m: np.ones((40, len(m)), bool), lambda live, low, high: high >= hard_negatives._kth(np.where(live, low, -np.inf), 1)[:, None])
    assert live.sum() < 0.3 * 40 * 4000 and len(left) <= 4000


def test_ends_are_aligned_like_brute_force():
    r = random.Random(2)
    for n in (1, 2, 10, 1000, 5000):
        for p, q in ((0.5, 0.5), (0.9, 0.1), (0.2, 0.2)):
            common = {x for x in range(1, n) if r.random() < 0.8 * p}
            a = np.array(sorted({n} | common | {x for x in range(1, n) if r.random() < q}))
            b = np.array(sorted({n} | common | {x for x in range(1, n) if r.random() < q / 2}))
            left, right = alignment.aligned(a, b)
            shared = sorted(set(a.tolist()) & set(b.tolist()))
            assert a[left - 1].tolist() == shared and b[right - 1].tolist() == shared
            la, lb, per = alignment.links(a, b, left, right)
            begin_a, begin_b = np.append(0, a[:-1]), np.append(0, b[:-1])
            want = [(i, j) for i in range(len(a)) for j in range(len(b)) if begin_a[i] < b[j] and begin_b[j] < a[i]] if n <= 1000 else None
            assert want is None or list(zip(la.tolist(), lb.tolist())) == want
            assert per.sum() == len(la)


def expected_alignment(rows, brute_of):
    """Digest rows token by token over bytes."""
    letters = {c: b for b, c in encoders._byte_letters().items()}
    library = Tokenizer.from_file(BYTE)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    bytes_a = lambda i: "<|endoftext|>".encode() if i == 50256 else bytes(letters[c] for c in library.id_to_token(i))
    bytes_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    made, count = [], collections.Counter()
    for i, t in rows:
        _, a, b = brute_of(t)
        wa, wb = [bytes_a(x) for x in a], [bytes_b(x) for x in b]
        if not t or b"".join(wa) != (" " + t).encode() or b"".join(wb) != (" " + t).encode():
            made.append((i, 0, 0, "", []))
            continue
        ea, eb = np.cumsum([len(x) for x in wa]), np.cumsum([len(x) for x in wb])
        common, groups, x, y, pairs = sorted(set(ea.tolist()) & set(eb.tolist())), [], 0, 0, []
        for c in common:
            x2, y2 = int(np.searchsorted(ea, c)) + 1, int(np.searchsorted(eb, c)) + 1
            groups.append(",".join(map(str, a[x:x2])) + "|" + ",".join(map(str, b[y:y2])))
            pairs += [(a[p], b[q]) for p in range(x, x2) for q in range(y, y2) if (ea[p - 1] if p else 0) < eb[q] and (eb[q - 1] if q else 0) < ea[p]]
            x, y = x2, y2
        count.update(pairs)
        made.append((i, len(a), len(b), ";".join(groups), pairs))
    best = collections.Counter()
    for (a, b), n in count.items():
        best[b] = max(best[b], n)
    return collections.Counter(
        (i, na, nb, g.count(";") + 1 if g else 0, len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, na, nb, g, p in made
    )


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 20])
def test_alignment_equals_brute_force(spark, brute, frequent):
    rows = [*enumerate(texts()), (3, texts()[3]), (None, "null id, don't")]
    known = dict(zip(texts(), brute))
    plain = Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    of = lambda t: known.get(t) or (None, plain.encode(" " + (t or ""), add_special_tokens=False).ids, model.encode(t or ""))
    out = alignment.align(docs_of(spark, rows).repartition(3), BYTE, PIECE)
    sha = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", sha, "pairs")
    got = alignment.score(out, alignment.pair_counts(out), ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), frequent)
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert collections.Counter(tuple(x) for x in got.collect()) == expected_alignment(rows, of)


def test_alignment_of_no_documents_and_the_query(spark):
    empty = alignment.align(docs_of(spark, []), BYTE, PIECE)
    assert alignment.score(empty, alignment.pair_counts(empty)).count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plain = Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = expected_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], lambda t: (None, plain.encode(" " + (t or ""), add_special_tokens=False).ids, model.encode(t or "")))
    got = registry.QUERIES["op13_alignment"](spark, DATA).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert collections.Counter(tuple(x) for x in got.collect()) == want


def test_slices_of_a_chunk_are_its_rows():
    q = np.arange(70).reshape(10, 7)
    b = hard_negatives.Block(hard_negatives._packed(np.arange(10), np.arange(10) % 3, q))
    parts = list(b.slices(4))
    assert [at for at, _ in parts] == [0, 4, 8] and np.concatenate([p.q for _, p in parts]).tolist() == b.q.tolist()
    assert all(np.array_equal(np.concatenate([p.level[k][j] for _, p in parts]), b.level[k][j]) for k in range(2) for j in range(2))


@pytest.mark.parametrize("size", [1, 300, 1 << 18])  # products in single and double precision and in whole numbers
def test_the_best_few_of_an_anchor_do_not_grow_with_the_blocks(size):
    r = np.random.default_rng(size)
    center = r.integers(-90, 90, (6, 16))
    label = np.sort(r.integers(0, 6, 3000))
    ids, q = np.append(np.arange(2990), np.arange(10)), (center[label] + r.integers(-9, 10, (3000, 16))) * size  # ten ids repeat
    q[40:80], label[50:60] = q[40], 3  # ties, with other labels among them
    block = lambda some: hard_negatives.Block(hard_negatives._packed(ids[some], label[some], q[some]))
    anchors = block(np.arange(0, 3000, 7))
    found = hard_negatives.Positives(anchors, 5)
    order = r.permutation(3000)
    blocks = [block(order[i : i + 100]) for i in range(0, 3000, 100)]
    for b in blocks:
        found.add(b)
    kth = found.best.score.reshape(-1, 5)
    lowest, highest = np.where(kth != hard_negatives.NONE, -(-30 * kth // 100), 1), np.where(kth != hard_negatives.NONE, 90 * kth // 100, 0)
    others = hard_negatives.Negatives(anchors, lowest, highest, 10)
    for b in blocks:
        others.add(b)
    got, left = collections.defaultdict(list), collections.defaultdict(list)
    for search, out in ((found, got), (others, left)):
        for x, score, i in sorted(zip(*(c.tolist() for c in search.best.rows())), key=lambda t: (t[0], -t[1], t[2])):
            out[x].append((score, i))
    assert len(found.best.score) == len(anchors.ids) and len(others.best.score) == 5 * len(anchors.ids)  # places, however many blocks
    scores = anchors.q @ q.T
    for a in range(len(anchors.ids)):
        alike = {(int(-s), int(i)) for s, i in zip(scores[a][label == anchors.labels[a]], ids[label == anchors.labels[a]]) if i != anchors.ids[a]}
        unlike = sorted({(int(-s), int(i)) for s, i in zip(scores[a][label != anchors.labels[a]], ids[label != anchors.labels[a]])})
        assert got[a] == [(-s, i) for s, i in sorted(alike)[:5]]
        for p, (s, _) in enumerate(got[a]):
            assert left[5 * a + p] == [(-t, i) for t, i in unlike if 30 * s <= 100 * -t <= 90 * s][:10]
    assert max(found.step.values()) < 64 and any(found.bounded(at, some, b, lambda who, live, low, high: high >= found.best.score[at + who, -1:], lambda who, m: np.ones((len(who), len(m)), bool)) is not b for at, _, some in found.alike for b in blocks)
